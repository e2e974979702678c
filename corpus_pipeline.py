"""The corpus pipeline over ``documents``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read back as the next
stage's ``docs``.  Every stage works on all rows its predecessor kept:

1. toxicity: documents that the classifier rejects go;
2. exact dedup: of equal texts the smallest id stays;
3. near dedup: of each group of texts linked at 0.8 one document stays;
4. substring dedup: words covered by a window of 13 words that also starts in a
   document with a smaller id are cut out; a document of which nothing is left
   goes;
5. packing: the texts become sequences of at most 2048 tokens (one row a piece).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from convgraph.llm.common import dropped, stored, table
from convgraph.llm.exact_dedup import keep_first
from convgraph.llm.minhash_hamming import keep_one
from convgraph.llm.packing import pack
from convgraph.llm.substring_dedup import cut_texts
from convgraph.llm.toxicity_chain import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that lose nothing stay as they are; the others become the kept
    words joined by one space, with ``n_chars`` counted anew."""
    old = "_old"
    while old in docs.columns:
        old += "_"
    out = cut_texts(docs.withColumn(old, F.xxhash64("text")))
    changed = F.xxhash64("text") != F.col(old)
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(old)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", substrings),
          ("packing", packing)]

#: The classifier, the signatures and the packing cannot be stated in SQL; the
#: stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(before)  # the stage after it is written; the table itself stays
    return docs
