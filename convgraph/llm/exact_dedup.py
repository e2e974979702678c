"""Exact dedup [native]: group by a 128-bit content hash, keep the smallest
id, compare bytes inside groups.

Rows are grouped by (128-bit hash, normalised text): the hash routes a row,
the grouping itself compares the bytes, so texts that merely collide end in
different classes.  Copies are combined before the shuffle, one row per
distinct text leaves a task, whatever the size of the group.  The classes then
go back to the rows by (hash, SHA-256 of the class text, salt); only the salts
that occur in a class are sent, so a class of any size is spread over up to
256 tasks.

Defined results: a null text is the empty text; a null id never wins over a
non-null one; rows that repeat an id and a text share the decision, rows that
repeat an id with another text do not; ``exact_dedup`` marks every row of a
class of null ids as kept, ``keep_first`` keeps one of them (the one whose
columns have the smallest hash); an empty table gives an empty table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from convgraph.llm.common import id_text, one_null_row, per_salt, salt_bits, whole_rows, with_salt


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                hash_128=md5_128) -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256)."""
    return (_decided(id_text(docs, id_col, text_col), hash_128)
            .select(F.col("id").alias(id_col), "keep_id", "group_size",
                    F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256")))


def _decided(rows: DataFrame, hash_128, *other: str) -> DataFrame:
    """(id, other columns, sha, keep_id, group_size) of rows (id, text, other
    columns), one per row."""
    rows = with_salt(rows.select("id", normalised(F.col("text")).alias("norm"), *other)
                     .withColumn("h", hash_128(F.col("norm"))))
    classes = rows.groupBy("h", "norm").agg(F.min("id").alias("keep_id"),
                                            F.count(F.lit(1)).alias("group_size"), *salt_bits())
    sha = F.unhex(F.sha2("norm", 256)).alias("sha")
    spread = per_salt(classes.withColumn("sha", sha).drop("norm"))
    return rows.select("id", "h", sha, "salt", *other).join(spread, ["h", "sha", "salt"])


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text stays, with all their columns, decided
    row by row: rows with the smallest id of their class, or one row of a class
    that has null ids only."""
    rows = whole_rows(docs, id_col, text_col)
    rows = rows.where("id IS NOT NULL").unionByName(one_null_row(rows, normalised(F.col("text"))))
    kept = _decided(rows, md5_128, "_row").where("id <=> keep_id")
    return kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
