"""Registered queries: MLlib classifiers (rows-only checks: model fits have
no SQL oracle)."""
from __future__ import annotations

from pyspark.sql import functions as F

from convgraph.operators import features as FT
from convgraph.operators import models as MD
from convgraph.operators import sampling as H
from convgraph.plans import standins as S
from convgraph.plans.registry import query
from convgraph.session import cut_lineage, release

LAB = S.LABELS


def _split_rows(spark, sf):
    """Labelled documents split 60/20/20 by source (no source crosses)."""
    return H.split_by_groups(S.labelled(spark, sf), "source", 0.6, 0.2, 42)


def _splits(rows):
    return [rows.filter(F.col("split") == s) for s in ("train", "val", "test")]


def _counted(df, text_cols, keep=()):
    """Term counts of the texts next to ids, labels and ``keep``, written once
    for all splits."""
    return cut_lineage(MD.term_counts(df, text_cols).select("id", "split", *LAB, *keep, *MD.count_cols(text_cols)))


@query("baseline_classifier")
def baseline_classifier(spark, sf):
    """M7 + H5: three seeded runs of a text-only classifier, validation and
    test macro metrics per run, best run flagged."""
    tr, va, te = _splits(_counted(_split_rows(spark, sf), ["text"]))
    return MD.seeded_runs(tr, va, te, "id", LAB, ["text"])


VAD = ["valence", "arousal", "dominance"]
MIN_WORD = 3


def _with_features(spark, sf, df):
    """Features and context texts of the rows of all splits in one pass.  Rows
    of one id count together within their split only."""
    docs = S.table(spark, sf, "documents")
    lex = cut_lineage(FT.word_lexicon(docs, "text", MIN_WORD, frequency="n"))
    vad = FT.lexicon_scores(df, ["split", "id"], "text", lex, VAD, frequency="n", min_len=MIN_WORD)
    pos = FT.pos_histogram(df, ["split", "id"], "text")
    near = docs.select("doc_id", "text")
    before = near.select((F.col("doc_id") + 1).alias("id"), F.col("text").alias("previous"))
    after = near.select((F.col("doc_id") - 1).alias("id"), F.col("text").alias("posterior"))

    def same_split(feats):
        # compared by order, not by =: all joins stay on id alone, so that the
        # texts of the rows are shuffled once
        f = feats.withColumnRenamed("split", "_split")
        return lambda rows: (rows.join(f, "id").filter((F.col("split") <= F.col("_split")) &
                                                       (F.col("split") >= F.col("_split"))).drop("_split"))
    rows = df.select("id", "split", *LAB, "text").transform(same_split(vad)).transform(same_split(pos))
    # previous + main + posterior text as one input, missing sides empty
    return (rows.join(before, "id", "left").join(after, "id", "left")
                .withColumn("text_and_context", F.concat_ws(" ", "previous", "text", "posterior")))


@query("context_classifier")
def context_classifier(spark, sf):
    """M8: previous, main and posterior text (the documents before and after
    by id stand in for the conversation) + the engineered features chosen by
    prefix (VAD scores, part-of-speech counts) in one feature vector."""
    split = cut_lineage(_split_rows(spark, sf))
    rows = _with_features(spark, sf, split)
    feats = FT.feature_columns(rows, VAD + ["POS_"])
    tr, va, te = _splits(_counted(rows, ["text_and_context"], feats))
    release(split)
    return MD.seeded_runs(tr, va, te, "id", LAB, ["text_and_context"], feats, n_runs=1)


@query("batch_scoring")
def batch_scoring(spark, sf):
    """M9: score the test split with a fitted model; truth, logits and
    predictions saved next to the text."""
    tr, va, te = _splits(_counted(_split_rows(spark, sf), ["text"], ["text"]))
    feats = MD.fit_features(tr, ["text"])
    models = MD.fit_labels(MD.featurized(feats, tr, "id", LAB), "id", LAB, reg=0.1, seed=42)
    return MD.score(models, MD.featurized(feats, te, "id", LAB, keep=["text"]), "id", LAB, keep=["text"])
