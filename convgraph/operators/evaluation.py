"""Multi-label evaluation.

Everything is one pass of sums over (row, label) pairs; curves (ROC, PR)
are built from score histograms with distributed running sums, so no label
is ever sorted inside a single task.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convgraph.operators.relations import global_positions, global_running_sums


# M1
def predict(logit: Column, threshold: float = 0.5) -> Column:
    """sigmoid(logit) >= threshold -> 1."""
    return F.when(1.0 / (1.0 + F.exp(-logit)) >= threshold, 1).otherwise(0)


def long_predictions(df: DataFrame, id_col: str, labels: list[str], truth_prefix: str = "",
                     logit_prefix: str = "logit_", threshold: float = 0.5) -> DataFrame:
    """(id, label, y, logit, score, pred) for every row and label."""
    parts = [F.struct(F.lit(l).alias("label"), F.col(truth_prefix + l).cast("int").alias("y"),
                      F.col(logit_prefix + l).alias("logit")) for l in labels]
    x = df.select(id_col, F.explode(F.array(*parts)).alias("_p")).select(id_col, "_p.*")
    return x.withColumn("score", 1.0 / (1.0 + F.exp(-F.col("logit")))) \
            .withColumn("pred", predict(F.col("logit"), threshold))


def confusion(long: DataFrame) -> DataFrame:
    """tp / fp / fn / support per label."""
    y, p = F.col("y"), F.col("pred")
    return long.groupBy("label").agg(F.sum(y * p).alias("tp"), F.sum((1 - y) * p).alias("fp"),
                                     F.sum(y * (1 - p)).alias("fn"), F.sum(y).alias("support"))


def _safe(num, den):
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def per_label_scores(conf: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return conf.select("label", _safe(tp, tp + fp).alias("precision"), _safe(tp, tp + fn).alias("recall"),
                       _safe(2 * tp, 2 * tp + fp + fn).alias("f1"), F.col("support").cast("long").alias("support"))


def subset_accuracy(long: DataFrame, id_col: str) -> DataFrame:
    per_row = long.groupBy(id_col).agg(F.min((F.col("y") == F.col("pred")).cast("int")).alias("_exact"))
    return per_row.agg(F.avg("_exact").alias("accuracy"))


# M2
def macro_metrics(long: DataFrame, id_col: str) -> DataFrame:
    """Macro precision / recall / F1 (zero division -> 0) and subset accuracy."""
    s = per_label_scores(confusion(long)).agg(F.avg("f1").alias("f1"), F.avg("precision").alias("precision"),
                                              F.avg("recall").alias("recall"))
    return s.crossJoin(subset_accuracy(long, id_col))


# M3
def classification_report(long: DataFrame, id_col: str) -> DataFrame:
    conf = confusion(long)
    per = per_label_scores(conf)
    tot = conf.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
                   F.sum("support").alias("support"))
    micro = tot.select(F.lit("micro avg").alias("label"), _safe(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                       _safe(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
                       _safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
                       F.col("support").cast("long").alias("support"))
    macro = per.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    w = F.col("support")
    weighted = per.agg(F.lit("weighted avg").alias("label"),
                       _safe(F.sum(F.col("precision") * w), F.sum(w)).alias("precision"),
                       _safe(F.sum(F.col("recall") * w), F.sum(w)).alias("recall"),
                       _safe(F.sum(F.col("f1") * w), F.sum(w)).alias("f1"), F.sum(w).alias("support"))
    rows = long.groupBy(id_col).agg(F.sum(F.col("y") * F.col("pred")).alias("_i"), F.sum("y").alias("_t"),
                                    F.sum("pred").alias("_p"))
    samples = rows.agg(F.lit("samples avg").alias("label"),
                       F.avg(_safe(F.col("_i"), F.col("_p"))).alias("precision"),
                       F.avg(_safe(F.col("_i"), F.col("_t"))).alias("recall"),
                       F.avg(_safe(2 * F.col("_i"), F.col("_t") + F.col("_p"))).alias("f1"),
                       F.sum("_t").alias("support"))
    out = per
    for part in (micro, macro, weighted, samples):
        out = out.unionByName(part.select("label", "precision", "recall", "f1",
                                          F.col("support").cast("long").alias("support")))
    return out


# M4
def bce_with_logits(long: DataFrame) -> DataFrame:
    x, y = F.col("logit"), F.col("y")
    loss = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    return long.agg(F.avg(loss).alias("bce_loss"))


def bce_batch_means(long: DataFrame, id_col: str, batch_rows: int) -> DataFrame:
    """(n_batches, bce_loss): the loss of an evaluation loop, which averages the
    means of batches of ``batch_rows`` rows in id order, so a short last batch
    counts as much as a full one.  Rows are numbered by a range partitioning of
    one row per id, and a batch is one group of sums."""
    x, y = F.col("logit"), F.col("y")
    loss = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    rows = long.groupBy(id_col).agg(F.sum(loss).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    placed = global_positions(rows, [id_col], "_pos").withColumn("_batch", F.expr(f"(_pos - 1) div {int(batch_rows)}"))
    means = placed.groupBy("_batch").agg((F.sum("_sum") / F.sum("_n")).alias("_mean"))
    return means.agg(F.count(F.lit(1)).alias("n_batches"), F.avg("_mean").alias("bce_loss"))


def _score_histogram(long: DataFrame) -> DataFrame:
    return long.groupBy("label", "score").agg(F.sum("y").alias("_pos"),
                                               F.sum(1 - F.col("y")).alias("_neg"))


def grouped_running_sums(df: DataFrame, key: str, order: list, values: list[str]) -> DataFrame:
    """Running sums of ``values`` inside each ``key`` group in ``order``,
    distributed: global running sums over (key, order...), all in one pass,
    minus the key's starting offset (one row per key)."""
    out = global_running_sums(df, [F.col(key)] + order, {v: "_g_" + v for v in values})
    starts = out.groupBy(key).agg(*[F.min(F.col("_g_" + v) - F.col(v)).alias("_s_" + v) for v in values])
    out = out.join(starts, key)
    for v in values:
        out = out.withColumn("cum" + v, F.col("_g_" + v) - F.col("_s_" + v)).drop("_g_" + v, "_s_" + v)
    return out


def _curve(long: DataFrame) -> DataFrame:
    """Per label and distinct score, highest first: hits and false alarms at
    that score and at it or above, and the label's totals P and N."""
    h = _score_histogram(long)
    c = grouped_running_sums(h, "label", [F.col("score").desc()], ["_pos", "_neg"])
    return c.join(h.groupBy("label").agg(F.sum("_pos").alias("P"), F.sum("_neg").alias("N")), "label")


# M5
def roc_curve(long: DataFrame) -> DataFrame:
    """(label, threshold, fpr, tpr), one point per distinct score; NULL rates
    for a label without negatives or positives."""
    return _curve(long).select("label", F.col("score").alias("threshold"), F.try_divide("cum_neg", "N").alias("fpr"),
                               F.try_divide("cum_pos", "P").alias("tpr"))


def roc_auc(long: DataFrame) -> DataFrame:
    """Per label AUC by the trapezoid rule over distinct thresholds (ties
    count half), from a per-label score histogram."""
    area = F.col("_neg") * (2 * F.col("cum_pos") - F.col("_pos")) / 2.0
    return _curve(long).groupBy("label").agg(F.try_divide(F.sum(area), F.first("P") * F.first("N")).alias("auc"))


# M6
def precision_recall_curve(long: DataFrame) -> DataFrame:
    """(label, threshold, precision, recall), one point per distinct score."""
    return _curve(long).select("label", F.col("score").alias("threshold"),
                               (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
                               F.try_divide("cum_pos", "P").alias("recall"))


def average_precision(long: DataFrame) -> DataFrame:
    """AP = sum over thresholds (descending) of (R_n - R_{n-1}) * P_n."""
    term = F.try_divide("_pos", "P") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    return _curve(long).groupBy("label").agg(F.sum(term).alias("average_precision"))


# --- fixed values: the 13a tokenizer of machine-translation scoring --------
TOKENIZER_13A = (
    (r"<skipped>", ""), (r"-\n", ""), (r"\n", " "),
    (r"&quot;", '"'), (r"&amp;", "&"), (r"&lt;", "<"), (r"&gt;", ">"),
    (r"^|$", " "),
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "),
)
# --------------------------------------------------------------------------


# M10
def bleu_tokens(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    for pattern, to in TOKENIZER_13A:
        c = F.concat(F.lit(" "), c, F.lit(" ")) if pattern == "^|$" else F.regexp_replace(c, pattern, to)
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def corpus_bleu(pairs: DataFrame, id_col: str, hyp: str, ref: str, max_n: int = 4) -> DataFrame:
    """Corpus BLEU (one reference, 13a tokens, exponential smoothing of zero
    counts, brevity penalty) and the mean hypothesis length.  All n-grams of
    both sides come from one explode and one grouping; 0 if no hypothesis has
    ``max_n`` tokens, NULL lengths for an empty table."""
    t = pairs.select(id_col, bleu_tokens(hyp).alias("_h"), bleu_tokens(ref).alias("_r"))
    lens = t.agg(F.sum(F.size("_h")).alias("sys_len"), F.sum(F.size("_r")).alias("ref_len"),
                 F.avg(F.size("_h")).alias("gen_len"))

    def grams(side, is_hyp):
        toks = F.col(side)

        def of(n):
            made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(toks) - n + 1, F.lit(1))),
                               lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(toks, i, n), " ").alias("g"),
                                                  F.lit(is_hyp).alias("hyp")))
            return F.when(F.size(toks) >= n, made).otherwise(F.slice(made, 1, 0))
        return F.concat(*[of(n) for n in range(1, max_n + 1)])
    per = (t.select(id_col, F.inline(F.concat(grams("_h", True), grams("_r", False))))
            .groupBy(id_col, "n", "g").agg(F.count_if("hyp").alias("hc"), F.count_if(~F.col("hyp")).alias("rc")))
    row = lens.crossJoin(per.agg(
        *[F.coalesce(F.sum(F.when(F.col("n") == n, F.least("hc", "rc"))), F.lit(0)).alias(f"c{n}") for n in range(1, max_n + 1)],
        *[F.coalesce(F.sum(F.when(F.col("n") == n, F.col("hc"))), F.lit(0)).alias(f"t{n}") for n in range(1, max_n + 1)]))
    # exponential smoothing: the k-th order with no match gets 1 / (2^k * total)
    logs, k = [], F.lit(0)
    for n in range(1, max_n + 1):
        c, tt = F.col(f"c{n}"), F.col(f"t{n}")
        k = k + F.when(c == 0, 1).otherwise(0)
        logs.append(F.log(F.when(c > 0, F.try_divide(c, tt)).otherwise(F.try_divide(F.lit(1.0), F.pow(F.lit(2.0), k) * tt))))
    bp = F.when(F.col("sys_len") >= F.col("ref_len"), F.lit(1.0)).otherwise(
        F.exp(1 - F.try_divide("ref_len", "sys_len")))
    bleu = F.when(F.col(f"t{max_n}") == 0, F.lit(0.0)).otherwise(bp * F.exp(sum(logs) / max_n) * 100)
    return row.select(bleu.alias("bleu"), F.col("gen_len"))


# W7 + M11
def best_epoch(history: DataFrame, keys: list[str], epoch: str, metric: str) -> DataFrame:
    """First epoch with the highest metric per run (strictly greater wins,
    as in the reference's training loop): an aggregate, no window."""
    best = F.max(F.struct(F.col(metric), (-F.col(epoch)).alias("_neg_epoch")))
    return history.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, (-F.col("_b._neg_epoch")).alias("best_epoch"), F.col("_b")[metric].alias("best_" + metric))
