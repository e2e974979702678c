"""Multi-label corpus statistics.

Labels arrive wide (one 0/1 column per label) or long ``(id, label)``.
All statistics are one or two aggregation passes; the label x label tables
they produce are tiny, so windows over them are cheap.
"""
from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def melt_labels(wide: DataFrame, id_col: str, labels: list[str]) -> DataFrame:
    """(id, label) for every label set to 1."""
    return (wide.unpivot([id_col], list(labels), "label", "value")
                .filter(F.col("value") == 1).drop("value"))


# A16
def prevalence(wide: DataFrame, labels: list[str]) -> DataFrame:
    aggs = []
    for l in labels:
        aggs += [F.sum(F.col(l)).cast("long").alias(f"{l}__n"), F.avg(F.col(l)).alias(f"{l}__p")]
    row = wide.agg(*aggs)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(l).alias("label"), F.col(f"{l}__n").alias("n"),
                 (F.col(f"{l}__p") * 100).alias("pct")) for l in labels])).alias("s")).select("s.*")


def _pair_sums(wide: DataFrame, labels: list[str]):
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(F.col(l)).alias(f"_s_{l}") for l in labels]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"_p_{a}__{b}") for a, b in product(labels, labels)]
    return wide.agg(*aggs)


# A17
def correlation(wide: DataFrame, labels: list[str]) -> DataFrame:
    """Pearson correlation of every label pair (long form).  Written out from
    sums so a constant column yields NULL instead of a division error."""
    s = _pair_sums(wide, labels)
    n = F.col("_n")

    def corr(a, b):
        num = n * F.col(f"_p_{a}__{b}") - F.col(f"_s_{a}") * F.col(f"_s_{b}")
        va = n * F.col(f"_p_{a}__{a}") - F.col(f"_s_{a}") * F.col(f"_s_{a}")
        vb = n * F.col(f"_p_{b}__{b}") - F.col(f"_s_{b}") * F.col(f"_s_{b}")
        den = F.sqrt(va.cast("double") * vb.cast("double"))
        return F.when(den > 0, num / den)

    return s.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("label_a"), F.lit(b).alias("label_b"), corr(a, b).alias("corr"))
        for a, b in product(labels, labels)])).alias("s")).select("s.*")


# A18
def cooccurrence(wide: DataFrame, labels: list[str]) -> DataFrame:
    s = _pair_sums(wide, labels)
    return s.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("label_a"), F.lit(b).alias("label_b"),
                 F.col(f"_p_{a}__{b}").cast("long").alias("n")) for a, b in product(labels, labels)]))
        .alias("s")).select("s.*")


# A19
def labels_per_row(wide: DataFrame, labels: list[str]) -> DataFrame:
    k = sum(F.col(l) for l in labels)
    return wide.select(k.alias("n_labels")).groupBy("n_labels").agg(F.count(F.lit(1)).alias("n_rows"))


# A21
def transitions(edges: DataFrame, long_labels: DataFrame) -> DataFrame:
    """Crosstab of (source label, destination label) over edges: absolute,
    percent of all pairs, percent of the source label's row.  Multi-label
    ends fan out (as the reference's merges do); unlabelled ends drop out."""
    lab = long_labels.select("id", "label")
    j = (edges.select("src", "dst")
              .join(lab.toDF("src", "src_label"), "src")
              .join(lab.toDF("dst", "dst_label"), "dst"))
    ct = j.groupBy("src_label", "dst_label").agg(F.count(F.lit(1)).alias("n_pairs"))
    # the crosstab has at most |labels|^2 rows
    tot = F.sum("n_pairs").over(Window.partitionBy())
    row = F.sum("n_pairs").over(Window.partitionBy("src_label"))
    return ct.select("src_label", "dst_label", "n_pairs",
                     (F.col("n_pairs") * 100.0 / tot).alias("pct_all"),
                     (F.col("n_pairs") * 100.0 / row).alias("pct_row"))


# A22
def flagged_reply_share(edges: DataFrame, long_labels: DataFrame, none_label: str) -> DataFrame:
    """Per source label: flagged destinations (sum), labelled destinations
    (count), proportion.  A destination with two labels counts twice (T11)."""
    lab = long_labels.select("id", "label")
    dst = lab.select(F.col("id").alias("dst"), (F.col("label") != none_label).cast("int").alias("flag"))
    j = (edges.select("src", "dst")
              .join(lab.toDF("src", "source_label"), "src")
              .join(dst, "dst", "left"))
    g = j.groupBy("source_label").agg(F.coalesce(F.sum("flag"), F.lit(0)).cast("long").alias("successes"),
                                      F.count("flag").alias("trials"))
    return g.withColumn("proportion", F.try_divide(F.col("successes"), F.col("trials")))


# A28
def one_hot(df: DataFrame, list_col: str, labels: list[str]) -> DataFrame:
    return df.select("*", *[F.array_contains(list_col, l).cast("int").alias(l) for l in labels])


# I5
def cohen_kappa(a: DataFrame, b: DataFrame, id_col: str, labels: list[str]) -> DataFrame:
    """Per label Cohen's kappa of two annotators (inner join on id, J9), and
    the mean over labels with a defined kappa."""
    j = a.select(id_col, *[F.col(l).alias(f"{l}_1") for l in labels]).join(
        b.select(id_col, *[F.col(l).alias(f"{l}_2") for l in labels]), id_col)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for l in labels:
        x, y = F.col(f"{l}_1"), F.col(f"{l}_2")
        aggs += [F.sum((x == y).cast("long")).alias(f"{l}__agree"),
                 F.sum(x).alias(f"{l}__a"), F.sum(y).alias(f"{l}__b")]
    s = j.agg(*aggs)
    n = F.col("_n").cast("double")

    def kappa(l):
        po = F.col(f"{l}__agree") / n
        pa, pb = F.col(f"{l}__a") / n, F.col(f"{l}__b") / n
        pe = pa * pb + (1 - pa) * (1 - pb)
        return F.when(pe < 1, (po - pe) / (1 - pe))

    per = s.select(F.explode(F.array(*[F.struct(F.lit(l).alias("label"), kappa(l).alias("kappa"))
                                       for l in labels])).alias("k")).select("k.*")
    mean = per.agg(F.avg("kappa").alias("kappa")).select(F.lit("mean").alias("label"), "kappa")
    return per.unionByName(mean)


# A33
def balance_by_split(df: DataFrame, split_col: str, labels: list[str]) -> DataFrame:
    g = df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_rows"),
                                  *[(F.avg(l) * 100).alias(l) for l in labels])
    return g
