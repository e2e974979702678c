"""Run-result tables: metric-tree scans, path flags, summaries, retention
(S10, S11, P17-P19, X21, A34-A36, W8-W10, M12)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS_SCHEMA = T.StructType([
    T.StructField("f1", T.DoubleType()), T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()), T.StructField("accuracy", T.DoubleType()),
    T.StructField("test_f1", T.DoubleType()), T.StructField("test_precision", T.DoubleType()),
    T.StructField("test_recall", T.DoubleType()), T.StructField("test_accuracy", T.DoubleType()),
])

# --- fixed values: path substrings turned into flags (two are case-sensitive)
FOLDED_FLAGS = {"context": "context", "hashtags": "hashtags", "mentions": "mentions", "emojis": "emojis"}
CASED_FLAGS = {"pos": ["POS"], "sentiment_scores": ["VADER", "VAD"], "fc_after_features": ["fc_features"],
               "modified_class_head": ["modified_class_head"], "dropout_between_fc": ["dropout_between_fc"]}
# --------------------------------------------------------------------------


# S10
def read_metrics_tree(spark: SparkSession, base: str, name: str = "test_metrics.json") -> DataFrame:
    """``<base>/<model>/<run>/test_metrics.json`` -> one row per file with the
    model and run taken from the path (multiLine JSON objects)."""
    df = (spark.read.schema(METRICS_SCHEMA).option("multiLine", True).json(f"{base}/*/*/{name}")
               .withColumn("_path", F.col("_metadata.file_path")))
    parts = F.split(F.col("_path"), "/")
    return df.withColumn("model_dir", F.element_at(parts, -3)).withColumn("run", F.element_at(parts, -2)).drop("_path")


# S11
def read_metrics_flat(spark: SparkSession, base: str, name: str = "test_metrics.json") -> DataFrame:
    df = (spark.read.schema(METRICS_SCHEMA).option("multiLine", True).json(f"{base}/*/{name}")
               .withColumn("_path", F.col("_metadata.file_path")))
    return df.withColumn("run_name", F.element_at(F.split(F.col("_path"), "/"), -2)).drop("_path")


# P19
def metric_fallback(primary: str, fallback: str) -> Column:
    """``get(primary) or get(fallback)`` * 100: NULL and 0.0 fall through."""
    return F.coalesce(F.nullif(F.col(primary), F.lit(0.0)), F.col(fallback)) * 100


# P18
def path_flags(col: str) -> list[Column]:
    c = F.col(col)
    out = [F.contains(F.lower(c), F.lit(v)).alias(k) for k, v in FOLDED_FLAGS.items()]
    for k, subs in CASED_FLAGS.items():
        cond = None
        for s in subs:
            cond = F.contains(c, F.lit(s)) if cond is None else cond | F.contains(c, F.lit(s))
        out.append(cond.alias(k))
    return out


# P17
def include_exclude(col: str, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    cond = F.lit(True)
    if include:
        cond = cond & F.col(col).rlike("|".join(include))
    if exclude:
        cond = cond & ~F.col(col).rlike("|".join(exclude))
    return cond


# A34
def model_summary(raw: DataFrame, flags: list[str]) -> DataFrame:
    """Per model directory: mean and sample std of F1, means of the other
    metrics, first of each flag; half-even rounding to 2 places as pandas."""
    g = raw.groupBy("model_dir").agg(
        F.avg("test_f1").alias("test_f1"), F.stddev_samp("test_f1").alias("std_test_f1"),
        F.avg("test_precision").alias("test_precision"), F.avg("test_recall").alias("test_recall"),
        F.avg("test_accuracy").alias("test_accuracy"), *[F.first(f).alias(f) for f in flags])
    num = ["test_f1", "std_test_f1", "test_precision", "test_recall", "test_accuracy"]
    return g.select("model_dir", *[F.bround(F.col(c), 2).alias(c) for c in num], *flags)


# A35
def prompt_epoch_means(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean of every metric and number of runs per (prompt_type, epochs), the
    highest first metric on top; runs without a parsed name drop."""
    return runs.filter(F.col("prompt_type").isNotNull()).groupBy("prompt_type", "epochs") \
        .agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n_runs")) \
        .orderBy(F.col(metrics[0]).desc(), "prompt_type", "epochs")


# A36
def mean_by_flag(summary: DataFrame, flag: str, metric: str = "test_f1") -> DataFrame:
    return summary.groupBy(flag).agg(F.avg(metric).alias("mean_" + metric))


# W8
def best_model_then_run(raw: DataFrame, metric: str = "test_f1") -> DataFrame:
    """The model with the highest mean metric, then its best run: two
    aggregates (max_by), no sort of the whole table."""
    per_model = raw.groupBy("model_dir").agg(F.avg(metric).alias("_m"))
    best = per_model.agg(F.max_by("model_dir", F.struct("_m", F.col("model_dir"))).alias("model_dir"))
    runs = raw.join(best, "model_dir")
    return runs.groupBy("model_dir").agg(F.max_by("run", F.struct(F.col(metric), F.col("run"))).alias("run"),
                                         F.max(metric).alias(metric))


# W9
def keep_latest(runs: DataFrame, name: str, created: str, id_col: str,
                purge_patterns: list[str] | None = None) -> DataFrame:
    """Retention: per name keep the newest run (ties: larger id), report how
    many runs go; names matching a purge pattern keep nothing, so all of their
    runs are counted and the kept columns are NULL."""
    purged = F.col(name).rlike("|".join(purge_patterns)) if purge_patterns else F.lit(False)
    return runs.groupBy(name).agg(F.max(F.struct(F.col(created), F.col(id_col))).alias("_k"),
                                  F.count(F.lit(1)).alias("_n")) \
               .select(name, F.when(~purged, F.col("_k")[id_col]).alias("kept_id"),
                       F.when(~purged, F.col("_k")[created]).alias("kept_created"),
                       (F.col("_n") - F.when(purged, 0).otherwise(1)).alias("n_deleted"))


# W10
def older_than(name_col: str, cutoff: str, pattern: str = r"(\d{4}-\d{2}-\d{2})") -> Column:
    """True when the date embedded in the name is before ``cutoff``; NULL for
    a name without a date."""
    d = F.try_to_date(F.nullif(F.regexp_extract(F.col(name_col), pattern, 1), F.lit("")), "yyyy-MM-dd")
    return d < F.to_date(F.lit(cutoff))
