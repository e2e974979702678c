"""Multi-label text classifiers on MLlib (M7-M9, H5), re-aimed.

The reference fine-tunes transformer models on GPUs; that training loop is
not data work.  What carries over is the shape of the job: one binary
classifier per label (binary relevance) over text features, optionally
concatenated with context text and engineered features, several seeded
runs, selection of the best run by validation macro F1, batch scoring.
MLlib fits distribute over the training rows; the loop over labels and runs
is a loop over a handful of parameters, never over data.
"""
from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convgraph.operators import evaluation as M
from convgraph.session import cut_lineage, release


# M7 / M8
# Parameters of the fit, not of the data: words that share one of the hash
# buckets share a weight, and L-BFGS stops after MAX_ITER steps (converged or
# not).  Raise both for closer fits.
NUM_FEATURES = 1 << 14
MAX_ITER = 20


def count_cols(text_cols: list[str]) -> list[str]:
    return [f"_{c}_tf" for c in text_cols]


def term_counts(df: DataFrame, text_cols: list[str], num_features: int = NUM_FEATURES) -> DataFrame:
    """Hashed term counts of every text column (``count_cols``).  Nothing is
    fitted, so texts are cut into words once for the fit and all splits."""
    for c, tf in zip(text_cols, count_cols(text_cols)):
        df = RegexTokenizer(inputCol=c, outputCol=f"_{c}_tok", pattern=r"\W+", minTokenLength=1).transform(df)
        df = HashingTF(inputCol=f"_{c}_tok", outputCol=tf, numFeatures=num_features).transform(df).drop(f"_{c}_tok")
    return df


def fit_features(train: DataFrame, text_cols: list[str], feature_cols: list[str] | None = None):
    """The TF-IDF (+ feature) pipeline on term counts, fitted on the training rows."""
    vecs = [f"_{c}_tfidf" for c in text_cols]
    stages = [IDF(inputCol=tf, outputCol=v) for tf, v in zip(count_cols(text_cols), vecs)]
    stages.append(VectorAssembler(inputCols=vecs + (feature_cols or []), outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages).fit(train)


def fit_labels(x: DataFrame, id_col: str, labels: list[str], reg: float = 0.01, seed: int = 0,
               max_iter: int = MAX_ITER) -> dict:
    """One logistic regression per label on featurized rows.  The seed draws a
    weight of 1, 2 or 3 for every row from a hash of (seed, id): all rows
    count, and runs of different seeds are different fits."""
    w = x.withColumn("_w", (1 + F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(3))).cast("double"))
    models = {}
    for lab in labels:
        lr = LogisticRegression(featuresCol="features", labelCol=lab, weightCol="_w", regParam=reg, maxIter=max_iter,
                                predictionCol=f"pred_{lab}", probabilityCol=f"prob_{lab}",
                                rawPredictionCol=f"raw_{lab}")
        models[lab] = lr.fit(w)
    return models


def featurized(feats, df: DataFrame, id_col: str, labels: list[str], keep: list[str] | None = None) -> DataFrame:
    """(id, kept columns, features, 0/1 labels as doubles), written once for all readers."""
    return cut_lineage(feats.transform(df).select(id_col, *(keep or []), "features",
                                                  *[F.col(l).cast("double").alias(l) for l in labels]))


# M9
def score(models: dict, x: DataFrame, id_col: str, labels: list[str], keep: list[str] | None = None) -> DataFrame:
    """Batch scoring of featurized rows: truth, logit and 0/1 prediction per
    label (wide)."""
    out = x
    for lab, m in models.items():
        out = m.transform(out)
        out = out.withColumn(f"logit_{lab}", vector_to_array(F.col(f"raw_{lab}"))[1]) \
                 .drop(f"raw_{lab}", f"prob_{lab}")
    return out.select(id_col, *(keep or []), *[F.col(l).cast("int").alias(l) for l in labels],
                      *[f"logit_{l}" for l in labels],
                      *[F.col(f"pred_{l}").cast("int").alias(f"pred_{l}") for l in labels])


def evaluate(scored: DataFrame, id_col: str, labels: list[str]) -> DataFrame:
    long = M.long_predictions(scored, id_col, labels)
    return M.macro_metrics(long, id_col)


# H5 + W7-style selection
def seeded_runs(train: DataFrame, val: DataFrame, test: DataFrame, id_col: str, labels: list[str],
                text_cols: list[str], feature_cols: list[str] | None = None, n_runs: int = 3,
                base_seed: int = 42, reg: float = 0.1) -> DataFrame:
    """Several runs (seed = base + run) over splits with term counts; per run
    the validation and test macro metrics.  The best run by validation F1 is
    flagged.  Features are fitted and computed once; each split is scored once
    per run."""
    feats = fit_features(train, text_cols, feature_cols)
    x = {k: featurized(feats, df, id_col, labels) for k, df in (("train", train), ("val", val), ("test", test))}
    rows = None
    for run in range(1, n_runs + 1):
        models = fit_labels(x["train"], id_col, labels, reg, base_seed + run)
        v = evaluate(score(models, x["val"], id_col, labels), id_col, labels)
        t = evaluate(score(models, x["test"], id_col, labels), id_col, labels)
        r = v.select(*[F.col(c).alias("val_" + c) for c in v.columns]).crossJoin(
            t.select(*[F.col(c).alias("test_" + c) for c in t.columns])) \
             .select(F.lit(run).alias("run"), F.lit(base_seed + run).alias("seed"), "*")
        rows = r if rows is None else rows.unionByName(r)
    rows = cut_lineage(rows)  # one row per run; read twice
    for df in x.values():
        release(df)
    best = rows.agg(F.max_by("run", F.struct("val_f1", -F.col("run"))).alias("_best"))
    return rows.crossJoin(best).withColumn("is_best", F.col("run") == F.col("_best")).drop("_best")
