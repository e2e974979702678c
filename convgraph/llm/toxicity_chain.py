"""Toxicity: classifier chains.

Categories are "toxic and of value v" for the values of a category column
(language here), most frequent first, and last "toxic" at all.  The links of
the chain are linear (logistic) models over word features; every link also
sees the probabilities of the links before it.  In training these earlier
probabilities are out-of-fold predictions, so a link learns from what the
earlier ones say about texts they have not seen.  The rejection threshold is
chosen on the out-of-fold probabilities of the last link.

Features are the distinct words of a text (lower case, letters only) and their
prefixes of 3 to 6 letters.  From a bounded sample of labelled rows (at most
``toxic_rows`` toxic and ``clean_rows`` clean ones, by a hash of the id; of an
id with several texts the one with the smallest hash; equal texts count once) the ``n_features`` features are taken that occur in enough
toxic texts and separate the classes best.  Scoring covers every row and whole
texts; the model is a few hundred numbers.

Defined results: null and empty texts have no features and get the base
probability; rows without a label are scored like all others; null labels are
no labels, of several labels of an id the largest counts; a null category is
the empty string; without both classes in the sample every probability is 0 and
every row stays; an empty table gives an empty one.
"""
from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from convgraph.llm.common import dropped, id_text, stored
from convgraph.llm.pretokens import memo

TOXIC_ROWS, CLEAN_ROWS, N_FEATURES, FOLDS = 4000, 6000, 384, 5
PREFIXES = (3, 4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")


def word_features(chunk: str) -> list[str]:
    """Features of the words in a piece of text without white space."""
    out = []
    for w in _WORD.findall(chunk.lower()):
        out.append(w)
        out += [w[:n] + "*" for n in PREFIXES if len(w) > n]
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None, penalty: float = 1.0,
                 rounds: int = 150) -> np.ndarray:
    """Weights (the last one is the intercept) of an L2-penalised logistic
    model, by accelerated gradient steps of fixed number; ``times``: how often
    each row counts."""
    n = len(y)
    times = np.ones(n) if times is None else times
    x1 = np.hstack([x, np.ones((n, 1), x.dtype)])
    v = np.ones(x1.shape[1]) / np.sqrt(x1.shape[1])
    for _ in range(12):  # largest eigenvalue, for the step
        v = x1.T @ (times * (x1 @ v))
        top = np.linalg.norm(v)
        v /= top
    step = 1.0 / (0.25 * top * 1.05 + penalty)
    ridge = np.full(x1.shape[1], penalty)
    ridge[-1] = 0.0
    w = look = np.zeros(x1.shape[1])
    t = 1.0
    for _ in range(rounds):
        grad = x1.T @ (times * (sigmoid(x1 @ look) - y)) + ridge * look
        new = look - step * grad
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def predict(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(x @ weights[:-1] + weights[-1])


def fit_chain(x: np.ndarray, targets: np.ndarray, fold: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Models of the links and the out-of-fold probabilities (row, link).
    Rows with equal features, targets and fold are fitted as one."""
    _, one, back, times = np.unique(np.hstack([x, targets, fold[:, None]]), axis=0, return_index=True,
                                    return_inverse=True, return_counts=True)
    models, held_out = _fit_links(x[one], targets[one], fold[one], times.astype(float))
    return models, held_out[back.ravel()]


def _fit_links(x, targets, fold, times):
    models, held_out = [], np.zeros(targets.shape)
    for k in range(targets.shape[1]):
        seen = np.hstack([x, held_out[:, :k]])
        for f in np.unique(fold):
            own = fold == f
            held_out[own, k] = predict(fit_logistic(seen[~own], targets[~own, k], times[~own]), seen[own])
        models.append(fit_logistic(seen, targets[:, k], times))
    return models, held_out


def run_chain(models: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(models)))
    for k, w in enumerate(models):
        out[:, k] = predict(w, np.hstack([x, out[:, :k]]))
    return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Middle of the thresholds with the best F1 on held-out probabilities;
    never below one half, so a text goes only if it is more likely toxic."""
    grid = np.arange(0.5, 0.96, 0.01)
    hit = np.array([((p >= g) & (y == 1)).sum() for g in grid])
    called = np.array([(p >= g).sum() for g in grid])
    f1 = 2 * hit / np.maximum(called + y.sum(), 1)
    return float(np.median(grid[f1 >= f1.max() - 1e-12]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        category_col: str = "lang", label_col: str = "toxic", toxic_rows: int = TOXIC_ROWS,
        clean_rows: int = CLEAN_ROWS, n_features: int = N_FEATURES, folds: int = FOLDS) -> dict:
    """{"features", "categories", "models", "threshold"}; see the module text."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")) \
        .dropna().groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = [F.xxhash64("id"), F.col("id")]
    sample = known.where("toxic = 1").orderBy(*order).limit(toxic_rows) \
        .unionByName(known.where("toxic = 0").orderBy(*order).limit(clean_rows))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                        F.coalesce(F.col(category_col).cast("string"), F.lit("")).alias("category"))
    # at most toxic_rows + clean_rows rows: of an id with several texts one
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "category", "toxic")).alias("one")
    rows = texts.join(F.broadcast(sample), "id").groupBy("id").agg(one).select("one.*")

    def extract(batches):
        import hashlib
        import pyarrow as pa
        for batch in batches:
            found = [sorted({f for c in set(t.split()) for f in word_features(c)})
                     for t in batch.column("text").to_pylist()]
            digest = [hashlib.md5(t.encode()).digest() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest, pa.binary()), batch.column("category"), batch.column("toxic"),
                 pa.array(found, pa.list_(pa.string()))], names=["digest", "category", "toxic", "features"])
    sampled = stored(rows.select("text", "category", "toxic").mapInArrow(
        extract, "digest binary, category string, toxic int, features array<string>")
        .dropDuplicates(["digest", "toxic"]), "toxicity-sample")
    sizes = sampled.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in sizes}
    empty = {"features": [], "categories": ["toxic"], "models": [], "threshold": 0.5}
    if not n.get(0) or not n.get(1):
        dropped(sampled)
        return empty
    support = max(3, -(-n[1] // 100)) if n[1] >= 6 else 1
    a, b = F.col("a"), F.col("b")
    rate = (a + 0.5) / (n[1] + 1.0), (b + 0.5) / (n[0] + 1.0)
    chosen = (sampled.select("toxic", F.explode("features").alias("f")).groupBy("f")
              .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(a >= support)
              .withColumn("score", (rate[0] - rate[1]) / F.sqrt(rate[0] + rate[1]))
              .where("score > 0").orderBy(F.desc("score"), "f").limit(n_features).select("f").collect())
    features = sorted(r.f for r in chosen)
    number = {f: i for i, f in enumerate(features)}
    keep = F.array(*[F.lit(f) for f in features]) if features else F.array().cast("array<string>")
    sparse = sampled.select("digest", "category", "toxic", F.array_intersect("features", keep).alias("features")) \
        .orderBy("digest", "toxic").collect()
    dropped(sampled)
    x = np.zeros((len(sparse), len(features)))
    for i, r in enumerate(sparse):
        x[i, [number[f] for f in r.features]] = 1.0
    y = np.array([r.toxic for r in sparse], dtype=float)
    cat = np.array([r.category for r in sparse])
    fold = np.array([r.digest[0] % folds for r in sparse])
    values, times = np.unique(cat, return_counts=True)
    least = max(5, folds)
    names = [v for v in values[np.lexsort((values, -times))]
             if y[cat == v].sum() >= least and (1 - y[cat == v]).sum() >= least]
    targets = np.stack([*[y * (cat == v) for v in names], y], axis=1)
    models, held_out = fit_chain(x, targets, fold)
    return {"features": features, "categories": [f"toxic:{v}" for v in names] + ["toxic"], "models": models,
            "threshold": best_threshold(held_out[:, -1], y)}


def _probabilities(model: dict):
    """A function: texts -> probabilities (row, link), in slices of 1000 texts."""
    features, names, models = (model[k] for k in ("features", "categories", "models"))
    number = {f: i for i, f in enumerate(features)}
    tag = str(hash((tuple(features), tuple(names))))

    def hits(chunk):
        return frozenset(number[f] for f in word_features(chunk) if f in number)

    def run(texts):
        known = memo(f"toxic-{tag}", hits)
        for lo in range(0, len(texts), 1000):
            part = texts[lo:lo + 1000]
            x = np.zeros((len(part), len(features)))
            for i, t in enumerate(part):
                if t and features:
                    on = frozenset().union(*map(known.__getitem__, set(t.split())))
                    if on:
                        x[i, list(on)] = 1.0
            known.trim()
            yield run_chain(models, x) if models else np.zeros((len(part), 1))
    return run


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, toxic_probability, categories, kept) for every row."""
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    names, models, threshold = (model[k] for k in ("categories", "models", "threshold"))
    probabilities = _probabilities(model)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            lo = 0
            for p in probabilities(batch.column(1).to_pylist()):
                last = p[:, -1]
                flat = pa.array(p.ravel())
                keys = pa.array(names * len(p)) if models else pa.array(["toxic"] * len(p))
                cut = pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:lo + len(p)], pa.array(last), pa.MapArray.from_arrays(cut, keys, flat),
                     pa.array(last < threshold)], names=["id", "toxic_probability", "categories", "kept"])
                lo += len(p)
    return rows.mapInArrow(run, f"id {kind}, toxic_probability double, categories map<string,double>, kept boolean") \
        .withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their
    columns.  Each row is judged by its own text, whatever its id is and
    however often it occurs."""
    model = fit(docs, labels, id_col, text_col)
    probabilities, threshold = _probabilities(model), model["threshold"]

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        parts = [p[:, -1] < threshold for p in probabilities(text.tolist())]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0, bool))
    return docs.where(clean(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
