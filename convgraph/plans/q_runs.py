"""Registered queries: run-metric roll-ups, model comparison, retention."""
from __future__ import annotations

from pyspark.sql import functions as F

from convgraph.functions import text as X
from convgraph.operators import runs as RU
from convgraph.plans import standins as S
from convgraph.plans.registry import query, r6
from convgraph.session import scratch_path

_FLAGS = list(RU.FOLDED_FLAGS) + list(RU.CASED_FLAGS)


def _raw(spark, sf):
    """S10-shaped raw table: one metrics record per (model_dir, run); the
    'test_' keys are absent, so the fallback (P19) takes the plain keys."""
    m = S.run_metrics(spark, sf)
    m = m.select("model_dir", "run", "f1", "precision", "recall", "accuracy",
                 *[F.lit(None).cast("double").alias("test_" + k) for k in ["f1", "precision", "recall", "accuracy"]])
    return m.select("model_dir", "run",
                    *[RU.metric_fallback("test_" + k, k).alias("test_" + k) for k in ["f1", "precision", "recall", "accuracy"]],
                    *RU.path_flags("model_dir"))


_FLAG_SQL = ", ".join(
    [f"contains(lower(model_dir), '{v}') AS {k}" for k, v in RU.FOLDED_FLAGS.items()] +
    [f"({' OR '.join(f'contains(model_dir, {chr(39)}{s}{chr(39)})' for s in subs)}) AS {k}"
     for k, subs in RU.CASED_FLAGS.items()])
_RAW_SQL = f"""
WITH m AS ({S.RUN_METRICS_SQL}),
raw AS (SELECT model_dir, run, f1 * 100 AS test_f1, precision * 100 AS test_precision, recall * 100 AS test_recall,
               accuracy * 100 AS test_accuracy, {_FLAG_SQL} FROM m),
sm AS (SELECT model_dir, round_even(avg(test_f1), 2) AS test_f1, round_even(stddev_samp(test_f1), 2) AS std_test_f1,
              round_even(avg(test_precision), 2) AS test_precision, round_even(avg(test_recall), 2) AS test_recall,
              round_even(avg(test_accuracy), 2) AS test_accuracy,
              {", ".join(f"first({f}) AS {f}" for f in _FLAGS)}
       FROM raw GROUP BY model_dir)
"""


def _summary(spark, sf):
    return RU.model_summary(_raw(spark, sf), _FLAGS)


# ---------------------------------------------------------------- A34 + P18 + P19
@query("model_summary", _RAW_SQL + " SELECT * FROM sm")
def model_summary(spark, sf):
    return _summary(spark, sf)


# ---------------------------------------------------------------- A36
@query("flag_mean", _RAW_SQL + " SELECT context, round(avg(test_f1), 6) AS mean_test_f1 FROM sm GROUP BY context")
def flag_mean(spark, sf):
    m = RU.mean_by_flag(_summary(spark, sf), "context")
    return m.select("context", r6(F.col("mean_test_f1")).alias("mean_test_f1"))


# ---------------------------------------------------------------- M12 + P17
@query("ablation", _RAW_SQL + """
SELECT model_dir, test_f1, std_test_f1, context, sentiment_scores, pos FROM sm
WHERE regexp_matches(model_dir, 'encoder-a|encoder-b') AND NOT regexp_matches(model_dir, 'POS')
""")
def ablation(spark, sf):
    s = _summary(spark, sf)
    return s.filter(RU.include_exclude("model_dir", ["encoder-a", "encoder-b"], ["POS"])) \
            .select("model_dir", "test_f1", "std_test_f1", "context", "sentiment_scores", "pos")


# ---------------------------------------------------------------- W8
@query("best_run", _RAW_SQL + """
, bm AS (SELECT model_dir FROM raw GROUP BY model_dir ORDER BY avg(test_f1) DESC, model_dir DESC LIMIT 1)
SELECT raw.model_dir, arg_max(run, (test_f1, run)) AS run, round(max(test_f1), 6) AS test_f1
FROM raw JOIN bm ON raw.model_dir = bm.model_dir GROUP BY raw.model_dir
""")
def best_run(spark, sf):
    b = RU.best_model_then_run(_raw(spark, sf))
    return b.select("model_dir", "run", r6(F.col("test_f1")).alias("test_f1"))


# ---------------------------------------------------------------- W9
@query("keep_latest", """
WITH r AS (SELECT o_orderpriority AS name, o_orderdate AS created, o_orderkey AS id FROM orders),
k AS (SELECT name, arg_max(id, (created, id)) AS kept_id, max(created) AS kept_created, count(*) AS n,
             regexp_matches(name, 'LOW') AS purged FROM r GROUP BY name)
SELECT name, CASE WHEN NOT purged THEN kept_id END AS kept_id,
       CASE WHEN NOT purged THEN strftime(kept_created, '%Y-%m-%d %H:%M:%S') END AS kept_created,
       CASE WHEN purged THEN n ELSE n - 1 END AS n_deleted FROM k
""")
def keep_latest(spark, sf):
    o = S.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("name"),
                                            F.col("o_orderdate").alias("created"), F.col("o_orderkey").alias("id"))
    k = RU.keep_latest(o, "name", "created", "id", ["LOW"])
    return k.select("name", "kept_id", F.date_format("kept_created", "yyyy-MM-dd HH:mm:ss").alias("kept_created"),
                    "n_deleted")


# ---------------------------------------------------------------- W10
@query("purge_before_date", """
WITH r AS (SELECT 'run-' || strftime(o_orderdate, '%Y-%m-%d') || '-' || CAST(o_orderkey AS VARCHAR) AS name,
                  o_orderstatus FROM orders)
SELECT o_orderstatus, count(*) FILTER (WHERE CAST(regexp_extract(name, '(\\d{4}-\\d{2}-\\d{2})', 1) AS DATE) < DATE '1998-01-01') AS n_purged,
       count(*) FILTER (WHERE NOT (CAST(regexp_extract(name, '(\\d{4}-\\d{2}-\\d{2})', 1) AS DATE) < DATE '1998-01-01')) AS n_kept
FROM r GROUP BY o_orderstatus
""")
def purge_before_date(spark, sf):
    o = S.table(spark, sf, "orders").select(
        F.concat(F.lit("run-"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-"),
                 F.col("o_orderkey").cast("string")).alias("name"), "o_orderstatus")
    old = RU.older_than("name", "1998-01-01")
    return o.groupBy("o_orderstatus").agg(F.count_if(old).alias("n_purged"), F.count_if(~old).alias("n_kept"))


# ---------------------------------------------------------------- X21 + X22 + S11 + A35
_PROMPTS = ["zero_shot", "with_definition", "with_example"]     # own stand-in names, with underscores as in real ones
_METRICS = ["f1", "precision", "recall", "accuracy"]
_RUN_METRIC_SQL = """
WITH r AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'zero_shot' WHEN 'O' THEN 'with_definition' ELSE 'with_example' END AS prompt,
                  month(o_orderdate) * 10 AS epochs, o_custkey % 3 AS seed, o_totalprice AS p FROM orders),
m AS (SELECT prompt, epochs, seed, avg(p) / 1e6 AS f1, min(p) / 1e6 AS "precision", max(p) / 1e6 AS recall,
             count(*) / 1e4 AS accuracy FROM r GROUP BY ALL)
"""


def _written_runs(spark, sf):
    """One metrics file per run directory in the shared folder, written from
    the orders table; directories of another form stand beside them."""
    o = S.table(spark, sf, "orders")
    prompt = F.when(F.col("o_orderstatus") == "F", _PROMPTS[0]).when(F.col("o_orderstatus") == "O", _PROMPTS[1]) \
        .otherwise(_PROMPTS[2])
    p = F.col("o_totalprice")
    runs = o.groupBy(prompt.alias("prompt"), (F.month("o_orderdate") * 10).alias("epochs"),
                     (F.col("o_custkey") % 3).alias("seed")) \
        .agg((F.avg(p) / 1e6).alias("f1"), (F.min(p) / 1e6).alias("precision"), (F.max(p) / 1e6).alias("recall"),
             (F.count(F.lit(1)) / 1e4).alias("accuracy"))
    name = X.run_name(F.lit("t5-large"), F.lit("prompt_type"), "prompt", F.lit("epochs"),
                      F.col("epochs").cast("string"), F.lit("seed"), F.col("seed").cast("string"))
    rows = runs.select(name.alias("run_name"), *_METRICS)
    rows = rows.unionByName(rows.withColumn("run_name", F.concat(F.lit("other_"), F.col("run_name"))))
    path = scratch_path(spark, "runs")
    rows.select("run_name", F.to_json(F.struct(*_METRICS)).alias("value")) \
        .write.partitionBy("run_name").text(path)
    return path


@query("prompt_epoch_means", _RUN_METRIC_SQL + """
SELECT prompt AS prompt_type, epochs, round(avg(f1), 6) AS f1, round(avg("precision"), 6) AS "precision",
       round(avg(recall), 6) AS recall, round(avg(accuracy), 6) AS accuracy, count(*) AS n_runs FROM m GROUP BY ALL
""")
def prompt_epoch_means(spark, sf):
    """Metrics files read back one per run directory (S11), names parsed (X21;
    directories of another form drop), means per prompt type and epochs (A35),
    best F1 first."""
    raw = RU.read_metrics_flat(spark, _written_runs(spark, sf), "*.txt")
    raw = raw.withColumn("run_name", F.regexp_replace("run_name", "^run_name=", ""))
    prompt, epochs, _seed = X.parse_run_name("run_name")
    means = RU.prompt_epoch_means(raw.select(prompt.alias("prompt_type"), epochs.alias("epochs"), *_METRICS), _METRICS)
    return means.select("prompt_type", F.col("epochs").cast("long").alias("epochs"),
                        *[r6(F.col(m)).alias(m) for m in _METRICS], "n_runs")
