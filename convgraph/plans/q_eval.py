"""Registered queries: multi-label evaluation, curves, BLEU, training history."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from convgraph.operators import evaluation as M
from convgraph.plans import standins as S
from convgraph.plans.registry import query, r6

LAB = S.LABELS

_LONG_SQL = f"""
WITH pr AS ({S.predictions_sql()}),
lp AS ({" UNION ALL ".join(f"SELECT id, '{l}' AS label, CAST({l} AS INTEGER) AS y, logit_{l} AS logit FROM pr" for l in LAB)}),
lq AS (SELECT *, 1.0 / (1.0 + exp(-logit)) AS score,
              CASE WHEN 1.0 / (1.0 + exp(-logit)) >= 0.5 THEN 1 ELSE 0 END AS pred FROM lp),
cf AS (SELECT label, sum(y * pred) AS tp, sum((1 - y) * pred) AS fp, sum(y * (1 - pred)) AS fn, sum(y) AS support
       FROM lq GROUP BY label),
pl AS (SELECT label, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
              CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
              CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1,
              CAST(support AS BIGINT) AS support FROM cf)
"""


def _long(spark, sf):
    return M.long_predictions(S.predictions(spark, sf), "id", LAB)


# ---------------------------------------------------------------- M1
@query("threshold_logits", _LONG_SQL + """
SELECT id, CAST(sum(pred) AS BIGINT) AS n_pred,
       coalesce(string_agg(label, '|' ORDER BY label) FILTER (WHERE pred = 1), '') AS predicted
FROM lq GROUP BY id
""")
def threshold_logits(spark, sf):
    lg = _long(spark, sf)
    return lg.groupBy("id").agg(
        F.sum("pred").cast("long").alias("n_pred"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("pred") == 1, F.col("label")))), "|").alias("predicted"))


# ---------------------------------------------------------------- M2
@query("macro_metrics", _LONG_SQL + """
, acc AS (SELECT avg(e) AS accuracy FROM (SELECT id, min(CAST(y = pred AS INTEGER)) AS e FROM lq GROUP BY id))
SELECT round(avg(f1), 6) AS f1, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
       round(any_value(accuracy), 6) AS accuracy FROM pl CROSS JOIN acc
""")
def macro_metrics(spark, sf):
    m = M.macro_metrics(_long(spark, sf), "id")
    return m.select(*[r6(F.col(c)).alias(c) for c in ["f1", "precision", "recall", "accuracy"]])


# ---------------------------------------------------------------- M3
@query("classification_report", _LONG_SQL + """
, rw AS (SELECT id, sum(y * pred) AS i, sum(y) AS t, sum(pred) AS p FROM lq GROUP BY id),
allrows AS (
  SELECT label, precision, recall, f1, support FROM pl
  UNION ALL
  SELECT 'micro avg', CASE WHEN sum(tp) + sum(fp) > 0 THEN sum(tp) / (sum(tp) + sum(fp)) ELSE 0.0 END,
         CASE WHEN sum(tp) + sum(fn) > 0 THEN sum(tp) / (sum(tp) + sum(fn)) ELSE 0.0 END,
         CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) > 0 THEN 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) ELSE 0.0 END,
         CAST(sum(support) AS BIGINT) FROM cf
  UNION ALL
  SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM pl
  UNION ALL
  SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
         sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM pl
  UNION ALL
  SELECT 'samples avg', avg(CASE WHEN p > 0 THEN i / p ELSE 0.0 END), avg(CASE WHEN t > 0 THEN i / t ELSE 0.0 END),
         avg(CASE WHEN t + p > 0 THEN 2 * i / (t + p) ELSE 0.0 END), CAST(sum(t) AS BIGINT) FROM rw)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM allrows
""")
def classification_report(spark, sf):
    r = M.classification_report(_long(spark, sf), "id")
    return r.select("label", *[r6(F.col(c)).alias(c) for c in ["precision", "recall", "f1"]], "support")


# ---------------------------------------------------------------- M4
@query("bce_loss", _LONG_SQL + """
SELECT round(avg(greatest(logit, 0.0) - logit * y + ln(1 + exp(-abs(logit)))), 6) AS bce_loss FROM lq
""")
def bce_loss(spark, sf):
    return M.bce_with_logits(_long(spark, sf)).select(r6(F.col("bce_loss")).alias("bce_loss"))


@query("bce_batch_means", _LONG_SQL + """
, b AS (SELECT (dense_rank() OVER (ORDER BY id) - 1) // 16 AS batch, greatest(logit, 0.0) - logit * y + ln(1 + exp(-abs(logit))) AS loss FROM lq),
m AS (SELECT batch, avg(loss) AS mean FROM b GROUP BY batch)
SELECT count(*) AS n_batches, round(avg(mean), 6) AS bce_loss FROM m
""")
def bce_batch_means(spark, sf):
    return M.bce_batch_means(_long(spark, sf), "id", 16).select("n_batches", r6(F.col("bce_loss")).alias("bce_loss"))


_HIST_SQL = _LONG_SQL + """
, h AS (SELECT label, score, sum(y) AS pos, sum(1 - y) AS neg FROM lq GROUP BY label, score),
c AS (SELECT label, score, pos, neg,
             sum(pos) OVER (PARTITION BY label ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cpos,
             sum(neg) OVER (PARTITION BY label ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cneg,
             sum(pos) OVER (PARTITION BY label) AS P, sum(neg) OVER (PARTITION BY label) AS N FROM h)
"""


# ---------------------------------------------------------------- M5
@query("roc_auc", _HIST_SQL + """
SELECT label, round(CASE WHEN any_value(P) > 0 AND any_value(N) > 0
                         THEN sum(neg * (2 * cpos - pos) / 2.0) / (any_value(P) * any_value(N)) END, 6) AS auc
FROM c GROUP BY label
""")
def roc_auc(spark, sf):
    return M.roc_auc(_long(spark, sf)).select("label", r6(F.col("auc")).alias("auc"))


@query("roc_curve", _HIST_SQL + """
SELECT label, round(score, 6) AS threshold, round(CASE WHEN N > 0 THEN cneg / N END, 6) AS fpr,
       round(CASE WHEN P > 0 THEN cpos / P END, 6) AS tpr FROM c
""")
def roc_curve(spark, sf):
    return M.roc_curve(_long(spark, sf)).select("label", *[r6(F.col(c)).alias(c) for c in ["threshold", "fpr", "tpr"]])


# ---------------------------------------------------------------- M6
@query("precision_recall_curve", _HIST_SQL + """
SELECT label, round(score, 6) AS threshold, round(cpos / (cpos + cneg), 6) AS "precision",
       round(CASE WHEN P > 0 THEN cpos / P END, 6) AS recall FROM c
""")
def precision_recall_curve(spark, sf):
    return M.precision_recall_curve(_long(spark, sf)) \
        .select("label", *[r6(F.col(c)).alias(c) for c in ["threshold", "precision", "recall"]])


@query("average_precision", _HIST_SQL + """
SELECT label, round(sum(CASE WHEN P > 0 THEN (pos / P) * (cpos / (cpos + cneg)) END), 6) AS average_precision
FROM c GROUP BY label
""")
def average_precision(spark, sf):
    ap = M.average_precision(_long(spark, sf))
    return ap.select("label", r6(F.col("average_precision")).alias("average_precision"))


# ---------------------------------------------------------------- M10
def _tok_sql(c):
    for pattern, to in M.TOKENIZER_13A:
        if pattern == "^|$":
            c = f"(' ' || {c} || ' ')"
        else:
            to = re.sub(r"\$(\d)", r"\\\1", to)
            c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda x: x <> '')"


@query("corpus_bleu", f"""
WITH pairs AS (SELECT a.conv_id * 1000 + a.turn AS id, a.text AS hyp, u.text AS ref
               FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND u.turn = a.turn - 1
               WHERE a.role = 'assistant'),
t AS (SELECT id, {_tok_sql('hyp')} AS h, {_tok_sql('ref')} AS r FROM pairs),
ns AS (SELECT unnest([1, 2, 3, 4]) AS n),
hg AS (SELECT id, n, array_to_string(h[i:i + n - 1], ' ') AS g
       FROM (SELECT id, n, h, unnest(generate_series(1, len(h) - n + 1)) AS i FROM t CROSS JOIN ns)),
rg AS (SELECT id, n, array_to_string(r[i:i + n - 1], ' ') AS g
       FROM (SELECT id, n, r, unnest(generate_series(1, len(r) - n + 1)) AS i FROM t CROSS JOIN ns)),
hc AS (SELECT id, n, g, count(*) AS hc FROM hg GROUP BY ALL),
rc AS (SELECT id, n, g, count(*) AS rc FROM rg GROUP BY ALL),
m AS (SELECT ns.n, coalesce(sum(least(hc.hc, coalesce(rc.rc, 0))), 0) AS c, coalesce(sum(hc.hc), 0) AS tt
      FROM ns LEFT JOIN hc ON hc.n = ns.n LEFT JOIN rc ON hc.id = rc.id AND hc.n = rc.n AND hc.g = rc.g GROUP BY ns.n),
k AS (SELECT n, c, tt, sum(CASE WHEN c = 0 THEN 1 ELSE 0 END) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING) AS k FROM m),
lp AS (SELECT sum(ln(CASE WHEN c > 0 THEN c / tt ELSE 1.0 / (pow(2.0, k) * tt) END)) AS s FROM k),
ln_ AS (SELECT sum(len(h)) AS sys_len, sum(len(r)) AS ref_len, avg(len(h)) AS gen_len FROM t)
SELECT round(CASE WHEN sys_len >= ref_len THEN 1.0 ELSE exp(1 - ref_len / sys_len) END * exp(s / 4) * 100, 6) AS bleu,
       round(gen_len, 6) AS gen_len
FROM lp CROSS JOIN ln_
""")
def corpus_bleu(spark, sf):
    c = S.table(spark, sf, "conversations")
    a = c.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("hyp"))
    u = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("ref"))
    pairs = a.join(u, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "hyp", "ref")
    b = M.corpus_bleu(pairs, "id", "hyp", "ref")
    return b.select(r6(F.col("bleu")).alias("bleu"), r6(F.col("gen_len")).alias("gen_len"))


# ---------------------------------------------------------------- M11
@query("training_history", f"""
WITH h AS ({S.RUN_HISTORY_SQL})
SELECT model, run, CAST(epoch AS BIGINT) AS epoch, 'val_f1' AS metric, round(val_f1, 6) AS value FROM h
UNION ALL SELECT model, run, CAST(epoch AS BIGINT), 'n', CAST(n AS DOUBLE) FROM h
""")
def training_history(spark, sf):
    h = S.run_history(spark, sf).select("model", "run", F.col("epoch").cast("long").alias("epoch"),
                                        r6(F.col("val_f1")).alias("val_f1"), F.col("n").cast("double").alias("n"))
    return h.unpivot(["model", "run", "epoch"], ["val_f1", "n"], "metric", "value")


# ---------------------------------------------------------------- W7
@query("best_epoch", f"""
WITH h AS ({S.RUN_HISTORY_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY model, run ORDER BY val_f1 DESC, epoch) AS rn FROM h)
SELECT model, run, CAST(epoch AS BIGINT) AS best_epoch, round(val_f1, 6) AS best_val_f1 FROM r WHERE rn = 1
""")
def best_epoch(spark, sf):
    b = M.best_epoch(S.run_history(spark, sf), ["model", "run"], "epoch", "val_f1")
    return b.select("model", "run", F.col("best_epoch").cast("long").alias("best_epoch"),
                    r6(F.col("best_val_f1")).alias("best_val_f1"))
