"""Registered queries: dedup, audits, ids, ordered aggregation (relations)."""
from __future__ import annotations

from pyspark.sql import functions as F

from convgraph.operators import relations as R
from convgraph.plans import standins as S
from convgraph.plans.registry import query, r6

# ---------------------------------------------------------------- W3
@query("dedup_oldest_row", f"""
WITH p AS ({S.RAW_POSTS_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id, source, lang) AS rn FROM p)
SELECT doc_id, source, lang, n_chars FROM r WHERE rn = 1
""")
def dedup_oldest_row(spark, sf):
    """Keep the oldest copy of every text (created_at stands in as doc_id)."""
    p = S.raw_posts(spark, sf)
    first = R.first_per_key(p, ["text"], ["doc_id", "source", "lang"])
    return first.select("doc_id", "source", "lang", "n_chars")


# ---------------------------------------------------------------- A1
@query("dup_key_audit", f"""
WITH p AS ({S.RAW_POSTS_SQL}),
c AS (SELECT doc_id, count(*) AS n_copies FROM p GROUP BY doc_id HAVING count(*) > 1)
SELECT p.doc_id, p.source, p.lang, c.n_copies FROM p JOIN c ON p.doc_id = c.doc_id
""")
def dup_key_audit(spark, sf):
    p = S.raw_posts(spark, sf)
    return R.duplicate_keys(p, ["doc_id"]).select("doc_id", "source", "lang", "n_copies")


# ---------------------------------------------------------------- A2
@query("mismatch_columns", f"""
WITH p AS ({S.RAW_POSTS_SQL}),
k AS (SELECT doc_id, count(*) AS n,
        count(DISTINCT text) + max(CAST(text IS NULL AS INTEGER)) AS d_text,
        count(DISTINCT lang) + max(CAST(lang IS NULL AS INTEGER)) AS d_lang,
        count(DISTINCT source) + max(CAST(source IS NULL AS INTEGER)) AS d_source,
        count(DISTINCT n_chars) + max(CAST(n_chars IS NULL AS INTEGER)) AS d_n_chars
      FROM p GROUP BY doc_id)
SELECT array_to_string(list_filter([CASE WHEN d_text > 1 THEN 'text' END,
                                    CASE WHEN d_lang > 1 THEN 'lang' END,
                                    CASE WHEN d_source > 1 THEN 'source' END,
                                    CASE WHEN d_n_chars > 1 THEN 'n_chars' END], lambda x: x IS NOT NULL), ',')
       AS differing_columns, count(*) AS n_keys
FROM k WHERE n > 1 GROUP BY 1
""")
def mismatch_columns(spark, sf):
    p = S.raw_posts(spark, sf)
    return R.mismatch_patterns(p, ["doc_id"], ["text", "lang", "source", "n_chars"])


# ---------------------------------------------------------------- A3 / A7
@query("set_union_agg", f"""
WITH p AS ({S.RAW_POSTS_SQL}),
t AS (SELECT doc_id, lang, n_chars, source, {S.TOPIC_WORDS_SQL.format(c='text')} AS topics FROM p),
g AS (SELECT doc_id, lang, n_chars, list_sort(list_distinct(list(source))) AS origin_file,
             list_sort(list_distinct(flatten(list(topics)))) AS topics
      FROM t GROUP BY doc_id, lang, n_chars)
SELECT doc_id, lang, n_chars, array_to_string(origin_file, ',') AS origin_files,
       CAST(len(topics) AS INTEGER) AS n_topics, array_to_string(topics, ' ') AS topics
FROM g
""")
def set_union_agg(spark, sf):
    p = S.raw_posts(spark, sf).withColumn("topics", S.topic_words(F.col("text")))
    g = R.collapse_duplicates(p.withColumnRenamed("source", "origin_file"),
                              ["doc_id", "lang", "n_chars"], "origin_file", "topics")
    return g.select("doc_id", "lang", "n_chars",
                    F.array_join("origin_file", ",").alias("origin_files"),
                    F.size("topics").alias("n_topics"),
                    F.array_join("topics", " ").alias("topics"))


# ---------------------------------------------------------------- W1
@query("dense_text_id", """
SELECT doc_id, CAST(dense_rank() OVER (ORDER BY text) - 1 AS BIGINT) AS new_id FROM documents
""")
def dense_text_id(spark, sf):
    d = S.table(spark, sf, "documents").select("doc_id", "text")
    return R.dense_ids(d, ["text"], "new_id").select("doc_id", "new_id")


# ---------------------------------------------------------------- W2 / J4
@query("pseudonymise", """
WITH u AS (SELECT source, lang, 'user' || CAST(dense_rank() OVER (ORDER BY source, lang) - 1 AS VARCHAR) AS a
           FROM (SELECT DISTINCT source, lang FROM documents))
SELECT d.doc_id, d.n_chars, u.a AS anonymised_user_id
FROM documents d LEFT JOIN u ON d.source = u.source AND d.lang = u.lang
""")
def pseudonymise(spark, sf):
    d = S.table(spark, sf, "documents").select("doc_id", "n_chars", "source", "lang")
    return R.pseudonymise(d, "source", "lang").select("doc_id", "n_chars", "anonymised_user_id")


# ---------------------------------------------------------------- A6
_E3_CTX_SQL = f"""
WITH e AS ({S.E3_EDGES_SQL}),
c AS (SELECT DISTINCT e.dst AS new_id, v.ts AS ts, e.src AS cid, v.event_type AS context_text
      FROM e JOIN events v ON e.src = v.event_id)
SELECT new_id, count(*) AS n_context,
       string_agg(context_text, '. ' ORDER BY ts, cid) AS context_text,
       strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_context_at
FROM c GROUP BY new_id
"""


@query("ordered_context_concat", _E3_CTX_SQL)
def ordered_context_concat(spark, sf):
    """Context texts of every reply in time order, joined by '. '."""
    e = S.e3_edges_raw(spark, sf).groupBy("src", "dst").agg(F.max("context_type").alias("context_type"))
    v = S.table(spark, sf, "events").select(F.col("event_id").alias("src"), F.col("ts"),
                                            F.col("event_type").alias("context_text"))
    rel = e.join(v, "src").select(F.col("dst").alias("new_id"), "ts", F.col("src").alias("cid"),
                                  "context_text")
    txt = R.ordered_concat(rel, "new_id", ["ts", "cid"], "context_text", ". ")
    stats = rel.groupBy("new_id").agg(F.count(F.lit(1)).alias("n_context"),
                                      F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
                                      .alias("first_context_at"))
    return stats.join(txt, "new_id")


# ---------------------------------------------------------------- P8 + A14
_REL_SQL = f"""
WITH e AS ({S.E3_EDGES_SQL}),
r AS (SELECT v.event_id AS id, e.src AS context_id, e.context_type,
             CASE WHEN e.context_type = 'quoted' THEN c.event_type END AS context_text
      FROM events v LEFT JOIN e ON v.event_id = e.dst LEFT JOIN events c ON e.src = c.event_id)
"""


def _relationships(spark, sf):
    """One row per (post, context) with empty context kept as NULLs;
    only quoted contexts carry their text (as in the raw payload)."""
    e = S.e3_edges_raw(spark, sf).groupBy("src", "dst").agg(F.max("context_type").alias("context_type"))
    v = S.table(spark, sf, "events")
    ctx = (e.join(v.select(F.col("event_id").alias("src"), F.col("event_type").alias("_t")), "src")
            .select("dst", F.struct(F.col("src").alias("context_id"), "context_type",
                                    F.when(F.col("context_type") == "quoted", F.col("_t")).alias("context_text"))
                    .alias("c"))
            .groupBy("dst").agg(F.collect_list("c").alias("ctx")))
    posts = v.select(F.col("event_id").alias("id")).join(ctx.withColumnRenamed("dst", "id"), "id", "left")
    posts = posts.select("id", F.col("ctx.context_id").alias("context_id"),
                         F.col("ctx.context_type").alias("context_type"),
                         F.col("ctx.context_text").alias("context_text"))
    return R.explode_parallel(posts, ["id"], ["context_id", "context_type", "context_text"])


@query("null_audit", _REL_SQL + """
SELECT 'id' AS "column", count(*) - count(id) AS n_null FROM r
UNION ALL SELECT 'context_id', count(*) - count(context_id) FROM r
UNION ALL SELECT 'context_type', count(*) - count(context_type) FROM r
UNION ALL SELECT 'context_text', count(*) - count(context_text) FROM r
""")
def null_audit(spark, sf):
    return R.null_counts(_relationships(spark, sf))


@query("any_null_audit", _REL_SQL + """
SELECT count(*) FILTER (WHERE id IS NULL OR context_id IS NULL OR context_type IS NULL OR context_text IS NULL) AS n_any_null,
       count(*) AS n_rows FROM r
""")
def any_null_audit(spark, sf):
    return R.rows_with_null(_relationships(spark, sf), ["id", "context_id", "context_type", "context_text"])


# ---------------------------------------------------------------- J1 + A13
@query("completion_rate", _REL_SQL + """
, f AS (SELECT r.*, coalesce(r.context_text, c.event_type) AS filled
        FROM r LEFT JOIN events c ON r.context_id = c.event_id)
SELECT round(count(context_text) / count(context_id), 6) AS rate_before,
       round(count(CASE WHEN context_id IS NOT NULL THEN filled END) / count(context_id), 6) AS rate_after,
       count(context_id) AS n_with_context
FROM f
""")
def completion_rate(spark, sf):
    rel = _relationships(spark, sf)
    posts = S.table(spark, sf, "events")
    done = R.complete_context(rel.withColumn("filled", F.col("context_text")), posts,
                              "context_id", "event_id", {"filled": "event_type"})
    with_ctx = done.filter(F.col("context_id").isNotNull())
    return with_ctx.agg(r6(R.completion_rate(with_ctx, "context_text")).alias("rate_before"),
                        r6(R.completion_rate(with_ctx, "filled")).alias("rate_after"),
                        F.count(F.lit(1)).alias("n_with_context"))


# ---------------------------------------------------------------- A15 / U4
@query("set_overlap", f"""
WITH e AS ({S.E3_EDGES_SQL}), a AS (SELECT DISTINCT src AS k FROM e), b AS (SELECT DISTINCT dst AS k FROM e)
SELECT (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_a,
       (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_b,
       (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS both
""")
def set_overlap(spark, sf):
    e = S.e3_edges_raw(spark, sf).select("src", "dst").distinct()
    return R.set_overlap(e.select(F.col("src").alias("k")), e.select(F.col("dst").alias("k")), "k")


# ---------------------------------------------------------------- A9 + P14
@query("length_histogram", """
SELECT CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS n_words,
       count(*) AS n_rows
FROM documents GROUP BY 1
""")
def length_histogram(spark, sf):
    from convgraph.functions.text import word_count
    d = S.table(spark, sf, "documents").select(word_count("text").alias("n_words"))
    return R.length_histogram(d, "n_words")


# ---------------------------------------------------------------- A10 + A11
@query("summary_percentiles", """
WITH w AS (SELECT len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)
SELECT stat, round(value, 6) AS value FROM (
  SELECT 'mean' AS stat, avg(n) AS value FROM w
  UNION ALL SELECT 'min', CAST(min(n) AS DOUBLE) FROM w
  UNION ALL SELECT 'max', CAST(max(n) AS DOUBLE) FROM w
  UNION ALL SELECT 'count', CAST(count(n) AS DOUBLE) FROM w
  UNION ALL SELECT 'p25', quantile_cont(n, 0.25) FROM w
  UNION ALL SELECT 'p50', quantile_cont(n, 0.5) FROM w
  UNION ALL SELECT 'p75', quantile_cont(n, 0.75) FROM w
  UNION ALL SELECT 'p90', quantile_cont(n, 0.9) FROM w
  UNION ALL SELECT 'p95', quantile_cont(n, 0.95) FROM w
  UNION ALL SELECT 'p99', quantile_cont(n, 0.99) FROM w
  UNION ALL SELECT 'p99_9', quantile_cont(n, 0.999) FROM w
  UNION ALL SELECT 'p99_99', quantile_cont(n, 0.9999) FROM w
  UNION ALL SELECT 'pct_under_5', avg(CAST(n < 5 AS DOUBLE)) * 100 FROM w) s
""")
def summary_percentiles(spark, sf):
    from convgraph.functions.text import word_count
    d = S.table(spark, sf, "documents").select(word_count("text").alias("n"))
    st = R.summary_stats(d, "n")
    under = d.agg(R.share_below("n", 5).alias("value")).select(F.lit("pct_under_5").alias("stat"), "value")
    return st.unionByName(under).select("stat", r6(F.col("value")).alias("value"))


# ---------------------------------------------------------------- the relationships pipeline
# P8 -> J1 (+P10, A13) -> P11 -> P12 -> U1 + A4 -> W1 -> J2 -> A5 -> G1
def _posts_text(col_type, col_value):
    return F.concat(col_type, F.lit(":"), F.floor(col_value / 10).cast("bigint").cast("string"))


def _relationships_no_duplicates(spark, sf):
    ev = S.table(spark, sf, "events")
    posts = ev.select(F.col("event_id").alias("id"), _posts_text(F.col("event_type"), F.col("value")).alias("text"),
                      F.col("ts").alias("created_at"))
    e = S.e3_edges_raw(spark, sf).groupBy("src", "dst").agg(F.max("context_type").alias("context_type"))
    quoted = e.join(posts.toDF("src", "_qt", "_qc"), "src").select(
        F.col("dst").alias("id"), F.col("src").alias("context_id"), "context_type",
        F.when(F.col("context_type") == "quoted", F.col("_qt")).alias("context_text"),
        F.when(F.col("context_type") == "quoted", F.col("_qc")).alias("context_created_at"))
    rel = posts.join(quoted, "id", "left")                                        # one row per (post, context)
    rel = R.complete_context(rel, posts, "context_id", "id",                      # J1 + P10
                             {"context_text": "text", "context_created_at": "created_at"})
    ctx_cols = ["context_id", "context_type", "context_created_at"]
    rel = R.invalidate_when(rel, F.col("context_text").isNull(), ctx_cols)        # P11
    rel = R.invalidate_when(rel, F.col("text") == F.col("context_text"),          # P12 (T4: all four)
                            ctx_cols + ["context_text"])
    ids = R.union_all([rel.select("id", "text", "created_at"),                    # U1
                       rel.select(F.col("context_id").alias("id"), F.col("context_text").alias("text"),
                                  F.col("context_created_at").alias("created_at"))])
    all_ids = ids.dropna(subset=["id", "text"]).groupBy("id", "text").agg(F.min("created_at").alias("created_at"))  # A4
    all_ids = R.dense_ids(all_ids, ["text"], "new_id")                            # W1
    m = all_ids.select("id", "new_id")
    rel = rel.join(m, "id", "left").join(m.toDF("context_id", "context_new_id"), "context_id", "left")  # J2
    return rel.groupBy("new_id", "text", "context_type", "context_new_id", "context_text").agg(        # A5
        F.min("created_at").alias("created_at"), F.min("context_created_at").alias("context_created_at"))


_RELND_SQL = f"""
WITH e AS ({S.E3_EDGES_SQL}),
posts AS (SELECT event_id AS id, event_type || ':' || CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS text,
                 ts AS created_at FROM events),
q AS (SELECT e.dst AS id, e.src AS context_id, e.context_type,
             CASE WHEN e.context_type = 'quoted' THEN p.text END AS context_text,
             CASE WHEN e.context_type = 'quoted' THEN p.created_at END AS context_created_at
      FROM e JOIN posts p ON e.src = p.id),
r0 AS (SELECT p.id, p.text, p.created_at, q.context_id, q.context_type,
              coalesce(q.context_text, c.text) AS context_text, coalesce(q.context_created_at, c.created_at) AS context_created_at
       FROM posts p LEFT JOIN q ON p.id = q.id LEFT JOIN posts c ON q.context_id = c.id),
r1 AS (SELECT DISTINCT id, text, created_at,
              CASE WHEN context_text IS NULL THEN NULL ELSE context_id END AS context_id,
              CASE WHEN context_text IS NULL THEN NULL ELSE context_type END AS context_type,
              context_text,
              CASE WHEN context_text IS NULL THEN NULL ELSE context_created_at END AS context_created_at FROM r0),
r2 AS (SELECT DISTINCT id, text, created_at,
              CASE WHEN text = context_text THEN NULL ELSE context_id END AS context_id,
              CASE WHEN text = context_text THEN NULL ELSE context_type END AS context_type,
              CASE WHEN text = context_text THEN NULL ELSE context_text END AS context_text,
              CASE WHEN text = context_text THEN NULL ELSE context_created_at END AS context_created_at FROM r1),
ai AS (SELECT id, text, min(created_at) AS created_at FROM
         (SELECT id, text, created_at FROM r2 UNION ALL SELECT context_id, context_text, context_created_at FROM r2)
       WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id, text),
ni AS (SELECT id, CAST(dense_rank() OVER (ORDER BY text) - 1 AS BIGINT) AS new_id FROM ai),
rm AS (SELECT r2.*, a.new_id, b.new_id AS context_new_id FROM r2 LEFT JOIN ni a ON r2.id = a.id
       LEFT JOIN ni b ON r2.context_id = b.id),
nd AS (SELECT new_id, text, context_type, context_new_id, context_text, min(created_at) AS created_at,
              min(context_created_at) AS context_created_at FROM rm GROUP BY ALL)
"""


@query("relationships_no_duplicates", _RELND_SQL + """
SELECT new_id, text, context_type, context_new_id, context_text,
       strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at,
       strftime(context_created_at, '%Y-%m-%d %H:%M:%S.%f') AS context_created_at FROM nd
""")
def relationships_no_duplicates(spark, sf):
    r = _relationships_no_duplicates(spark, sf)
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return r.select("new_id", "text", "context_type", "context_new_id", "context_text",
                    F.date_format("created_at", fmt).alias("created_at"),
                    F.date_format("context_created_at", fmt).alias("context_created_at"))


@query("text_graph_edges", _RELND_SQL + """
SELECT context_new_id AS src, new_id AS dst, max(context_type) AS context_type FROM nd
WHERE context_new_id IS NOT NULL AND new_id IS NOT NULL GROUP BY 1, 2
""")
def text_graph_edges(spark, sf):
    """G1 on the text-id graph: context -> reply, parallel edges collapsed."""
    from convgraph.operators.graph import build_edges
    return build_edges(_relationships_no_duplicates(spark, sf), "context_new_id", "new_id", "context_type")
