"""Registered queries over sources and sinks: files and raw records are built
from the driver tables in the shared folder, written by the sinks and read
back by the sources."""
from __future__ import annotations

from pyspark.sql import functions as F

from convgraph.functions import text as X
from convgraph.operators import features as FT
from convgraph.operators import relations as R
from convgraph.operators import runs as RU
from convgraph.plans import standins as S
from convgraph.plans.registry import query, r6
from convgraph.session import scratch_path
from convgraph.sources import io as SIO
from convgraph.sources import posts as P
from convgraph.sources.archives import write_archives


# ---------------------------------------------------------------- S12 + S4
@query("csv_roundtrip", """
SELECT doc_id, lang, md5(text) AS text_md5, n_chars FROM documents
""")
def csv_roundtrip(spark, sf):
    """Three CSV splits written and read back, quotes and line breaks inside
    the texts included."""
    d = S.table(spark, sf, "documents").select("doc_id", "lang", "text", "n_chars")
    base = scratch_path(spark, "csv")
    split = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    paths = []
    for i, name in enumerate(["train", "val", "test"]):
        paths.append(f"{base}/{name}")
        SIO.write_csv(d.filter(split == i), paths[-1])
    back = SIO.read_split_csvs(spark, paths, "doc_id long, lang string, text string, n_chars long")
    return back.select("doc_id", "lang", F.md5("text").alias("text_md5"), "n_chars")


# ---------------------------------------------------------------- S8
@query("jsonl_roundtrip", """
SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations
""")
def jsonl_roundtrip(spark, sf):
    c = S.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    path = scratch_path(spark, "jsonl")
    SIO.write_jsonl(c, path, "gzip")
    back = SIO.read_jsonl(spark, path, "conv_id long, turn long, role string, text string")
    return back.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


# ---------------------------------------------------------------- S9
@query("lexicon_file", """
WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents)
           WHERE length(word) >= 3)
SELECT word, round((length(word) % 10) / 10.0 + ascii(word) / 1000.0, 6) AS valence,
       round((ascii(right(word, 1)) - 97) / 26.0, 6) AS arousal, round((length(word) % 7) / 7.0, 6) AS dominance FROM w
""")
def lexicon_file(spark, sf):
    lex = FT.word_lexicon(S.table(spark, sf, "documents"), "text")
    path = scratch_path(spark, "lexicon")
    lex.write.option("sep", "\t").csv(path)
    back = SIO.read_lexicon(spark, path)
    return back.select("word", *[r6(F.col(c)).alias(c) for c in ["valence", "arousal", "dominance"]])


# ---------------------------------------------------------------- S10 + P19
@query("metrics_tree", f"""
WITH m AS ({S.RUN_METRICS_SQL})
SELECT model_dir, run, round(100 * coalesce(nullif(CASE WHEN run LIKE '1%' THEN f1 / 2 WHEN run LIKE '2%' THEN 0.0 END, 0.0), f1), 6) AS test_f1
FROM m
""")
def metrics_tree(spark, sf):
    """One metrics file per model and run; the test_ key is there for the first
    priority, 0.0 for the second (falls through) and missing for the others."""
    m = S.run_metrics(spark, sf)
    first = F.when(F.col("run").startswith("1"), F.col("f1") / 2).when(F.col("run").startswith("2"), F.lit(0.0))
    rows = m.select("model_dir", "run", F.to_json(F.struct("f1", first.alias("test_f1"))).alias("value"))
    path = scratch_path(spark, "metrics")
    rows.write.partitionBy("model_dir", "run").text(path)
    back = RU.read_metrics_tree(spark, path, "*.txt")
    name = lambda c: F.url_decode(F.regexp_replace(c, f"^{c}=", ""))  # noqa: E731  directories are key=value, escaped
    return back.select(name("model_dir").alias("model_dir"), name("run").alias("run"),
                       r6(RU.metric_fallback("test_f1", "f1")).alias("test_f1"))


# ---------------------------------------------------------------- S2, S3, P1-P7, S8: raw records of both generations
def _raw_records(spark, sf):
    d = S.table(spark, sf, "documents")
    old = F.col("doc_id") % 2 == 0
    sid = F.col("doc_id").cast("string")
    retweet = F.col("doc_id") % 5 == 0
    shown = F.when(retweet, F.concat(F.lit("RT @src: "), F.col("text"))).otherwise(F.col("text"))
    long = F.col("n_chars") > 2000
    full = F.struct(F.concat(F.lit("full "), F.col("text")).alias("full_text"))
    topic = F.array(F.struct(F.col("source").alias("text"), F.col("source").alias("tag")))
    ref = F.struct((F.col("doc_id") + 1).cast("string").alias("id"),
                   F.when(retweet, "retweeted").otherwise("quoted").alias("type"),
                   F.struct(F.col("text").alias("text"), F.col("lang").alias("lang"), F.lit("t0").alias("created_at")).alias("tweet"))
    row = d.select(
        F.when(old, "v1").otherwise("v2").alias("api"), "lang", F.when(old, sid).alias("id_str"), F.when(~old, sid).alias("id"),
        shown.alias("text"), F.when(old, long & ~retweet).alias("truncated"), F.lit("t1").alias("created_at"),
        F.when(old & long, full).alias("extended_tweet"),
        F.when(old & retweet, F.struct((F.col("doc_id") + 1).cast("string").alias("id_str"), F.col("text").alias("text"),
                                       F.when(long, full).alias("extended_tweet"))).alias("retweeted_status"),
        F.when(old, (F.col("doc_id") + 2).cast("string")).alias("in_reply_to_status_id_str"),
        F.when(~old, F.array(ref)).alias("referenced_tweets"),
        F.struct(F.col("source").alias("screen_name"), F.col("source").alias("username")).alias("user"),
        F.when(F.col("doc_id") % 3 == 0, F.struct(topic.alias("hashtags"))).alias("entities"))
    return row


_NORMALISED_SQL = """
SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS api,
       md5(CASE WHEN doc_id % 2 = 0 AND n_chars > 2000 THEN 'full ' || text ELSE text END) AS text_md5,
       md5(CASE WHEN doc_id % 5 = 0 THEN 'RT @src: ' || text ELSE text END) AS original_md5,
       source AS username, doc_id % 5 = 0 AS is_retweet,
       CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id + 1 AS VARCHAR) END AS retweet_id,
       CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END AS hashtags,
       CASE WHEN doc_id % 2 = 0 THEN 'replied_to' || CAST(doc_id + 2 AS VARCHAR)
            WHEN doc_id % 5 <> 0 THEN 'quoted' || CAST(doc_id + 1 AS VARCHAR) ELSE '' END AS context
FROM documents WHERE lang = 'en'
"""


def _shown_posts(raw):
    n = P.normalise(raw)
    ctx = F.array_join(F.transform("context", lambda c: F.concat(c["context_type"], c["context_id"])), "|")
    return n.select("id", "api", F.md5("text").alias("text_md5"), F.md5("original_text").alias("original_md5"), "username",
                    "is_retweet", "retweet_id", F.array_join("hashtags", "|").alias("hashtags"), ctx.alias("context"), "origin_file")


@query("posts_normalised", _NORMALISED_SQL)
def posts_normalised(spark, sf):
    """Raw records of both generations written as JSON lines and read back
    with the superset schema, normalised to one shape; only English ones stay."""
    path = scratch_path(spark, "raw")
    SIO.write_jsonl(_raw_records(spark, sf), path)
    raw = SIO.read_jsonl(spark, path, P.RAW_SCHEMA).withColumn("origin_file", F.lit("raw.json"))
    return _shown_posts(raw).drop("origin_file")


# ---------------------------------------------------------------- S1
@query("archive_posts", f"""
WITH n AS ({_NORMALISED_SQL}) SELECT n.*, d.source || '.json' AS origin_file FROM n JOIN documents d ON n.id = CAST(d.doc_id AS VARCHAR)
""")
def archive_posts(spark, sf):
    """Raw records written as zip archives, one a task with a member per source
    and a statistics file, and read back member by member."""
    path = scratch_path(spark, "archives")
    raw = _raw_records(spark, sf)
    rows = raw.select(F.concat(F.lit("2023/"), F.col("user.username"), F.lit(".json")).alias("member"),
                      F.to_json(F.struct(*raw.columns)).alias("record"))
    write_archives(rows, path, "member", "record")
    return _shown_posts(P.read_json_archives(spark, path))


# ---------------------------------------------------------------- S13 + S14
@query("graph_export", f"""
WITH e AS ({S.E1_EDGES_SQL}), n AS ({S.E1_NODES_SQL})
SELECT 'edge' AS part, md5('<edge source="' || src || '" target="' || dst || '"></edge>') AS line_md5 FROM e
UNION ALL
SELECT 'node', md5('<node id="' || id || '"><data key="role">' || role || '</data></node>') FROM n
""")
def graph_export(spark, sf):
    """GraphML lines of the conversation graph, written as a stage and read back."""
    lines = SIO.graphml_lines(S.e1_nodes(spark, sf), S.e1_edges(spark, sf), ["role"], [])
    back = SIO.write_stage(lines, scratch_path(spark, "graphml"))
    return back.filter(F.col("_part").isin(1, 2)).select(
        F.when(F.col("_part") == 1, "node").otherwise("edge").alias("part"), F.md5("value").alias("line_md5"))


# ---------------------------------------------------------------- X24
_DRESSED_SQL = r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'RT @abc: ' || text WHEN 1 THEN chr(9) || text || ' ' || chr(10)
  WHEN 2 THEN 'see https://ex.org/a?b=1 ' || text ELSE chr(8220) || 'a' || chr(8221) || ' it' || chr(8217) || 's   ' || text END AS t FROM documents"""


def _dressed(spark, sf):
    d = S.table(spark, sf, "documents")
    k = F.col("doc_id") % 4
    t = (F.when(k == 0, F.concat(F.lit("RT @abc: "), "text")).when(k == 1, F.concat(F.lit("\t"), "text", F.lit(" \n")))
          .when(k == 2, F.concat(F.lit("see https://ex.org/a?b=1 "), "text"))
          .otherwise(F.concat(F.lit("“a” it’s   "), "text")))
    return d.select("doc_id", t.alias("t"))


@query("strip_texts", f"""
WITH d AS ({_DRESSED_SQL})
SELECT doc_id, md5(regexp_replace(regexp_replace(t, '^\\s+', ''), '\\s+$', '')) AS text_md5 FROM d
""")
def strip_texts(spark, sf):
    return _dressed(spark, sf).select("doc_id", F.md5(X.strip("t")).alias("text_md5"))


# ---------------------------------------------------------------- W13
@query("oldest_orders", """
SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS ordered FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20
""")
def oldest_orders(spark, sf):
    """A top-k report: the 20 oldest orders."""
    o = S.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return R.first_n(o, ["o_orderdate", "o_orderkey"], 20).select(
        "o_orderkey", F.col("o_orderdate").cast("string").alias("ordered"))
