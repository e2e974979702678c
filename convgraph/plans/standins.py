"""Stand-in inputs derived from the driver tables (see FIXTURES.md part C).

Each stand-in exists twice: a Spark builder (``DataFrame``) and the
equivalent DuckDB SQL (a CTE body over the pre-registered views), so that
every registered query can be checked against an independent oracle.
All of them read whole tables; nothing is subset or capped.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# --- fixed values: stand-in label set (seven labels, "none" last) ---------
LABELS = ["toxic", "low_quality", "exclaim", "mention", "digits", "long_text", "none"]
BASE_LABELS = LABELS[:-1]
NONE_LABEL = "none"
# graph E3 thresholds (seconds) and the stand-in for "no label"
REPLY_GAP_S = 3600
QUOTE_GAP_S = 300
E3_NONE_LABEL = "view"
# --------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------
# labelled documents: documents ⋈ labels with seven rule labels
# --------------------------------------------------------------------------
def _rule_labels(text, n_chars, quality, toxic, long_cut: int, flip=None):
    flags = {
        "toxic": toxic.cast("int"),
        "low_quality": (1 - quality).cast("int"),
        "exclaim": F.contains(text, F.lit("!!")).cast("int"),
        "mention": F.contains(text, F.lit("@")).cast("int"),
        "digits": text.rlike("[0-9]").cast("int"),
        "long_text": (n_chars > long_cut).cast("int"),
    }
    if flip is not None:
        flags = {k: F.when(flip, 1 - v).otherwise(v) for k, v in flags.items()}
    none = F.when(sum(flags.values()) == 0, 1).otherwise(0)
    return [v.alias(k) for k, v in flags.items()] + [none.alias("none")]


def labelled(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id")
    return j.select(F.col("doc_id").alias("id"), "text", "n_chars", "source", "lang",
                    *_rule_labels(F.col("text"), F.col("n_chars"), F.col("quality"),
                                  F.col("toxic"), 2000))


def second_annotator(spark, sf_dir) -> DataFrame:
    """Same rules with another length cut; every 7th document flipped."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id")
    return j.select(F.col("doc_id").alias("id"),
                    *_rule_labels(F.col("text"), F.col("n_chars"), F.col("quality"),
                                  F.col("toxic"), 1500, flip=(F.col("doc_id") % 7 == 0)))


def _rule_sql(long_cut: int, flip: str | None = None) -> str:
    base = {
        "toxic": "toxic",
        "low_quality": "1 - quality",
        "exclaim": "CAST(contains(text, '!!') AS INTEGER)",
        "mention": "CAST(contains(text, '@') AS INTEGER)",
        "digits": "CAST(regexp_matches(text, '[0-9]') AS INTEGER)",
        "long_text": f"CAST(n_chars > {long_cut} AS INTEGER)",
    }
    if flip:
        base = {k: f"CASE WHEN {flip} THEN 1 - ({v}) ELSE ({v}) END" for k, v in base.items()}
    cols = [f"CAST({v} AS INTEGER) AS {k}" for k, v in base.items()]
    total = " + ".join(f"({v})" for v in base.values())
    cols.append(f"CASE WHEN {total} = 0 THEN 1 ELSE 0 END AS none")
    return ", ".join(cols)


LABELLED_SQL = f"""
SELECT d.doc_id AS id, d.text, d.n_chars, d.source, d.lang, {_rule_sql(2000)}
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

SECOND_SQL = f"""
SELECT d.doc_id AS id, {_rule_sql(1500, 'd.doc_id % 7 = 0')}
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""


def labels_long(wide: DataFrame, id_col: str = "id", labels=LABELS) -> DataFrame:
    """Melt wide 0/1 labels, keep value = 1."""
    return (wide.unpivot([id_col], list(labels), "label", "value")
                .filter("value = 1").drop("value"))


def labels_long_sql(src: str, id_col: str = "id", labels=LABELS) -> str:
    parts = [f"SELECT {id_col}, '{lab}' AS label FROM {src} WHERE {lab} = 1" for lab in labels]
    return " UNION ALL ".join(parts)


# --------------------------------------------------------------------------
# documents as raw posts (duplicate ids from two files)
# --------------------------------------------------------------------------
def raw_posts(spark, sf_dir) -> DataFrame:
    """documents ∪ a mirror copy of the English documents under another
    source; the long ones also carry another language code."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    mirror = (d.filter(F.col("lang") == "en")
               .withColumn("source", F.lit("mirror"))
               .withColumn("lang", F.when(F.col("n_chars") > 2000, F.lit("en-GB"))
                                    .otherwise(F.col("lang"))))
    return d.unionByName(mirror)


RAW_POSTS_SQL = """
SELECT doc_id, text, lang, source, n_chars FROM documents
UNION ALL
SELECT doc_id, text, CASE WHEN n_chars > 2000 THEN 'en-GB' ELSE lang END AS lang,
       'mirror' AS source, n_chars
FROM documents WHERE lang = 'en'
"""


def topic_words(text_col) -> F.Column:
    """Distinct lower-cased [a-z] runs (topics / hashtags)."""
    toks = F.split(F.lower(text_col), "[^a-z]+")
    return F.array_distinct(F.filter(toks, lambda x: F.length(x) >= 1))


TOPIC_WORDS_SQL = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^a-z]+'), lambda x: length(x) >= 1))"


# --------------------------------------------------------------------------
# graph E1: conversation chains
# --------------------------------------------------------------------------
def e1_nodes(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn",
                    "role", "text")


def e1_edges(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    prev = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("pturn"))
    j = c.join(prev, ["conv_id", "turn"])
    return j.select((F.col("conv_id") * 1000 + F.col("pturn")).alias("src"),
                    (F.col("conv_id") * 1000 + F.col("turn")).alias("dst"))


E1_NODES_SQL = "SELECT conv_id * 1000 + turn AS id, conv_id, turn, role, text FROM conversations"
E1_EDGES_SQL = """
SELECT a.conv_id * 1000 + a.turn AS src, b.conv_id * 1000 + b.turn AS dst
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
"""


# --------------------------------------------------------------------------
# graph E2: supplier-customer pairs of all order lines (undirected)
# --------------------------------------------------------------------------
def e2_edges(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    pairs = li.join(o, li.l_orderkey == o.o_orderkey).select(
        (F.col("l_suppkey") * 2).alias("s"), (F.col("o_custkey") * 2 + 1).alias("c"))
    return pairs.select(F.least("s", "c").alias("src"), F.greatest("s", "c").alias("dst")).distinct()


def e2_nodes(spark, sf_dir, edges: DataFrame | None = None) -> DataFrame:
    """Nodes of E2 (its ``edges``, where they are at hand) with a community =
    nation key."""
    e = e2_edges(spark, sf_dir) if edges is None else edges
    ids = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("id"),
                                               F.col("s_nationkey").cast("long").alias("community"))
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2 + 1).alias("id"),
                                               F.col("c_nationkey").cast("long").alias("community"))
    return ids.join(s.unionByName(c), "id", "left")


E2_EDGES_SQL = """
SELECT DISTINCT least(l.l_suppkey * 2, o.o_custkey * 2 + 1) AS src,
                greatest(l.l_suppkey * 2, o.o_custkey * 2 + 1) AS dst
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""
E2_NODES_SQL = """
SELECT i.id, c.community FROM (SELECT src AS id FROM e2 UNION SELECT dst FROM e2) i
LEFT JOIN (SELECT s_suppkey * 2 AS id, CAST(s_nationkey AS BIGINT) AS community FROM supplier
           UNION ALL SELECT c_custkey * 2 + 1, CAST(c_nationkey AS BIGINT) FROM customer) c
ON i.id = c.id
"""


# --------------------------------------------------------------------------
# graph E3: reply / quote edges between events
# --------------------------------------------------------------------------
def next_in_sequence(df: DataFrame, key: str, ts: str, tie: str, bucket_s: int) -> DataFrame:
    """For every row, the next row of the same ``key`` in (ts, tie) order.

    Skew-safe ``lead``: the window partitions by (key, time bucket), so one
    hot key is spread over many buckets; the last row of each bucket finds
    its successor in a per-(key, bucket) summary table, which has one row
    per non-empty bucket.  Returns (key, tie, next_tie, next_ts).
    """
    epoch = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))
    b = df.select(key, ts, tie).withColumn("_b", F.floor(epoch / bucket_s))
    w = Window.partitionBy(key, "_b").orderBy(ts, tie)
    inner = (b.withColumn("_nt", F.lead(tie).over(w))
              .withColumn("_nts", F.lead(ts).over(w)))
    firsts = b.groupBy(key, "_b").agg(F.min(F.struct(ts, tie)).alias("_f"))
    wb = Window.partitionBy(key).orderBy("_b")
    # one row per (key, bucket): bounded by the number of buckets of a key
    succ = firsts.select(key, "_b", F.lead("_f").over(wb).alias("_sf"))
    out = inner.join(succ, [key, "_b"], "left")
    return out.select(
        key, tie, ts,
        F.coalesce("_nt", F.col("_sf")[tie]).alias("next_" + tie),
        F.coalesce("_nts", F.col("_sf")[ts]).alias("next_" + ts))


def e3_edges_raw(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    by_user = next_in_sequence(ev, "user_id", "ts", "event_id", REPLY_GAP_S)
    by_type = next_in_sequence(ev, "event_type", "ts", "event_id", QUOTE_GAP_S)

    def edges(nx, gap, kind):
        within = F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("next_ts")) <= gap * 1_000_000
        return (nx.filter(F.col("next_event_id").isNotNull() & within)
                  .select(F.col("event_id").alias("src"), F.col("next_event_id").alias("dst"),
                          F.lit(kind).alias("context_type")))

    return edges(by_user, REPLY_GAP_S, "replied_to").unionByName(
        edges(by_type, QUOTE_GAP_S, "quoted"))


def e3_nodes(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("id"), "ts", "user_id",
                     F.col("event_type").alias("text"), "event_type", "value")


E3_EDGES_RAW_SQL = f"""
SELECT event_id AS src, nxt AS dst, 'replied_to' AS context_type FROM (
  SELECT event_id, ts, lead(event_id) OVER w AS nxt, lead(ts) OVER w AS nts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) t
WHERE nxt IS NOT NULL AND date_diff('microsecond', ts, nts) <= {REPLY_GAP_S * 1000000}
UNION ALL
SELECT event_id AS src, nxt AS dst, 'quoted' AS context_type FROM (
  SELECT event_id, ts, lead(event_id) OVER w AS nxt, lead(ts) OVER w AS nts
  FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) t
WHERE nxt IS NOT NULL AND date_diff('microsecond', ts, nts) <= {QUOTE_GAP_S * 1000000}
"""
E3_EDGES_SQL = f"SELECT src, dst, max(context_type) AS context_type FROM ({E3_EDGES_RAW_SQL}) r GROUP BY src, dst"


# --------------------------------------------------------------------------
# predictions: deterministic logits per labelled document
# --------------------------------------------------------------------------
def logit_expr(truth, doc_id, j: int):
    return truth * 1.5 - 0.75 + ((doc_id * (j + 3)) % 7 - 3) * 0.4


def predictions(spark, sf_dir) -> DataFrame:
    lab = labelled(spark, sf_dir)
    return lab.select("id", *LABELS,
                      *[logit_expr(F.col(l), F.col("id"), j).alias("logit_" + l)
                        for j, l in enumerate(LABELS)])


def predictions_sql() -> str:
    logits = ", ".join(f"{l} * 1.5 - 0.75 + ((id * {j + 3}) % 7 - 3) * 0.4 AS logit_{l}"
                       for j, l in enumerate(LABELS))
    return f"SELECT id, {', '.join(LABELS)}, {logits} FROM ({LABELLED_SQL}) lab"


# --------------------------------------------------------------------------
# training runs: orders by status (model) x priority (run) x month (epoch)
# --------------------------------------------------------------------------
def run_history(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    epoch = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).alias("epoch")
    g = o.groupBy(F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("run"),
                  epoch).agg(F.avg("o_totalprice").alias("_m"), F.count(F.lit(1)).alias("n"))
    return g.select("model", "run", "epoch", "n",
                    (F.col("_m") / 1000000.0).alias("val_f1"))


RUN_HISTORY_SQL = """
SELECT o_orderstatus AS model, o_orderpriority AS run,
       (year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS epoch,
       count(*) AS n, avg(o_totalprice) / 1000000.0 AS val_f1
FROM orders GROUP BY 1, 2, 3
"""


def model_dir_expr(model_col):
    return (F.when(model_col == "F", F.lit("encoder-a_with_context_VADER_VAD"))
             .when(model_col == "O", F.lit("encoder-b_POS_emojis"))
             .otherwise(F.lit("encoder-c_hashtags_with_context")))


MODEL_DIR_SQL = """CASE WHEN model = 'F' THEN 'encoder-a_with_context_VADER_VAD'
 WHEN model = 'O' THEN 'encoder-b_POS_emojis' ELSE 'encoder-c_hashtags_with_context' END"""


def run_metrics(spark, sf_dir) -> DataFrame:
    """One test-metrics record per (model, run): the S10 table shape."""
    o = table(spark, sf_dir, "orders")
    g = o.groupBy(F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("run")) \
         .agg((F.avg("o_totalprice") / 1000000.0).alias("f1"),
              (F.min("o_totalprice") / 100000.0).alias("precision"),
              (F.max("o_totalprice") / 1000000.0).alias("recall"),
              (F.count(F.lit(1)) / 10000.0).alias("accuracy"))
    return g.withColumn("model_dir", model_dir_expr(F.col("model")))


RUN_METRICS_SQL = f"""
SELECT model, run, f1, precision, recall, accuracy, {MODEL_DIR_SQL} AS model_dir FROM (
SELECT o_orderstatus AS model, o_orderpriority AS run,
       avg(o_totalprice) / 1000000.0 AS f1, min(o_totalprice) / 100000.0 AS precision,
       max(o_totalprice) / 1000000.0 AS recall, count(*) / 10000.0 AS accuracy
FROM orders GROUP BY 1, 2) t
"""
