"""Registered queries: graph build, components, hubs, neighbourhoods,
clustering, rich club, DAG test, border cut, context text, sampling."""
from __future__ import annotations

from pyspark.sql import functions as F

from convgraph.functions import text as X
from convgraph.operators import graph as G
from convgraph.operators import labels as L
from convgraph.operators import relations as R
from convgraph.operators import sampling as H
from convgraph.plans import standins as S
from convgraph.plans.registry import query, r6
from convgraph.session import cut_lineage, free_shuffles, release

SEED = 42


def e3(spark, sf):
    return G.build_edges(S.e3_edges_raw(spark, sf), "src", "dst", "context_type")


def e3_node_ids(spark, sf):
    return S.table(spark, sf, "events").select(F.col("event_id").alias("id"))


_E3 = f"e AS ({S.E3_EDGES_SQL})"
_E3_U = _E3 + """,
u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst),
adj AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u)"""
_E3_CC = "WITH RECURSIVE " + _E3_U + """,
r(id, lbl) AS (SELECT event_id, event_id FROM events UNION SELECT adj.b, r.lbl FROM r JOIN adj ON r.id = adj.a),
cc AS (SELECT id, min(lbl) AS root FROM r GROUP BY id),
sz AS (SELECT root, count(*) AS size FROM cc GROUP BY root),
num AS (SELECT root, size, row_number() OVER (ORDER BY size DESC, root) AS component_id FROM sz),
comp AS (SELECT cc.id, num.component_id, num.size FROM cc JOIN num ON cc.root = num.root)"""


def e3_components(spark, sf):
    cc = G.connected_components(e3(spark, sf), e3_node_ids(spark, sf))
    return G.number_components(cc)


# ---------------------------------------------------------------- G1
@query("edge_build", f"WITH {_E3} SELECT src, dst, context_type FROM e")
def edge_build(spark, sf):
    return e3(spark, sf)


# ---------------------------------------------------------------- G2 + U2
@query("graph_size", f"""
WITH {_E3}
SELECT (SELECT count(*) FROM events) AS n_nodes, (SELECT count(*) FROM e) AS n_edges,
       (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS n_connected_nodes
""")
def graph_size(spark, sf):
    e = e3(spark, sf)
    nodes = G.node_ids(e, e3_node_ids(spark, sf))
    return (nodes.agg(F.count(F.lit(1)).alias("n_nodes"))
                 .crossJoin(e.agg(F.count(F.lit(1)).alias("n_edges")))
                 .crossJoin(G.node_ids(e).agg(F.count(F.lit(1)).alias("n_connected_nodes"))))


# ---------------------------------------------------------------- G8
@query("degree_rank", f"""
WITH {_E3}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id)
SELECT id, degree, rank() OVER (ORDER BY degree DESC) AS rank FROM d
""")
def degree_rank(spark, sf):
    d = G.degrees(e3(spark, sf))
    return R.competition_rank(d, "degree", "rank").select("id", "degree", F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- G9
@query("hubs", f"""
WITH e AS ({S.E2_EDGES_SQL}),
d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id),
z AS (SELECT id, degree, (degree - avg(degree) OVER ()) / stddev_pop(degree) OVER () AS z FROM d)
SELECT id, degree, round(z, 6) AS z FROM z WHERE z > 2
""")
def hubs(spark, sf):
    h = G.hubs(G.degrees(S.e2_edges(spark, sf)))
    return h.select("id", "degree", r6(F.col("z")).alias("z"))


# ---------------------------------------------------------------- G5 + W6
@query("components", _E3_CC + " SELECT id, component_id, size FROM comp")
def components(spark, sf):
    return e3_components(spark, sf).select("id", "component_id", "size")


# ---------------------------------------------------------------- G6 + A11 + A12
@query("component_stats", _E3_CC + """
, s AS (SELECT component_id, size FROM num)
SELECT stat, round(value, 6) AS value FROM (
  SELECT 'n_components' AS stat, CAST(count(*) AS DOUBLE) AS value FROM s
  UNION ALL SELECT 'mean', avg(size) FROM s
  UNION ALL SELECT 'min', CAST(min(size) AS DOUBLE) FROM s
  UNION ALL SELECT 'max', CAST(max(size) AS DOUBLE) FROM s
  UNION ALL SELECT 'p50', quantile_cont(size, 0.5) FROM s
  UNION ALL SELECT 'p90', quantile_cont(size, 0.9) FROM s
  UNION ALL SELECT 'p99', quantile_cont(size, 0.99) FROM s
  UNION ALL SELECT 'largest_pct', max(size) * 100.0 / sum(size) FROM s
  UNION ALL SELECT 'top20_pct', (SELECT sum(size) FROM s WHERE component_id <= 20) * 100.0 / sum(size) FROM s) t
""")
def component_stats(spark, sf):
    comp = e3_components(spark, sf).select("component_id", "size").distinct()
    st = comp.agg(F.count(F.lit(1)).cast("double").alias("n_components"), F.avg("size").alias("mean"),
                  F.min("size").cast("double").alias("min"), F.max("size").cast("double").alias("max"),
                  (F.max("size") * 100.0 / F.sum("size")).alias("largest_pct"),
                  (F.sum(F.when(F.col("component_id") <= 20, F.col("size"))) * 100.0 / F.sum("size"))
                  .alias("top20_pct"))
    long = st.unpivot([], st.columns, "stat", "value")
    pct = R.exact_percentiles(comp, "size", [0.5, 0.9, 0.99]).select(
        F.concat(F.lit("p"), (F.col("p") * 100).cast("int").cast("string")).alias("stat"), F.col("size").alias("value"))
    return long.unionByName(pct).select("stat", r6(F.col("value")).alias("value"))


# ---------------------------------------------------------------- G7 + J8
@query("largest_component", _E3_CC + """
SELECT e.src, e.dst FROM e JOIN comp a ON e.src = a.id JOIN comp b ON e.dst = b.id
WHERE a.component_id = 1 AND b.component_id = 1
""")
def largest_component(spark, sf):
    comp = e3_components(spark, sf)
    top = comp.filter(F.col("component_id") == 1).select("id")
    return G.induced_subgraph(e3(spark, sf).select("src", "dst"), top)


# ---------------------------------------------------------------- G10
@query("n_hop", "WITH " + _E3_U + """,
dg AS (SELECT a AS id, count(*) AS d FROM adj GROUP BY a),
st AS (SELECT id FROM (SELECT id, d, avg(d) OVER () AS mu, stddev_pop(d) OVER () AS sd FROM dg) WHERE (d - mu) / sd > 2),
h AS (SELECT a AS s, b AS n FROM adj WHERE a IN (SELECT id FROM st)
      UNION SELECT adj.a, x.b FROM adj JOIN adj x ON adj.b = x.a WHERE adj.a IN (SELECT id FROM st)),
r AS (SELECT s, n FROM h UNION SELECT id, id FROM st)
SELECT s AS id, count(*) AS n_within FROM r GROUP BY s
""")
def n_hop(spark, sf):
    """Sizes of the two-hop neighbourhoods of the hubs."""
    e = e3(spark, sf)
    r = G.n_hop(e, 2, G.hubs(G.degrees(G.undirected(e))).select("id"))
    return r.groupBy(F.col("start").alias("id")).agg(F.count(F.lit(1)).alias("n_within"))


# ---------------------------------------------------------------- G11
@query("ego_subgraph", f"""
WITH e AS ({S.E2_EDGES_SQL}),
d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id),
c AS (SELECT id FROM d ORDER BY degree DESC, id LIMIT 1),
adj AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
h1 AS (SELECT b AS n FROM adj WHERE a IN (SELECT id FROM c) UNION SELECT id FROM c),
h2 AS (SELECT adj.b AS n FROM adj JOIN h1 ON adj.a = h1.n UNION SELECT n FROM h1),
h3 AS (SELECT adj.b AS n FROM adj JOIN h2 ON adj.a = h2.n UNION SELECT n FROM h2)
SELECT src, dst FROM e WHERE src IN (SELECT n FROM h3) AND dst IN (SELECT n FROM h3)
""")
def ego_subgraph(spark, sf):
    """Radius-3 ego graph of the highest-degree node (ties: smallest id)."""
    e = S.e2_edges(spark, sf)
    centre = G.degrees(e).orderBy(F.col("degree").desc(), F.col("id").asc()).limit(1).select("id")
    ball = G.n_hop(e, 3, centre).select(F.col("node").alias("id"))
    return G.induced_subgraph(e, ball)


# ---------------------------------------------------------------- G12
@query("clustering_coefficient", "WITH " + _E3_U + """,
deg AS (SELECT a AS id, count(*) AS degree FROM adj GROUP BY a),
tri AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM u x JOIN u y ON x.a = y.a AND x.b < y.b
        JOIN u z ON z.a = x.b AND z.b = y.b),
tc AS (SELECT id, count(*) AS t FROM (SELECT p AS id FROM tri UNION ALL SELECT q FROM tri UNION ALL SELECT r FROM tri) GROUP BY id),
c AS (SELECT v.event_id AS id, coalesce(deg.degree, 0) AS degree, coalesce(tc.t, 0) AS t
      FROM events v LEFT JOIN deg ON v.event_id = deg.id LEFT JOIN tc ON v.event_id = tc.id)
SELECT round(avg(CASE WHEN degree < 2 THEN 0.0 ELSE 2.0 * t / (degree * (degree - 1)) END), 6) AS avg_clustering,
       CAST(sum(t) AS BIGINT) AS triangle_corners
FROM c
""")
def clustering_coefficient(spark, sf):
    c = G.average_clustering(e3(spark, sf), e3_node_ids(spark, sf))
    return c.select(r6(F.col("avg_clustering")).alias("avg_clustering"),
                    F.col("triangle_corners").cast("long").alias("triangle_corners"))


# ---------------------------------------------------------------- G13
@query("rich_club", f"""
WITH e AS ({S.E2_EDGES_SQL}),
d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id),
em AS (SELECT least(a.degree, b.degree) AS md FROM e JOIN d a ON e.src = a.id JOIN d b ON e.dst = b.id),
ks AS (SELECT unnest(range(0, (SELECT max(degree) FROM d) + 1)) AS k),
nk AS (SELECT k, (SELECT count(*) FROM d WHERE degree > k) AS n_k, (SELECT count(*) FROM em WHERE md > k) AS e_k FROM ks)
SELECT k, round(2.0 * e_k / (n_k * (n_k - 1)), 6) AS phi FROM nk WHERE n_k > 1
""")
def rich_club(spark, sf):
    rc = G.rich_club(S.e2_edges(spark, sf))
    return rc.select(F.col("k").cast("long").alias("k"), r6(F.col("phi")).alias("phi"))


# ---------------------------------------------------------------- G3
@query("is_dag", f"""
WITH RECURSIVE e AS ({S.E3_EDGES_SQL}), c AS ({S.E1_EDGES_SQL}),
p(s, n) AS (SELECT src, dst FROM e UNION SELECT p.s, e.dst FROM p JOIN e ON p.n = e.src),
q(s, n) AS (SELECT src, dst FROM c UNION SELECT q.s, c.dst FROM q JOIN c ON q.n = c.src)
SELECT 'events' AS graph, NOT EXISTS (SELECT 1 FROM p WHERE s = n) AS is_dag,
       (SELECT count(*) FROM e) AS n_edges
UNION ALL
SELECT 'conversations', NOT EXISTS (SELECT 1 FROM q WHERE s = n), (SELECT count(*) FROM c)
""")
def is_dag(spark, sf):
    """Events with their time order as a certificate, conversations by peeling."""
    rows = []
    by_time = S.table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts")
    for name, edges, order in (("events", e3(spark, sf), by_time), ("conversations", S.e1_edges(spark, sf), None)):
        rows.append((name, G.is_dag(edges, order), edges.count()))
    return spark.createDataFrame(rows, "graph string, is_dag boolean, n_edges long")


# ---------------------------------------------------------------- G18 + G19
_BORDER_SQL = f"""
WITH e AS ({S.E2_EDGES_SQL}), n AS ({S.E2_NODES_SQL.replace('FROM e2', 'FROM e')}),
d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id),
cs AS (SELECT community, count(*) AS csize FROM n GROUP BY community),
nc AS (SELECT n.id, n.community, cs.csize, d.degree FROM n JOIN cs ON n.community = cs.community JOIN d ON n.id = d.id),
bp AS (SELECT e.src, e.dst, a.degree AS ds, b.degree AS dd, a.csize AS ss, b.csize AS sd
       FROM e JOIN nc a ON e.src = a.id JOIN nc b ON e.dst = b.id WHERE a.community <> b.community),
rm AS (SELECT DISTINCT CASE WHEN ds < dd THEN src WHEN dd < ds THEN dst WHEN ss > sd THEN src WHEN sd > ss THEN dst
                WHEN md5('{SEED}:' || CAST(src AS VARCHAR)) < md5('{SEED}:' || CAST(dst AS VARCHAR)) THEN src ELSE dst END AS id
       FROM bp)
"""


@query("border_cut", _BORDER_SQL + " SELECT id FROM rm")
def border_cut(spark, sf):
    return G.disconnect(S.e2_edges(spark, sf), S.e2_nodes(spark, sf), SEED)


# ---------------------------------------------------------------- G20
@query("cut_components", "WITH RECURSIVE " + _BORDER_SQL.replace("WITH e AS", "e AS", 1) + """,
ke AS (SELECT src, dst FROM e WHERE src NOT IN (SELECT id FROM rm) AND dst NOT IN (SELECT id FROM rm)),
kn AS (SELECT id FROM n WHERE id NOT IN (SELECT id FROM rm)),
adj AS (SELECT src AS a, dst AS b FROM ke UNION SELECT dst, src FROM ke),
r(id, lbl) AS (SELECT id, id FROM kn UNION SELECT adj.b, r.lbl FROM r JOIN adj ON r.id = adj.a),
cc AS (SELECT id, min(lbl) AS root FROM r GROUP BY id),
sz AS (SELECT root, count(*) AS size FROM cc GROUP BY root),
num AS (SELECT root, size, row_number() OVER (ORDER BY size DESC, root) AS component_id FROM sz)
SELECT cc.id, num.component_id, num.size FROM cc JOIN num ON cc.root = num.root
""")
def cut_components(spark, sf):
    """Edges, nodes and removed nodes are written once for all that read them;
    what made them is deleted before the next step."""
    e = cut_lineage(S.e2_edges(spark, sf))
    free_shuffles(spark)
    nodes = cut_lineage(S.e2_nodes(spark, sf, e))
    gone = cut_lineage(G.disconnect(e, nodes, SEED))
    free_shuffles(spark)
    kept_e = cut_lineage(e.join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
                          .join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"), replaces=e)
    kept_n = cut_lineage(nodes.select("id").join(gone, "id", "left_anti"), replaces=nodes)
    release(gone)
    free_shuffles(spark)
    cc = G.connected_components(kept_e, kept_n)
    release(kept_e)
    release(kept_n)
    free_shuffles(spark)
    return G.number_components(cc).select("id", "component_id", "size")


# ---------------------------------------------------------------- J12 + P20 + J15
_ATTR_SQL = f"""
WITH {_E3}, ids AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
att AS (SELECT event_id, ts, event_type, 'user' || CAST(user_id AS VARCHAR) AS usr FROM events WHERE value >= 1),
na AS (SELECT ids.id, att.ts, coalesce(att.usr, 'userunknown') AS anonymised_user_id, att.event_type AS text
       FROM ids LEFT JOIN att ON ids.id = att.event_id)
"""


def _attributes(spark, sf):
    e = e3(spark, sf)
    ids = G.node_ids(e)
    att = S.table(spark, sf, "events").filter(F.col("value") >= 1).select(
        F.col("event_id").alias("id"), "ts", F.col("event_type").alias("text"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("usr"))
    return ids.join(att, "id", "left").withColumn(
        "anonymised_user_id", F.coalesce("usr", F.lit("userunknown"))).drop("usr")


@query("node_attributes", _ATTR_SQL + """
SELECT id, anonymised_user_id, text,
       CAST(date_diff('microsecond', TIMESTAMP '1970-01-01', ts) AS DOUBLE) / 1000000.0 AS created_at_unix
FROM na
""")
def node_attributes(spark, sf):
    a = _attributes(spark, sf)
    unix = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / 1e6
    return a.select("id", "anonymised_user_id", "text", unix.cast("double").alias("created_at_unix"))


@query("missing_attributes", _ATTR_SQL + """
SELECT count(*) AS n_nodes, count(*) FILTER (WHERE ts IS NULL) AS n_missing FROM na
""")
def missing_attributes(spark, sf):
    a = _attributes(spark, sf)
    return a.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("ts").isNull()).alias("n_missing"))


# ---------------------------------------------------------------- G22
_CTX_SQL = "WITH " + _E3_U + """,
h2 AS (SELECT DISTINCT s, n FROM (SELECT a AS s, b AS n FROM adj UNION ALL
                                  SELECT adj.a, x.b FROM adj JOIN adj x ON adj.b = x.a) WHERE s <> n),
rk AS (SELECT h2.s, h2.n, v.ts, row_number() OVER (PARTITION BY h2.s ORDER BY v.ts, h2.n) AS r
       FROM h2 JOIN events v ON h2.n = v.event_id),
blk AS (SELECT rk.s AS id, rk.ts, rk.n AS nid,
               '[context] [user' || CAST(v.user_id AS VARCHAR) || ']: ' || v.event_type || ' ' || chr(10) || ' [/context]' AS block
        FROM rk JOIN events v ON rk.n = v.event_id WHERE rk.r <= 6
        UNION ALL
        SELECT event_id, ts, event_id,
               '[main_tweet] [user' || CAST(user_id AS VARCHAR) || ']: ' || event_type || ' ' || chr(10) || ' [/main_tweet]'
        FROM events),
ctx AS (SELECT id, string_agg(block, ' ' ORDER BY ts, nid) AS text_and_context FROM blk GROUP BY id)
"""


def _context(spark, sf):
    ev = S.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("created_at"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user"),
        F.col("event_type").alias("text"))
    return G.context_text(e3(spark, sf), ev, max_neighbours=6)


@query("context_text", _CTX_SQL + " SELECT id, text_and_context FROM ctx")
def context_text(spark, sf):
    return _context(spark, sf)


# ---------------------------------------------------------------- X12 + X13/X14 + X15
@query("annotation_set", _CTX_SQL + r""",
m AS (SELECT id, regexp_replace(regexp_replace(replace(text_and_context, '[/context]', ''),
                 '@[\pL\pN_]+\s?', '@user ', 'g'), '(@user\s*){4,}', '@user @user ... @user ', 'g') AS t FROM ctx),
p AS (SELECT id, regexp_split_to_array(t, '\[main_tweet\]|\[/main_tweet\]') AS parts FROM m)
SELECT id AS new_id, parts[1] AS previous_context, '[main_tweet]' || parts[2] AS main_tweet,
       parts[3] AS posterior_context
FROM p
""")
def annotation_set(spark, sf):
    c = _context(spark, sf)
    t = X.mask_mentions(X.remove_tag("text_and_context", X.CONTEXT_CLOSE))
    prev, main, post = X.split_context(t)
    return c.select(F.col("id").alias("new_id"), prev.alias("previous_context"), main.alias("main_tweet"),
                    post.alias("posterior_context"))


# ---------------------------------------------------------------- H1 + G23 + A37
@query("component_sample", _E3_CC + f"""
, k AS (SELECT floor(3000.0 / (count(*) * 1.0 / count(DISTINCT component_id))) AS k FROM comp),
rk AS (SELECT component_id, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(component_id AS VARCHAR)), component_id) AS r
       FROM (SELECT DISTINCT component_id FROM comp))
SELECT comp.id, comp.component_id FROM comp JOIN rk ON comp.component_id = rk.component_id
WHERE rk.r <= (SELECT k FROM k)
""")
def component_sample(spark, sf):
    comp = e3_components(spark, sf).select("id", "component_id")
    return H.cluster_sample(comp, "component_id", 3000, SEED).select("id", "component_id")


# ---------------------------------------------------------------- H2 + H3 + A33
_SPLIT_SQL = _E3_CC + f"""
, g AS (SELECT component_id, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(component_id AS VARCHAR)), component_id) AS r
        FROM (SELECT DISTINCT component_id FROM comp)),
cut AS (SELECT ceil({H.test_share_literal()} * count(*)) AS t,
               ceil(0.25 * (count(*) - ceil({H.test_share_literal()} * count(*)))) AS v FROM g),
sp AS (SELECT comp.id, comp.component_id,
              CASE WHEN g.r <= cut.t THEN 'test' WHEN g.r <= cut.t + cut.v THEN 'val' ELSE 'train' END AS split
       FROM comp JOIN g ON comp.component_id = g.component_id CROSS JOIN cut)
"""


def _split(spark, sf):
    comp = e3_components(spark, sf).select("id", "component_id")
    return H.split_by_groups(comp, "component_id", 0.6, 0.2, SEED)


@query("group_split", _SPLIT_SQL + " SELECT id, component_id, split FROM sp")
def group_split(spark, sf):
    return _split(spark, sf).select("id", "component_id", "split")


@query("split_shares", _SPLIT_SQL + """
SELECT split, count(*) AS n_rows, round(count(*) / (SELECT count(*) FROM sp), 6) AS share FROM sp GROUP BY split
""")
def split_shares(spark, sf):
    s = H.split_shares(_split(spark, sf))
    return s.select("split", "n_rows", r6(F.col("share")).alias("share"))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("split_balance", _SPLIT_SQL + f"""
SELECT split, count(*) AS n_rows,
       {", ".join(f"round(avg(CAST(v.event_type = '{t}' AS INTEGER)) * 100, 6) AS {t}" for t in _TYPES)}
FROM sp JOIN events v ON sp.id = v.event_id GROUP BY split
""")
def split_balance(spark, sf):
    sp = _split(spark, sf)
    ev = S.table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type")
    wide = sp.join(ev, "id").select("split", *[(F.col("event_type") == t).cast("int").alias(t) for t in _TYPES])
    b = L.balance_by_split(wide, "split", _TYPES)
    return b.select("split", "n_rows", *[r6(F.col(t)).alias(t) for t in _TYPES])


# ---------------------------------------------------------------- G14-G17
from convgraph.operators import community as C  # noqa: E402


@query("modularity", f"""
WITH e AS ({S.E2_EDGES_SQL}), n AS ({S.E2_NODES_SQL.replace('FROM e2', 'FROM e')}),
m AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM e),
l AS (SELECT a.community, count(*) AS l FROM e JOIN n a ON e.src = a.id JOIN n b ON e.dst = b.id
      WHERE a.community = b.community GROUP BY 1),
d AS (SELECT n.community, count(*) AS d FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) x
      JOIN n ON x.id = n.id GROUP BY 1)
SELECT round(sum(coalesce(l.l, 0) / m.m - (d.d / (2 * m.m)) ^ 2), 6) AS modularity,
       count(*) AS n_communities
FROM d LEFT JOIN l ON d.community = l.community CROSS JOIN m
""")
def modularity(spark, sf):
    """G17 for a given partition (nation of supplier / customer)."""
    e, n = S.e2_edges(spark, sf), S.e2_nodes(spark, sf)
    q = C.modularity(e, n)
    k = n.select("community").distinct().agg(F.count(F.lit(1)).alias("n_communities"))
    return q.select(r6(F.col("modularity")).alias("modularity")).crossJoin(k)


def _largest(e):
    """The subgraph of the largest component (ties: the smallest id), written
    once for all that read it."""
    e = cut_lineage(e)
    cc = G.connected_components(e)
    top = cc.groupBy("root").agg(F.count(F.lit(1)).alias("size")) \
        .agg(F.max_by("root", F.struct("size", -F.col("root"))).alias("root"))
    return cut_lineage(G.induced_subgraph(e, cc.join(F.broadcast(top), "root").select("id")), replaces=e)


@query("louvain_communities")
def louvain_communities(spark, sf):
    return C.louvain(S.e2_edges(spark, sf), resolution=0.1)


@query("greedy_modularity_communities")
def greedy_modularity_communities(spark, sf):
    e = cut_lineage(S.e2_edges(spark, sf))
    return C.greedy_modularity(e, resolution=0.08, cutoff=max(1, G.hubs(G.degrees(e)).count()))


@query("fluid_communities")
def fluid_communities(spark, sf):
    """On the largest component, where every node is reached."""
    e = _largest(S.e2_edges(spark, sf))
    return C.fluid_communities(e, k=max(1, G.hubs(G.degrees(e)).count()), seed=SEED)


@query("community_compare")
def community_compare(spark, sf):
    """Count, largest size and modularity of each partition, all of the
    same nodes: the largest component."""
    e = _largest(S.e2_edges(spark, sf))
    k = max(1, G.hubs(G.degrees(e)).count())
    parts = {"louvain": C.louvain(e, resolution=0.1),
             "greedy_modularity": C.greedy_modularity(e, resolution=0.08, cutoff=k),
             "fluid": C.fluid_communities(e, k=k, seed=SEED)}
    out = None
    for name, p in parts.items():
        sizes = C.community_sizes(p).agg(F.count(F.lit(1)).alias("n_communities"), F.max("size").alias("largest"))
        row = sizes.crossJoin(C.modularity(e, p)).select(F.lit(name).alias("algorithm"), "*")
        out = row if out is None else out.unionByName(row)
    return out


# ---------------------------------------------------------------- J6 + J7 + G23 + A37
_EXCLUDED_TOPIC = "error"   # stand-in for the excluded topic list


@query("topic_filtered_components", _E3_CC + f"""
, keep AS (SELECT id FROM comp WHERE id NOT IN (SELECT event_id FROM events WHERE event_type = '{_EXCLUDED_TOPIC}'))
SELECT count(DISTINCT comp.component_id) AS n_components, count(*) AS n_nodes,
       round(count(*) * 1.0 / count(DISTINCT comp.component_id), 6) AS mean_component_size
FROM comp JOIN keep ON comp.id = keep.id
""")
def topic_filtered_components(spark, sf):
    """Nodes whose topic is excluded leave (anti join on the id list), the
    components they belonged to are counted among the rest."""
    comp = e3_components(spark, sf)
    excluded = S.table(spark, sf, "events").filter(F.col("event_type") == _EXCLUDED_TOPIC) \
                .select(F.col("event_id").alias("id"))
    kept = comp.join(excluded, "id", "left_anti")
    return kept.agg(F.count_distinct("component_id").alias("n_components"), F.count(F.lit(1)).alias("n_nodes"),
                    r6(F.count(F.lit(1)) / F.count_distinct("component_id")).alias("mean_component_size"))


# ---------------------------------------------------------------- G12 (directed form)
@query("clustering_directed", "WITH " + _E3 + """,
d AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst),
pr AS (SELECT least(src, dst) AS x, greatest(src, dst) AS y, count(*) AS b FROM d GROUP BY 1, 2),
bb AS (SELECT x AS u, y AS v, b FROM pr UNION ALL SELECT y, x, b FROM pr),
tri AS (SELECT p.x AS a, p.y AS u, q.y AS v, p.b * q.b * r.b AS t
        FROM pr p JOIN pr q ON p.x = q.x AND p.y < q.y JOIN pr r ON r.x = p.y AND r.y = q.y),
per AS (SELECT id, sum(t) AS t FROM (SELECT a AS id, t FROM tri UNION ALL SELECT u, t FROM tri UNION ALL SELECT v, t FROM tri) GROUP BY id),
dt AS (SELECT id, count(*) AS dtot FROM (SELECT src AS id FROM d UNION ALL SELECT dst FROM d) GROUP BY id),
dr AS (SELECT id, count(*) AS drec FROM (SELECT x AS id FROM pr WHERE b = 2 UNION ALL SELECT y FROM pr WHERE b = 2) GROUP BY id),
c AS (SELECT v.event_id AS id, coalesce(dt.dtot, 0) AS dtot, coalesce(dr.drec, 0) AS drec, coalesce(per.t, 0) AS t
      FROM events v LEFT JOIN dt ON v.event_id = dt.id LEFT JOIN dr ON v.event_id = dr.id LEFT JOIN per ON v.event_id = per.id)
SELECT round(avg(CASE WHEN dtot * (dtot - 1) - 2 * drec > 0 AND t > 0 THEN t / (dtot * (dtot - 1) - 2 * drec) ELSE 0.0 END), 6)
       AS avg_clustering
FROM c
""")
def clustering_directed(spark, sf):
    c = G.average_clustering_directed(e3(spark, sf), e3_node_ids(spark, sf))
    return c.select(r6(F.col("avg_clustering")).alias("avg_clustering"))
