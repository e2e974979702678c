"""Graph operators over edge tables.

A graph is a pair of DataFrames: ``nodes(id, ...)`` and ``edges(src, dst,
...)``.  Iterative algorithms run set-at-a-time rounds, cut lineage every round
with Parquet files in the shared folder, and stop on an exact test; each round
makes progress, so none has a bound on its rounds.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convgraph.operators.relations import global_positions
from convgraph.session import cut_lineage, free_shuffles, release


# G1
def build_edges(rel: DataFrame, src: str, dst: str, attr: str | None = None) -> DataFrame:
    """Directed edges ``src -> dst``; rows with a NULL end are dropped and
    parallel edges collapse (the later attribute in sorted order wins)."""
    e = rel.filter(F.col(src).isNotNull() & F.col(dst).isNotNull())
    if attr is None:
        return e.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    return e.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(
        F.max(attr).alias(attr))


# Nodes from both edge columns, plus isolated nodes
def node_ids(edges: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    ids = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
    if extra is not None:
        ids = ids.union(extra.select("id"))
    return ids.distinct()


# G4
def undirected(edges: DataFrame) -> DataFrame:
    """Simple undirected projection: canonical (least, greatest), no loops."""
    return (edges.filter(F.col("src") != F.col("dst"))
                 .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
                 .distinct())


def both_directions(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


# G8
def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Degree = in + out (a self loop counts twice, as in networkx)."""
    d = (edges.select(F.explode(F.array("src", "dst")).alias("id"))
              .groupBy("id").agg(F.count(F.lit(1)).alias("degree")))
    if nodes is not None:
        d = nodes.select("id").join(d, "id", "left").fillna(0, ["degree"])
    return d


# G9
def hubs(deg: DataFrame, z_cut: float = 2.0) -> DataFrame:
    """Nodes whose degree z-score (population std) exceeds ``z_cut``.  The
    mean/std row is a single scalar pair, broadcast to every task."""
    s = deg.agg(F.avg("degree").alias("_mu"), F.stddev_pop("degree").alias("_sd"))
    z = F.try_divide(F.col("degree") - F.col("_mu"), F.col("_sd"))
    return (deg.crossJoin(F.broadcast(s)).withColumn("z", z)
               .filter(F.col("z") > z_cut).drop("_mu", "_sd"))


#: A node at the ends of at least one edge in HOT is joined apart.
HOT = 1000


def hot_nodes(edges: DataFrame, a: str, b: str, total: int) -> DataFrame:
    """(id): nodes with at least one in ``HOT`` of the ``total`` edges.  An edge
    has two ends, so there are at most 2 * HOT of them at every size."""
    ends = edges.select(F.explode(F.array(a, b)).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(ends.filter(F.col("n") * HOT >= total).select("id"))


def spread_join(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (one row per key).  The keys of ``hot``, a
    table of bounded size, take their rows of ``table`` by broadcast, so their
    rows stay where they are; all other keys meet in a shuffle."""
    few = F.broadcast(hot.withColumnRenamed("id", key))
    return rows.join(few, key, "left_semi").join(F.broadcast(table.join(few, key, "left_semi")), key, how) \
        .unionByName(rows.join(few, key, "left_anti").join(table, key, how))


#: Edges up to which one task finishes the contraction; a constant, whatever the graph.
SMALL = 200_000


# G5
def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Connected components by randomised contraction (Bögeholz et al., 2020).

    Returns (id, root) with root = the smallest id of the component.
    Isolated nodes (present only in ``nodes``) are their own root.

    Each round links every node to the one of the smallest hash among itself
    and its neighbours (a new hash a round) and contracts these links.  At
    least a third of the nodes is expected to go in a round, on any graph, so
    all rounds together cost a few times the first.  What is left below
    ``SMALL`` edges is finished in one task.  Then the links are followed back
    from the last round to the first.  Hubs with at least one in ``HOT`` of a
    round's edges are joined by broadcast (:func:`spread_join`).
    """
    e = cut_lineage(edges.filter(F.col("src") != F.col("dst"))
                    .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    levels, total, rnd = [], e.count(), 0
    while total > SMALL:
        rnd += 1
        links = cut_lineage(_links(e, rnd))
        hot = hot_nodes(e, "u", "v", total)
        few = hot.count() > 0

        def renamed(rows, end):
            to = links.toDF(end, "_to")
            out = spread_join(rows, to, end, hot) if few else rows.join(to, end)
            return out.withColumn(end, F.col("_to")).drop("_to")
        e = cut_lineage(renamed(renamed(e, "u"), "v").filter("u <> v")
                        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), replaces=e)
        release(hot)
        levels.append(links)
        total = e.count()
        free_shuffles(edges.sparkSession)
    # (id, rep) of the nodes that still have edges, from the remainder of bounded size
    last = cut_lineage(e.coalesce(1).mapInPandas(_finish, e.select(F.col("u").alias("id"), F.col("v").alias("rep")).schema))
    release(e)
    for links in reversed(levels):
        # a link's end without edges in later rounds is its own representative
        last = cut_lineage(links.join(last.toDF("to", "_rep"), "to", "left")
                           .select("id", F.coalesce("_rep", "to").alias("rep")), replaces=last)
        release(links)
    if levels:
        # representatives were chosen by hash: each component is named by its smallest id
        low = last.groupBy("rep").agg(F.min("id").alias("root"), F.count(F.lit(1)).alias("_n"))
        low = cut_lineage(low)
        big = low.filter(F.col("_n") * HOT >= low.agg(F.sum("_n")).first()[0]).select(F.col("rep").alias("id"))
        roots = spread_join(last, low.select("rep", "root"), "rep", big).select("id", "root")
    else:
        roots = last.withColumnRenamed("rep", "root")
    if nodes is not None:
        roots = nodes.select("id").distinct().join(roots, "id", "left") \
                     .withColumn("root", F.coalesce("root", "id"))
    return cut_lineage(roots)  # callers read it several times


def _links(e: DataFrame, rnd: int) -> DataFrame:
    """(id, to): per node the one of the smallest hash of the round among itself
    and its neighbours.  Equal hashes are ordered by the id."""
    def draw(c):
        return F.struct(F.xxhash64(F.col(c), F.lit(rnd)).alias("h"), F.col(c).alias("to"))
    both = e.select(F.inline(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("o")),
                                     F.struct(F.col("v").alias("id"), F.col("u").alias("o")))))
    best = both.groupBy("id").agg(F.min(draw("o")).alias("m"))
    return best.select("id", F.least(F.col("m"), draw("id"))["to"].alias("to"))


def _finish(batches):
    """(id, rep = smallest id) of the edges (u, v) in the batches, by union-find."""
    import pandas as pd
    parent: dict = {}

    def find(x):
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top
    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist()):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        yield pd.DataFrame({"id": list(parent), "rep": [find(x) for x in parent]})


# W6
def number_components(cc: DataFrame, start: int = 1) -> DataFrame:
    """Number components by size descending from ``start`` (tie: smallest
    member id).  Distributed ranking over the component table."""
    sizes = cc.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    ranked = global_positions(sizes, [F.col("size").desc(), F.col("root").asc()], "_pos")
    ranked = ranked.withColumn("component_id", F.col("_pos") - 1 + start)
    # the components that rank first may hold most rows, any other one has at most one row in HOT
    large = ranked.filter(F.col("_pos") <= HOT).select(F.col("root").alias("id"))
    return spread_join(cc, ranked.drop("_pos"), "root", large).drop("root")


# J8
def induced_subgraph(edges: DataFrame, node_set: DataFrame) -> DataFrame:
    ids = node_set.select("id").distinct()
    return (edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
                 .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))


# G10
def n_hop(edges: DataFrame, n: int, starts: DataFrame, include_start: bool = True) -> DataFrame:
    """(start, node) pairs within ``n`` undirected hops of the given starts
    (a frame with an ``id`` column).  Frontier expansion with set semantics
    per hop, seeded with the starts, so work follows what they reach."""
    adj = both_directions(undirected(edges)).toDF("a", "b")
    reach = starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct() \
        .join(adj.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("start", "node")
    frontier = reach
    for _ in range(n):
        step = frontier.join(adj, frontier.node == adj.a).select("start", F.col("b").alias("node")).distinct()
        frontier = step.join(reach, ["start", "node"], "left_anti")
        reach = reach.union(frontier)
    return reach if include_start else reach.filter(F.col("start") != F.col("node"))


# G12
def average_clustering(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Average clustering coefficient of the undirected simple projection,
    nodes of degree < 2 count as 0.

    Triangles are listed once with a degree ordering: each edge is oriented
    from the lower (degree, id) end to the higher one, wedges are formed only
    at their lowest vertex (out-degree <= sqrt(2m)), then closed by a join.
    """
    und = undirected(edges)
    deg = degrees(und)
    ranked = und.join(deg.toDF("src", "ds"), "src").join(deg.toDF("dst", "dd"), "dst")
    lo_first = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    ori = ranked.select(F.when(lo_first, F.col("src")).otherwise(F.col("dst")).alias("a"),
                        F.when(lo_first, F.col("dst")).otherwise(F.col("src")).alias("b"))
    wedges = ori.alias("x").join(ori.alias("y"), F.col("x.a") == F.col("y.a")) \
                .filter(F.col("x.b") < F.col("y.b")) \
                .select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("y.b").alias("c"))
    closing = und.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    tri = wedges.join(closing.union(closing.select(F.col("c").alias("b"), F.col("b").alias("c"))),
                      ["b", "c"])
    per_node = (tri.select(F.explode(F.array("a", "b", "c")).alias("id"))
                   .groupBy("id").agg(F.count(F.lit(1)).alias("triangles")))
    all_nodes = nodes.select("id").distinct()
    c = (all_nodes.join(deg.withColumnRenamed("src", "id") if "src" in deg.columns else deg, "id", "left")
                  .join(per_node, "id", "left").fillna(0, ["degree", "triangles"]))
    coef = F.when(F.col("degree") < 2, F.lit(0.0)).otherwise(
        2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1)))
    return c.agg(F.avg(coef).alias("avg_clustering"),
                 F.sum("triangles").alias("triangle_corners"))


def average_clustering_directed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Average clustering of a directed graph (Fagiolo's generalisation, the
    form networkx applies to a DiGraph): with b_uv = a_uv + a_vu,
    c_u = sum over triangles {u, v, w} of b_uv b_vw b_wu divided by
    d_tot (d_tot - 1) - 2 d_recip, and 0 where that is 0.  Triangles are
    listed once on the undirected projection with the degree ordering of
    :func:`average_clustering`, carrying the pair weights."""
    d = edges.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct()
    pairs = (d.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"))
              .groupBy("x", "y").agg(F.count(F.lit(1)).alias("b")))       # b in {1, 2}
    deg = pairs.select(F.explode(F.array("x", "y")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    ranked = pairs.join(deg.toDF("x", "kx"), "x").join(deg.toDF("y", "ky"), "y")
    lo_first = (F.col("kx") < F.col("ky")) | ((F.col("kx") == F.col("ky")) & (F.col("x") < F.col("y")))
    ori = ranked.select(F.when(lo_first, F.col("x")).otherwise(F.col("y")).alias("a"),
                        F.when(lo_first, F.col("y")).otherwise(F.col("x")).alias("c"), "b")
    wedges = (ori.alias("p").join(ori.alias("q"), F.col("p.a") == F.col("q.a"))
                 .filter(F.col("p.c") < F.col("q.c"))
                 .select(F.col("p.a").alias("a"), F.col("p.c").alias("u"), F.col("q.c").alias("v"),
                         (F.col("p.b") * F.col("q.b")).alias("w2")))
    close = pairs.select(F.col("x").alias("u"), F.col("y").alias("v"), F.col("b").alias("w3")).unionByName(
        pairs.select(F.col("y").alias("u"), F.col("x").alias("v"), F.col("b").alias("w3")))
    tri = wedges.join(close, ["u", "v"]).select("a", "u", "v", (F.col("w2") * F.col("w3")).alias("t"))
    per = (tri.select(F.explode(F.array("a", "u", "v")).alias("id"), "t")
              .groupBy("id").agg(F.sum("t").alias("t")))
    dtot = (d.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id")
              .agg(F.count(F.lit(1)).alias("dtot")))
    drec = pairs.filter(F.col("b") == 2).select(F.explode(F.array("x", "y")).alias("id")) \
                .groupBy("id").agg(F.count(F.lit(1)).alias("drec"))
    c = (nodes.select("id").distinct().join(dtot, "id", "left").join(drec, "id", "left").join(per, "id", "left")
              .fillna(0, ["dtot", "drec", "t"]))
    den = F.col("dtot") * (F.col("dtot") - 1) - 2 * F.col("drec")
    coef = F.when((den > 0) & (F.col("t") > 0), F.col("t") / den).otherwise(F.lit(0.0))
    return c.agg(F.avg(coef).alias("avg_clustering"))


# G13
def rich_club(edges: DataFrame) -> DataFrame:
    """Un-normalised rich-club coefficient phi(k) = 2 E_k / (N_k (N_k - 1))
    for every k with N_k > 1, where N_k = nodes of degree > k and E_k = edges
    between them.  One row per k in [0, max degree] (the output itself);
    N_k and E_k come from equi joins of that axis with the degree and
    edge-min-degree histograms and a distributed running sum over k."""
    from convgraph.operators.relations import global_running_sum
    und = undirected(edges)
    deg = degrees(und)
    dh = deg.groupBy(F.col("degree").alias("k")).agg(F.count(F.lit(1)).alias("_nd"))
    em = (und.join(deg.toDF("src", "ds"), "src").join(deg.toDF("dst", "dd"), "dst")
             .groupBy(F.least("ds", "dd").alias("k")).agg(F.count(F.lit(1)).alias("_ne")))
    tot = deg.agg(F.count(F.lit(1)).alias("_tn"), F.max("degree").alias("_mx")).crossJoin(
        und.agg(F.count(F.lit(1)).alias("_te")))
    ks = tot.select(F.explode(F.sequence(F.lit(0), F.col("_mx"))).alias("k"))
    axis = (ks.join(dh, "k", "left").join(em, "k", "left")
              .select("k", F.coalesce("_nd", F.lit(0)).alias("_nd"), F.coalesce("_ne", F.lit(0)).alias("_ne")))
    axis = global_running_sum(axis, [F.col("k")], "_nd", "_cn")
    axis = global_running_sum(axis, [F.col("k")], "_ne", "_ce")
    out = axis.crossJoin(F.broadcast(tot)).select(
        "k", (F.col("_tn") - F.col("_cn")).alias("n_k"), (F.col("_te") - F.col("_ce")).alias("e_k"))
    out = out.filter("n_k > 1")
    return out.select("k", (2.0 * F.col("e_k") / (F.col("n_k") * (F.col("n_k") - 1))).alias("phi"))


#: Ways through a node (in * out) up to which it may be contracted.
WAYS = 16


# G3
def is_dag(edges: DataFrame, order: DataFrame | None = None) -> bool:
    """True when the directed graph has no cycle.

    ``order`` (id, columns of a total order) is a certificate: if every edge
    ascends in it, one pass proves the graph acyclic.  Otherwise every round

    * removes the nodes that are a source or a sink, which lie on no cycle; if
      edges remain and there is none, every node has a way in and a way on, so
      there is a cycle;
    * contracts nodes with few ways through them (in * out <= ``WAYS``): their
      predecessors are linked to their successors, so each cycle through them
      stays as a shorter one, in the end as a self loop.  Of adjacent such
      nodes the one with the smallest hash of the round is taken.  While the
      graph has more edges than twice the first ones, only nodes that leave no
      more edges than they had are.

    So the rounds grow with the logarithm of the depth on chains, ladders and
    other narrow graphs, where removing sources and sinks alone needs a round
    per level.  Contracted nodes have at most ``WAYS`` edges a side; joins with
    hubs go through :func:`spread_join`.
    """
    e = edges.select("src", "dst").distinct()
    if order is not None:
        keys = [c for c in order.columns if c != "id"]
        key = order.select("id", F.struct(*keys, "id").alias("_k"))
        bad = (e.join(key.toDF("src", "_ks"), "src", "left").join(key.toDF("dst", "_kd"), "dst", "left")
                .filter(~F.coalesce(F.col("_ks") < F.col("_kd"), F.lit(False))))
        if bad.limit(1).count() == 0:
            return True
    e = cut_lineage(e)
    first = n = e.count()
    rnd = 0
    try:
        while n:
            if e.filter(F.col("src") == F.col("dst")).limit(1).count():
                return False
            ends = e.select(F.inline(F.array(
                F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
            few = F.col("o") * F.col("i") <= WAYS
            if n > 2 * first:
                few &= F.col("o") * F.col("i") <= F.col("o") + F.col("i")
            inner = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i")) \
                .filter((F.col("o") > 0) & (F.col("i") > 0)).select("id", few.alias("few"))
            hot = hot_nodes(e, "src", "dst", n)
            rows = spread_join(e, inner.toDF("src", "few_src"), "src", hot)
            live = cut_lineage(spread_join(rows, inner.toDF("dst", "few_dst"), "dst", hot), replaces=e)
            release(hot)
            e, before, n = live, n, live.count()
            if n == before:  # neither source nor sink is left
                return False
            rnd += 1
            e = _contract(live, rnd)
            n = e.count()
        return True
    finally:
        release(e)


def _contract(e: DataFrame, rnd: int) -> DataFrame:
    """Edges (src, dst, few_src, few_dst) without the nodes that win among
    their neighbours with few ways; their predecessors are linked to their
    successors."""
    def draw(c):
        return F.struct(F.xxhash64(F.col(c), F.lit(rnd)), F.col(c))
    both = F.col("few_src") & F.col("few_dst")
    asked = e.select(F.inline(F.array(
        F.struct(F.col("src").alias("id"), F.col("few_src").alias("few"), (both & (draw("src") > draw("dst"))).alias("lost")),
        F.struct(F.col("dst").alias("id"), F.col("few_dst").alias("few"), (both & (draw("dst") > draw("src"))).alias("lost")))))
    won = asked.filter("few").groupBy("id").agg(F.max("lost").alias("lost")).filter(~F.col("lost")).select("id")

    def marked(rows, end):  # only nodes with few ways can win: a key has at most WAYS rows
        few = rows.filter(f"few_{end}").join(won.select(F.col("id").alias(end), F.lit(True).alias(f"won_{end}")), end, "left")
        return few.unionByName(rows.filter(f"NOT few_{end}").withColumn(f"won_{end}", F.lit(None).cast("boolean")))
    rows = cut_lineage(marked(marked(e, "src"), "dst")
                       .select("src", "dst", F.coalesce("won_src", F.lit(False)).alias("won_src"),
                               F.coalesce("won_dst", F.lit(False)).alias("won_dst")), replaces=e)
    into = rows.filter("won_dst").select(F.col("src").alias("a"), F.col("dst").alias("via"))
    onto = rows.filter("won_src").select(F.col("src").alias("via"), F.col("dst").alias("b"))
    through = into.join(onto, "via").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return cut_lineage(rows.filter("NOT won_src AND NOT won_dst").select("src", "dst").unionByName(through).distinct(),
                       replaces=rows)


# G18
def border_pairs(edges: DataFrame, community: DataFrame) -> DataFrame:
    """Edges whose ends lie in different communities (community: id, community)."""
    c = community.select("id", "community")
    return (edges.join(c.toDF("src", "c_src"), "src").join(c.toDF("dst", "c_dst"), "dst")
                 .filter(F.col("c_src") != F.col("c_dst")))


# G19
def disconnect(edges: DataFrame, community: DataFrame, seed: int = 42) -> DataFrame:
    """Nodes to remove so no border edge is left: per border pair drop the
    lower-degree end; tie -> the end in the larger community; tie -> the end
    with the smaller md5(seed:id).  Degrees are fixed before removal."""
    csize = community.groupBy("community").agg(F.count(F.lit(1)).alias("csize"))
    # one row per node, also where an id comes with several communities
    per = community.join(csize, "community").groupBy("id").agg(
        F.min("community").alias("lo"), F.max("community").alias("hi"), F.collect_set("csize").alias("s"))
    per = cut_lineage(per.join(degrees(edges), "id").select("id", "lo", "hi", "s", F.col("degree").alias("d")))
    bp = (edges.select("src", "dst").join(per.toDF("src", "lo_src", "hi_src", "s_src", "d_src"), "src")
               .join(per.toDF("dst", "lo_dst", "hi_dst", "s_dst", "d_dst"), "dst")
               .filter(F.least("lo_src", "lo_dst") != F.greatest("hi_src", "hi_dst")))
    h_src = F.md5(F.concat(F.lit(f"{seed}:"), F.col("src").cast("string")))
    h_dst = F.md5(F.concat(F.lit(f"{seed}:"), F.col("dst").cast("string")))
    src, dst, none = F.col("src"), F.col("dst"), F.lit(None).cast(edges.schema["src"].dataType)
    even = F.when(F.arrays_overlap("s_src", "s_dst"), F.when(h_src < h_dst, src).otherwise(dst))
    by_size = F.array(F.when(F.array_max("s_src") > F.array_min("s_dst"), src),
                      F.when(F.array_max("s_dst") > F.array_min("s_src"), dst), even)
    drop = (F.when(F.col("d_src") < F.col("d_dst"), F.array(src, none, none))
             .when(F.col("d_dst") < F.col("d_src"), F.array(dst, none, none)).otherwise(by_size))
    return bp.select(F.explode(drop).alias("id")).filter(F.col("id").isNotNull()).distinct()


def top_k_per_key(df: DataFrame, key: str, order: list[str], k: int, salt_col: str,
                  salt_buckets: int = 16) -> DataFrame:
    """The first ``k`` rows per ``key`` in ``order`` (W4), skew-safe: rank
    inside (key, hash(salt_col) % buckets) groups first, keep k per group,
    then rank the at most k * buckets survivors per key."""
    salted = df.withColumn("_salt", F.abs(F.xxhash64(salt_col)) % salt_buckets)
    w1 = Window.partitionBy(key, "_salt").orderBy(*order)
    pre = salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy(key).orderBy(*order)
    return pre.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= k).drop("_r")


# G22
def context_text(edges: DataFrame, nodes: DataFrame, max_neighbours: int = 6,
                 salt_buckets: int = 16) -> DataFrame:
    """For every node: its neighbours within two undirected hops, the
    ``max_neighbours`` oldest by (created_at, id), plus the node itself, in
    time order, each rendered as a tagged block and joined by a space.

    nodes: (id, created_at, user, text).  Exact pruning keeps the blow-up
    linear in the edges: a two-hop candidate x reached through m can only be
    among the k oldest if it is among the k+1 oldest neighbours of m (the
    +1 covers the start node itself), so the second hop joins the full
    first hop with neighbour lists cut to k+1.  The per-node top-k runs on
    salted groups first, so a hub's candidates are ranked by many tasks.
    """
    k = max_neighbours
    info = nodes.select("id", "created_at")
    adj = both_directions(undirected(edges)).toDF("a", "b") \
        .join(info.toDF("b", "b_ts"), "b")
    near = top_k_per_key(adj, "a", ["b_ts", "b"], k + 1, "b", salt_buckets)
    hop1 = near.select(F.col("a").alias("start"), F.col("b").alias("node"), F.col("b_ts").alias("ts"))
    hop2 = (adj.select(F.col("a").alias("start"), F.col("b").alias("m"))
               .join(near.withColumnRenamed("a", "m"), "m")
               .select("start", F.col("b").alias("node"), F.col("b_ts").alias("ts")))
    cand = hop1.union(hop2).filter(F.col("start") != F.col("node")).distinct()
    top = top_k_per_key(cand, "start", ["ts", "node"], k, "node", salt_buckets)
    blocks = nodes.select("id", "created_at",
                          F.concat(F.lit("[context] ["), F.col("user"), F.lit("]: "), F.col("text"),
                                   F.lit(" \n [/context]")).alias("ctx"),
                          F.concat(F.lit("[main_tweet] ["), F.col("user"), F.lit("]: "), F.col("text"),
                                   F.lit(" \n [/main_tweet]")).alias("main"))
    ctx_rows = top.join(blocks.select(F.col("id").alias("node"), "ctx"), "node") \
                  .select(F.col("start").alias("id"), F.col("ts"), F.col("node").alias("nid"),
                          F.col("ctx").alias("block"))
    main_rows = blocks.select("id", F.col("created_at").alias("ts"), F.col("id").alias("nid"),
                              F.col("main").alias("block"))
    allr = ctx_rows.union(main_rows)
    # at most k + 1 blocks per node: the collected list is bounded
    return (allr.groupBy("id")
                .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "nid", "block"))),
                                              lambda s: s["block"]), " ").alias("text_and_context")))


from convgraph.session import pickle_by_value  # noqa: E402

pickle_by_value(__name__)
