"""Property and brute-force checks for the iterative and scale-safe paths."""
import random
from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from convgraph.operators import graph as G
from convgraph.operators import relations as R
from convgraph.operators import sampling as H


def _components_bruteforce(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {n: min(m for m in nodes if find(m) == find(n)) for n in nodes}


def test_connected_components_long_chain_and_star(spark):
    rnd = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 300)]            # a long chain
    edges += [(1000, 1000 + k) for k in range(1, 60)]       # a hub
    edges += [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(80)]
    nodes = sorted({x for e in edges for x in e} | {5000, 5001})
    e = spark.createDataFrame(edges, "src long, dst long")
    n = spark.createDataFrame([(x,) for x in nodes], "id long")
    got = {r["id"]: r["root"] for r in G.connected_components(e, n).collect()}
    assert got == _components_bruteforce(nodes, edges)


def test_global_positions_equal_row_number(spark):
    rows = [(random.Random(i).randrange(0, 50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "v long, k long")
    got = {r["k"]: r["pos"] for r in R.global_positions(df, ["v", "k"], "pos", 7).collect()}
    exp = {r["k"]: r["rn"] for r in df.withColumn("rn", F.row_number().over(Window.orderBy("v", "k"))).collect()}
    assert got == exp


def test_is_dag_detects_cycles(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long")
    assert G.is_dag(chain)
    cyc = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(200, 50)], "src long, dst long")
    assert not G.is_dag(cyc)
    loop = spark.createDataFrame([(1, 2), (3, 3)], "src long, dst long")
    assert not G.is_dag(loop)


def test_group_split_keeps_groups_whole(spark):
    df = spark.range(0, 3000).select(F.col("id"), (F.col("id") % 97).alias("g"))
    sp = H.split_by_groups(df, "g", 0.6, 0.2, 42)
    per_group = sp.groupBy("g").agg(F.countDistinct("split").alias("k")).filter("k > 1").count()
    assert per_group == 0
    counts = {r["split"]: r["n"] for r in sp.groupBy("split").agg(F.countDistinct("g").alias("n")).collect()}
    assert counts["test"] == 20 and counts["val"] == 20 and counts["train"] == 57


def test_border_cut_leaves_no_border_edge(spark):
    rnd = random.Random(3)
    edges = sorted({(min(a, b), max(a, b)) for a, b in
                    ((rnd.randrange(0, 120), rnd.randrange(0, 120)) for _ in range(400)) if a != b})
    e = spark.createDataFrame(edges, "src long, dst long")
    comm = spark.createDataFrame([(i, i % 5) for i in range(120)], "id long, community long")
    gone = G.disconnect(e, comm)
    kept = e.join(gone.withColumnRenamed("id", "src"), "src", "left_anti") \
            .join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    assert G.border_pairs(kept, comm).count() == 0


def test_context_text_pruning_matches_bruteforce(spark):
    rnd = random.Random(11)
    edges = [(0, k) for k in range(1, 40)] + [(k, 100 + k) for k in range(1, 40)]
    edges += [(rnd.randrange(100, 140), rnd.randrange(100, 140)) for _ in range(30)]
    edges = [(a, b) for a, b in edges if a != b]
    ids = sorted({x for e in edges for x in e})
    ts = {i: rnd.randrange(0, 10 ** 6) * 1000 + i for i in ids}
    nodes = spark.createDataFrame([(i, ts[i], f"u{i}", f"t{i}") for i in ids],
                                  "id long, created_at long, user string, text string")
    got = {r["id"]: r["text_and_context"] for r in
           G.context_text(spark.createDataFrame(edges, "src long, dst long"), nodes).collect()}
    adj = defaultdict(set)
    for a, b in edges:
        adj[a].add(b)
        adj[b].add(a)
    for s in ids:
        near = set(adj[s]) | {x for m in adj[s] for x in adj[m]}
        near.discard(s)
        chosen = sorted(near, key=lambda x: (ts[x], x))[:6] + [s]
        blocks = [f"[main_tweet] [u{x}]: t{x} \n [/main_tweet]" if x == s else f"[context] [u{x}]: t{x} \n [/context]"
                  for x in sorted(chosen, key=lambda x: (ts[x], x))]
        assert got[s] == " ".join(blocks)


def test_next_in_sequence_matches_lead(spark):
    from convgraph.plans.standins import next_in_sequence
    rnd = random.Random(5)
    rows = [(i, rnd.choice([1, 1, 1, 2, 3]), f"2024-01-0{rnd.randrange(1, 4)} {rnd.randrange(0, 24):02d}:00:00")
            for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string") \
              .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r["event_id"]: r["next_event_id"] for r in next_in_sequence(df, "user_id", "ts", "event_id", 3600).collect()}
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    exp = {r["event_id"]: r["n"] for r in df.withColumn("n", F.lead("event_id").over(w)).collect()}
    assert got == exp


def test_communities_improve_modularity(spark):
    from convgraph.operators import community as C
    # four dense blocks joined by single bridges
    edges = []
    for b in range(4):
        base = b * 10
        edges += [(base + i, base + j) for i in range(10) for j in range(i + 1, 10) if (i + j) % 3]
        edges.append((base, (base + 10) % 40))
    e = spark.createDataFrame(edges, "src long, dst long")
    single = C.modularity(e, e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
                          .withColumn("community", F.col("id"))).first()[0]
    for part in (C.louvain(e, 1.0), C.greedy_modularity(e, 1.0), C.fluid_communities(e, 4)):
        assert part.select("id").distinct().count() == part.count() == 40
        q = C.modularity(e, part).first()[0]
        assert q > single and q > 0.5


def test_exact_percentiles_match_numpy(spark):
    import numpy as np
    rnd = random.Random(13)
    rows = [(g, float(rnd.choice([rnd.randrange(0, 30), rnd.random() * 100]))) for g in range(3) for _ in range(97 + g * 50)]
    df = spark.createDataFrame(rows, "g long, v double")
    ps = [0.0, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {(r["g"], r["p"]): r["v"] for r in R.exact_percentiles(df, "v", ps, "g").collect()}
    for g in range(3):
        vals = np.array([v for gg, v in rows if gg == g])
        for p in ps:
            assert abs(got[(g, p)] - float(np.percentile(vals, p * 100))) < 1e-9


def test_rich_club_matches_bruteforce(spark):
    rnd = random.Random(21)
    edges = sorted({(min(a, b), max(a, b)) for a, b in
                    ((rnd.randrange(0, 40), rnd.randrange(0, 40)) for _ in range(150)) if a != b})
    deg = defaultdict(int)
    for a, b in edges:
        deg[a] += 1
        deg[b] += 1
    got = {r["k"]: r["phi"] for r in G.rich_club(spark.createDataFrame(edges, "src long, dst long")).collect()}
    exp = {}
    for k in range(0, max(deg.values()) + 1):
        rich = {n for n, d in deg.items() if d > k}
        if len(rich) > 1:
            ek = sum(1 for a, b in edges if a in rich and b in rich)
            exp[k] = 2.0 * ek / (len(rich) * (len(rich) - 1))
    assert got.keys() == exp.keys()
    assert all(abs(got[k] - exp[k]) < 1e-12 for k in exp)


def test_directed_clustering_matches_definition(spark):
    rnd = random.Random(4)
    arcs = {(rnd.randrange(0, 25), rnd.randrange(0, 25)) for _ in range(120)}
    arcs = {(a, b) for a, b in arcs if a != b}
    nodes = list(range(27))
    A = {(a, b): 1 for a, b in arcs}
    a = lambda x, y: A.get((x, y), 0)
    exp = []
    for u in nodes:
        t = sum((a(u, v) + a(v, u)) * (a(v, w) + a(w, v)) * (a(w, u) + a(u, w)) for v in nodes for w in nodes)
        dtot = sum(a(u, v) + a(v, u) for v in nodes)
        drec = sum(a(u, v) * a(v, u) for v in nodes)
        den = 2 * (dtot * (dtot - 1) - 2 * drec)
        exp.append(t / den if t > 0 and den > 0 else 0.0)
    e = spark.createDataFrame(sorted(arcs), "src long, dst long")
    n = spark.createDataFrame([(x,) for x in nodes], "id long")
    got = G.average_clustering_directed(e, n).first()[0]
    assert abs(got - sum(exp) / len(exp)) < 1e-12


def test_cut_lineage_release_deletes_superseded_round(spark):
    import os
    from convgraph.session import cut_lineage
    a = cut_lineage(spark.range(0, 100))
    path_a = a._cut_path.replace("file:", "")
    b = cut_lineage(a.selectExpr("id * 2 AS id"), replaces=a)
    assert b.count() == 100 and b.agg(F.max("id")).first()[0] == 198
    assert not os.path.exists(path_a)


def test_dense_ids_of_long_texts(spark):
    """Prefixes that tie, texts that are the prefix of others, nulls, copies and
    characters whose UTF-16 order differs from their code points."""
    rng = random.Random(6)
    stem = "é" * (R.PREFIX - 1)
    texts = [None, "", "a", stem, stem + "x", stem + "xa", stem + "xb" * 300, stem + "\U0001f600", stem + "\uffee", "\U0001f600", "\uffee"]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randrange(120))) for _ in range(200)] + ["b" * R.PREFIX + c for c in "zyx"]
    rows = [(i, rng.choice(texts)) for i in range(900)]
    out = R.dense_ids(spark.createDataFrame(rows, "i long, t string").repartition(5), ["t"], "n", 3)
    assert out.columns == ["i", "t", "n"]
    rank = {t: k + 3 for k, t in enumerate(sorted({t for _, t in rows if t is not None}, key=lambda t: t.encode()))}
    assert sorted(tuple(r) for r in out.select("i", "n").collect()) == [(i, rank.get(t)) for i, t in rows]


def test_components_around_hubs(spark):
    """Hubs above and below the cut for hot nodes, at both ends of the ids."""
    rnd = random.Random(5)
    edges = [(100000, i) for i in range(1, 1200)] + [(5000, i) for i in range(5001, 6300)]
    edges += [(rnd.randrange(20000, 24000), rnd.randrange(20000, 24000)) for _ in range(2500)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["root"] for r in G.connected_components(
        spark.createDataFrame(edges, "src long, dst long"),
        spark.createDataFrame([(x,) for x in parent], "id long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_by_contraction_write_little(spark, monkeypatch):
    """Rounds above SMALL edges shrink, so all of them write a few times the edges."""
    rnd, written = random.Random(11), []
    monkeypatch.setattr(G, "SMALL", 20)
    cut = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df, **k: (lambda out: (written.append(out.count()), out)[1])(cut(df, **k)))
    edges = [(i, i + 1) for i in range(3000)] + [(10000, 10000 + i) for i in range(1, 1500)]
    edges += [(rnd.randrange(20000, 21000), rnd.randrange(20000, 21000)) for _ in range(900)] + [(-5, 30000), (30001, 30001)]
    nodes = sorted({x for e in edges for x in e} | {40000})
    got = {r["id"]: r["root"] for r in G.connected_components(
        spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(x,) for x in nodes], "id long")).collect()}
    by_root = {}
    for n, root in got.items():
        by_root.setdefault(root, set()).add(n)
    assert all(root == min(members) for root, members in by_root.items()) and set(got) == set(nodes)
    assert {got[x] for x in range(3001)} == {0} and {got[10000 + i] for i in range(1500)} == {10000} and got[30000] == -5
    assert all(got[a] == got[b] for a, b in edges) and len({got[x] for x in (30001, 40000)}) == 2
    assert sum(written) < 15 * len(edges)


def test_spread_join_moves_no_hot_rows(spark):
    rows = spark.range(0, 5000).selectExpr("if(id < 3000, 7, id) AS u", "id AS w")
    edges = rows.selectExpr("u", "w AS v")
    hot = G.hot_nodes(edges, "u", "v", 5000)
    assert 7 in [r["id"] for r in hot.collect()] and hot.count() <= 2 * G.HOT
    table = rows.groupBy("u").count()
    for how in ("inner", "left"):
        out = G.spread_join(rows, table, "u", hot, how)
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows.join(table, "u", how).collect()))
    some = table.filter("u % 2 = 1").select("u")
    assert G.spread_join(rows, some, "u", hot, "left_semi").count() == rows.join(some, "u", "left_semi").count()


def test_is_dag_on_a_deep_ladder(spark, monkeypatch):
    """Two nodes a level, all linked to the next level: rounds do not grow with the depth."""
    rounds = []
    contract = G._contract
    monkeypatch.setattr(G, "_contract", lambda e, r: rounds.append(r) or contract(e, r))
    levels = 120
    ladder = [(2 * i + a, 2 * i + 2 + b) for i in range(levels) for a in (0, 1) for b in (0, 1)]
    assert G.is_dag(spark.createDataFrame(ladder, "src long, dst long"))
    assert len(rounds) <= 30
    assert not G.is_dag(spark.createDataFrame(ladder + [(2 * levels + 1, 5)], "src long, dst long"))


@pytest.mark.parametrize("seed", range(4))
def test_is_dag_against_search(spark, seed):
    rnd = random.Random(seed)
    n = rnd.randrange(5, 40)
    pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randrange(4, 2 * n))]
    edges = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
    if seed % 2:
        a, b = rnd.choice(edges)
        edges.append((b, a))

    def search():
        left = set(edges)
        while left:
            heads, tails = {a for a, _ in left}, {b for _, b in left}
            rest = {(a, b) for a, b in left if a in tails and b in heads}
            if rest == left:
                return False
            left = rest
        return True
    assert G.is_dag(spark.createDataFrame(edges, "src long, dst long")) == search()


def test_join_per_group_keeps_large_groups_apart(spark, monkeypatch):
    monkeypatch.setattr(R, "LARGEST", 2)
    rows = spark.range(0, 4000).selectExpr("CASE WHEN id < 3000 THEN id % 2 WHEN id < 3010 THEN NULL ELSE id % 50 END AS g", "id AS v")
    per = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    out = R.join_per_group(rows.repartition(16), per, "g", "n")
    key = lambda d: sorted(tuple(r) for r in d.select("g", "v", "n").collect())
    assert key(out) == key(rows.join(per, "g"))
    held = out.filter("g < 2").groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert held < 1000  # 3040 rows in two groups


def _labels(df):
    return {r["id"]: r["community"] for r in df.collect()}


def test_communities_over_parts_and_in_one_task_agree(spark, monkeypatch):
    """Rounds over parts of the graph give what the rounds in one task give."""
    from convgraph.operators import community as C
    rnd = random.Random(3)
    edges = [(b * 10 + rnd.randrange(10), b * 10 + rnd.randrange(10)) for b in range(3) for _ in range(40)] + [(0, 10), (10, 20), (900, 901)]
    e = spark.createDataFrame(edges, "src long, dst long").cache()
    runs = (lambda: C.louvain(e), lambda: C.greedy_modularity(e, 1.0, 2), lambda: C.fluid_communities(e, 3))
    at_once = [_labels(run()) for run in runs]
    monkeypatch.setattr(C, "FEW", 40)
    monkeypatch.setattr(C, "PART", 60)
    assert [_labels(run()) for run in runs] == at_once
    assert all(len(x) == 32 for x in at_once) and at_once[2][900] is None


def test_small_communities_write_few_tables(spark, monkeypatch):
    """A graph of bounded size goes through all rounds in one task: the jobs do
    not grow with the rounds."""
    from convgraph.operators import community as C
    cuts, cut = [], C.cut_lineage
    monkeypatch.setattr(C, "cut_lineage", lambda *a, **k: cuts.append(1) or cut(*a, **k))
    edges = [(10 * r + i, 10 * r + j) for r in range(4) for i in range(5) for j in range(i)] + [(0, 10), (10, 20), (20, 30)]
    e = spark.createDataFrame(edges, "src long, dst long")
    for run in (lambda: C.louvain(e), lambda: C.greedy_modularity(e), lambda: C.fluid_communities(e, 4)):
        cuts.clear()
        assert len(_labels(run())) == 20 and len(cuts) <= 3


def test_draws_in_tasks_are_those_of_spark(spark):
    import numpy as np
    from convgraph.operators.community_arrays import xxhash64
    rows = [(5, 7), (-3, 2 ** 40), (10 ** 12, -1)]
    got = spark.createDataFrame(rows, "a long, b long").select(
        F.xxhash64("a"), F.xxhash64("a", "b"), F.xxhash64("a", F.lit(3))).collect()
    a, b = (np.array(x) for x in zip(*rows))
    assert [tuple(r) for r in got] == list(zip(*(x.tolist() for x in (xxhash64(a), xxhash64(a, b), xxhash64(a, np.int32(3))))))


def test_disconnect_of_ids_with_several_communities(spark):
    """Every community an id comes with counts, as does every size at a tie."""
    import hashlib
    rnd = random.Random(8)
    edges = sorted({(rnd.randrange(0, 30), rnd.randrange(0, 30)) for _ in range(45)})
    comm = [(i, rnd.randrange(0, 4)) for i in range(30)] + [(i, rnd.randrange(0, 4)) for i in range(0, 30, 3)] + [(31, None)]
    size, of, deg = defaultdict(int), defaultdict(list), defaultdict(int)
    for i, c in comm:
        size[c] += 1
        of[i].append(c)
    for a, b in edges:
        deg[a] += 1
        deg[b] += 1
    def mark(x):
        return hashlib.md5(f"42:{x}".encode()).hexdigest()
    want = set()
    for a, b in edges:
        if not any(x != y for x in of[a] for y in of[b]):
            continue
        for x in of[a]:
            for y in of[b]:
                if deg[a] != deg[b]:
                    want.add(a if deg[a] < deg[b] else b)
                elif size[x] != size[y]:
                    want.add(a if size[x] > size[y] else b)
                else:
                    want.add(a if mark(a) < mark(b) else b)
    got = G.disconnect(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(comm, "id long, community long"), 42)
    assert {r["id"] for r in got.collect()} == want


def test_cut_components_reads_the_order_lines_once(spark, monkeypatch):
    """The edges are made once, not by every step that reads them."""
    from convgraph.plans import q_graph as Q, standins as S
    made, build = [], S.e2_edges
    monkeypatch.setattr(S, "e2_edges", lambda *a: made.append(1) or build(*a))
    assert Q.cut_components(spark, "/root/testdata/sf0.001").count() and len(made) == 1
