"""The Merkle manifest against a plain recursive one."""
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from convgraph.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return H(*["-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in M.FIELDS])


def rounds(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [H(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
        out.append(nodes)
    return out


def proof(levels, i):
    out = []
    for nodes in levels[:-1]:
        a = i // 8 * 8
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1:a + 8])))
        i //= 8
    return out


def brute(rows):
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)), r))
    langs = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    per = {v: rounds([k[2] for k, _ in sorted(trees[v], key=lambda x: x[0])]) for v in langs}
    top = rounds([per[v][-1][0] for v in langs])
    return sorted((repr(v), i, x, per[v][-1][0], top[-1][0], proof(per[v], i) + proof(top, t))
                  for t, v in enumerate(langs) for i, x in enumerate(per[v][0]))


def collected(df):
    return sorted((repr(r.lang), r.position, r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in df.collect())


@pytest.mark.parametrize("digits", [1, 3])
def test_equals_the_recursive_tree(spark, digits):
    rng = random.Random(3)
    sizes = {"en": 100, "de": 64, "fr": 65, "es": 8, "it": 9, "a": 1, None: 3, "": 7, "é": 2, "z\U0001f600": 1}
    rows = [(rng.randrange(1000), "T%d é" % rng.randrange(50), lang, rng.choice(["s", None]), rng.choice([None, 7]))
            for lang, n in sizes.items() for _ in range(n)]
    rows += [rows[0]] * 20 + [(None, None, "en", "", 0), (None, "x", "en", "", 0)]
    rng.shuffle(rows)
    out = M.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), digits=digits)
    want = brute(rows)
    assert collected(out) == want
    bad = out.where(M.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count()
    assert bad == 0


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 512, 513])
def test_sizes_of_one_tree(spark, n):
    rows = [(i, "t", "en", "s", 1) for i in range(n)]
    assert collected(M.manifest(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_carried_and_clashing_columns(spark):
    names = ["tree", "pos", "digest", "item", "proof", "top", "kids", "_drawn", "a b", "x.y"]
    rows = spark.createDataFrame([(i, "T" * i, "en", "s", 1, *["?"] * len(names)) for i in range(20)],
                                 SCHEMA + "".join(f", `{n}` string" for n in names))
    out = M.manifest(rows, shown=F.when(F.col("doc_id") == 3, M.leaf(text=F.lower("text"))).otherwise(M.leaf()))
    verdict = {r.doc_id: r.ok for r in out.select(
        "doc_id", (M.fold(F.col("shown"), F.col("proof")) == F.col("root")).alias("ok")).collect()}
    assert verdict == {i: i != 3 for i in range(20)}
    assert collected(out) == brute([(i, "T" * i, "en", "s", 1) for i in range(20)])


def test_no_join_between_nodes(spark):
    rows = spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(600)], SCHEMA)
    plan = M.manifest(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
