"""Column names of any kind through the pipeline's stages, and words that a
64-bit hash takes for equal."""
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from convgraph.llm import common as L
from convgraph.llm.exact_dedup import keep_first
from convgraph.llm.minhash_hamming import keep_one
from convgraph.llm.quality_ledger import ledger
from convgraph.llm.substring_dedup import substring_dedup
from convgraph.llm.toxicity_chain import keep_clean
from test_chat_toxicity_html import DOCS, toxic_rows

NAMES = ["src-url", "a b", "a.b", "_old", "_row", "_key", "back`tick", "salt", "h", "id", "kept", "component_id", "text_sha256", "é"]
#: Two words with the same value of ``word_hashes``.
TWINS = ("collisionexample", "dajmknzgPxWDRK)S")


def named_docs(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), None) for i, t, s in rows], DOCS)
    for n in NAMES:
        docs = docs.withColumn(n, F.concat(F.lit(n + " "), "source"))
    return docs


def check(docs, out):
    assert out.columns == docs.columns
    for r in out.collect():
        assert all(r[n] == f"{n} {r['source']}" for n in NAMES)


ROWS = [(1, "a b c d e f g h i j k l m n", "1"), (2, "a b c d e f g h i j k l m o", "2"), (3, "a b c d e f g h i j k l m n", "3"),
        (4, None, "4"), (5, "", "5")]


@pytest.mark.parametrize("extra", [[], [(None, "x", "n1"), (None, "x", "n2"), (1, "y", "again")]])
def test_names_through_the_stages(spark, extra):
    docs = named_docs(spark, ROWS + extra)
    check(docs, keep_first(docs))
    check(docs, keep_one(docs))
    out = C.substrings(spark, docs, "")
    check(docs, out)
    got = {r["source"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got["2"] == ("o", 1) and got["1"] == (ROWS[0][1], 27) and "3" not in got
    rows, labels = toxic_rows()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    many = named_docs(spark, [(r[0], r[1], str(r[0])) for r in rows])
    check(many, keep_clean(many, lab))
    assert C.packing(spark, docs, "").count() >= 5


def test_twins_have_one_hash():
    data = np.frombuffer(" ".join(TWINS).encode(), np.uint8)
    s, e, _ = L.word_spans(data, np.array([0, len(data)]))
    h = L.word_hashes(data, s, e)
    assert h[0] == h[1]
    assert L.exact_ids(data, s, e, h, np.zeros(2, np.int64))[0].tolist() in ([0, 1], [1, 2])


def test_windows_of_twins_are_different_windows(spark):
    words = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"{words} {TWINS[0]}"), (2, f"{words} {TWINS[1]}"), (3, f"{words} {TWINS[1]} x"), (4, f"{TWINS[0]} {words}")]
    out = {r.doc_id: (r.n_removed, r.kept) for r in
           substring_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert out == {1: (0, docs[0][1]), 2: (0, docs[1][1]), 3: (13, "x"), 4: (0, docs[3][1])}


def test_rules_tell_twins_apart(spark):
    text = f"p q {TWINS[0]} p q {TWINS[1]}"
    lines = f"{TWINS[0]}\n{TWINS[1]}\n{TWINS[0]}\n{TWINS[0]}"
    docs = [(1, text), (2, f"p q {TWINS[0]} p q {TWINS[0]}"), (3, lines), (4, text)]
    out = {r.doc_id: (r.n_repeat_words, r.n_dup_lines) for r in ledger(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()}
    assert out == {1: (0, 0), 2: (6, 0), 3: (0, 2), 4: (0, 0)}


def test_equal_ranges_against_bytes():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 2, 9000).astype(np.uint8)
    data[4500:] = data[:4500]
    n = np.concatenate([rng.integers(0, 40, 400), [4400, 4400, 4400]])
    a = np.concatenate([rng.integers(0, 4000, 400), [0, 1, 3]])
    b = np.where(rng.random(403) < 0.5, a + 4500, rng.integers(0, 4000, 403))
    b[-3:] = [4500, 4501, 4500]
    want = [data[x:x + k].tobytes() == data[y:y + k].tobytes() for x, y, k in zip(a, b, n)]
    assert L.equal_ranges(data, a, b, n).tolist() == want and 20 < sum(want) < 390


def test_twins_are_different_shingles(spark):
    from convgraph.llm.minhash_hamming import near_dedup
    rows = [(i, f"a b c {w} e f") for i, w in enumerate(TWINS)] + [(2, "A b c collisionexample e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 0}
