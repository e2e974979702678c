"""Substring dedup, MinHash near-dedup and the quality ledger against brute
force, on the given tables and on hand-made edge cases."""
import collections
import hashlib
import random
import re

import numpy as np
import pytest

from convgraph.llm import minhash_hamming as M
from convgraph.llm import substring_dedup as S
from convgraph.llm.common import text_slices, word_hashes, word_spans
from convgraph.llm.quality_ledger import BIT, POLICIES, ablation, apply_policy, ledger, policy_mask
from convgraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, kept boolean, key string, tag long, node long"


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "k", 1, 2) for i, t in rows], SCHEMA)


def passage(rnd, n):
    return [rnd.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rnd.randint(0, 400))
            for _ in range(n)]


def planted(seed=1):
    """Copies, near copies, shared passages, loops, a word pair that is very
    common, nulls, repeated ids and a long text."""
    rnd = random.Random(seed)
    rows, base, common = [], passage(rnd, 120), passage(rnd, 60)
    for i in range(40):
        own = passage(rnd, rnd.randint(0, 150))
        if i % 3 == 0:
            own = own[:50] + common + own[50:]
        if i % 4 == 0:
            own = [x for w in own for x in (w, "of", "the")]
        rows.append((100 - i, "  ".join(own) + "\n"))
    for i in range(25):
        near = list(base)
        for _ in range(rnd.randint(0, 6)):
            near[rnd.randrange(len(near))] = f"edit{rnd.randint(0, 99)}"
        rows.append((200 + i, " ".join(near)))
    rows += [(300, "x y " * 40), (301, "x y " * 30), (302, None), (303, ""), (304, " \n\t "), (305, "one two"),
             (306, "ONE  Two"), (307, "one two three four five"), (None, " ".join(base)), (None, "lonely null id"),
             (308, " ".join(base)), (309, " ".join(passage(rnd, 30_000)))]
    rows += [(310, " ".join(common)), (310, " ".join(common)), (310, "another text of the same id")]
    return rows


# ------------------------------------------------------------ substring dedup

def expected_substrings(rows, window=13):
    top = float("inf")
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for j in range(len(w) - window + 1):
            k = tuple(w[j:j + window])
            first[k] = min(first.get(k, top), top if i is None else i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j:j + window])] < (top if i is None else i):
                gone[j:j + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("share", [S.HOT_SHARE, 50])
def test_substring_dedup_planted(spark, share, monkeypatch):
    monkeypatch.setattr(S, "HOT_SHARE", share)
    monkeypatch.setattr(S.duplicate_spans, "__defaults__", (S.WINDOW, None, share))
    rows = planted()
    got = sorted(map(tuple, S.substring_dedup(frame(spark, rows).repartition(5)).collect()), key=repr)
    assert got == expected_substrings(rows)


def test_substring_dedup_documents(spark):
    want = [(i, n, r, hashlib.sha256(k.encode()).hexdigest()) for i, n, r, k in expected_substrings(documents(spark))]
    got = sorted(map(tuple, QUERIES["op6_substring_dedup"](spark, SF).collect()), key=repr)
    assert got == sorted(want, key=repr) and sum(r[2] for r in got) > 0


def test_substring_dedup_empty(spark):
    assert S.substring_dedup(frame(spark, [])).collect() == []


def test_super_kmers_cover_every_window_once():
    rnd = np.random.default_rng(3)
    words = rnd.integers(0, 2 ** 63, 500).astype(np.uint64)
    first = np.array([0, 0, 120, 125, 300, 300])
    at, n, _ = S.super_kmers(words, first, np.zeros(0, np.uint64))
    covered = [p for a, k in zip(at, n) for p in range(a, a + k)]
    ends = [120, 125, 300, 500]
    want = [p for a, z in zip([0, 120, 125, 300], ends) for p in range(a, z - 12)]
    assert covered == want


# ------------------------------------------------------------ near dedup

def lower(t):
    return (t or "").translate(str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)}))


def shingles(t):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def expected_components(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            equal = sets[a] == sets[b]
            if not sets[a] or not sets[b] or (not equal and (rows[a][0] is None or rows[b][0] is None)):
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(b)] = find(a)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i)) if sets[i] else d, d == (low.get(find(i)) if sets[i] else d))
                   for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("block", [512, 7])
def test_near_dedup_planted(spark, block, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", block)
    rows = planted()
    got = sorted(map(tuple, M.near_dedup(frame(spark, rows).repartition(4)).collect()), key=repr)
    assert got == expected_components(rows)


def test_near_dedup_of_long_texts_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_SHINGLES", 60)
    rows = planted()
    got = sorted(map(tuple, M.near_dedup(frame(spark, rows).repartition(4)).collect()), key=repr)
    assert got == expected_components(rows)


def test_near_dedup_at_eighty(spark):
    rows = planted(7)
    got = sorted(map(tuple, M.near_dedup(frame(spark, rows), percent=80, chunks=10).collect()), key=repr)
    assert got == expected_components(rows, 80)


def test_near_dedup_documents(spark):
    got = sorted(map(tuple, QUERIES["op8_minhash_hamming"](spark, SF).collect()), key=repr)
    assert got == expected_components(documents(spark)) and not all(r[3] for r in got)


def test_near_dedup_empty(spark):
    assert M.near_dedup(frame(spark, [])).collect() == []


def test_every_wanted_pair_shares_a_key():
    """Pigeonhole: 2 m - 1 wrong symbols leave a chunk with at most one."""
    rnd = random.Random(5)
    for _ in range(300):
        wrong = set(rnd.sample(range(35), 13))
        assert any(len([s for s in range(c * 5, c * 5 + 5) if s in wrong]) <= 1 for c in range(7))


# ------------------------------------------------------------ words and rules

def test_word_hashes_follow_the_bytes():
    import pyarrow as pa
    texts = ["a b", "", "abcdefgh abcdefghi", "é\x0bé \x1c", "y" * 1000 + " " + "y" * 1000, " end "]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    (lo, hi, data, offs), = text_slices(batch)
    s, e, first = word_spans(data, offs)
    words = [bytes(data[a:z]) for a, z in zip(s, e)]
    assert words == [w.encode() for t in texts for w in WORD.findall(t)]
    h = word_hashes(data, s, e).tolist()
    assert (len(set(h)), len(set(words))) == (len(set(words)),) * 2
    assert [x == h[0] for x in h] == [w == words[0] for w in words]


def expected_measures(t):
    t = t or ""
    w = WORD.findall(t)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    covered = [False] * len(w)
    for j in range(len(w) - 2):
        if grams[tuple(w[j:j + 3])] > 1:
            covered[j:j + 3] = [True] * 3
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(covered)


def test_ledger_measures_and_policies(spark):
    rows = planted() + documents(spark) + [(400, "a b\na b\n\n \na b \nx"), (401, "### ***\n### ***"), (402, "WOW!! " * 80)]
    led = ledger(frame(spark, rows)).cache()
    got = sorted(tuple(r)[:6] for r in led.fillna(-1, ["doc_id"]).collect())
    assert got == sorted((-1 if i is None else i, *expected_measures(t)) for i, t in rows)
    kept = {p: apply_policy(led, p).where("kept").count() for p in POLICIES}
    assert kept["base"] >= kept["v1"] >= kept["v2"] > 0
    table = {r.rule: r for r in ablation(led, "v2").collect()}
    failed = [r.failed for r in led.collect()]
    mask = policy_mask("v2")
    for name, r in table.items():
        assert r.n_failed == sum(bool(f & BIT[name]) for f in failed)
        assert r.n_failed_alone == sum(f & mask == BIT[name] for f in failed)
        assert r.n_kept_without == sum(f & mask & ~BIT[name] == 0 for f in failed)
    assert ledger(frame(spark, [])).collect() == []
    assert ablation(ledger(frame(spark, [])), "base").first().n_rows == 0


def test_rules_keep_good_documents(spark):
    """Labelled good rows that pass the base rules all stay; of the bad ones
    nearly all go."""
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op7_quality_ledger"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.kept for r in out if r.quality == 1 and not r.base_failed)
    bad = [r.kept for r in out if r.quality == 0]
    assert sum(bad) <= 0.05 * len(bad)
