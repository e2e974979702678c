"""Cross-tokenizer alignment against a token-by-token walk with the libraries."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import public_tokenizers as P
from convgraph.llm import tokenizer_alignment as T

ZERO = (0, 0, 0, 0, 0, 0, "")


@pytest.fixture(scope="module")
def tokens():
    return T.Tokens(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN)


def walk(tokens, text):
    """(ids a, ids b, groups as text, links) or None."""
    if not text:
        return None
    a = tokens.library_a().encode(" " + text, add_special_tokens=False).ids
    b = tokens.b.encode(text)
    want = (" " + text).encode()
    if any(b"".join(table[i] for i in ids) != want for ids, table in ((a, tokens.bytes_a), (b, tokens.bytes_b))):
        return None
    i = j = 0
    end_a, end_b = len(tokens.bytes_a[a[0]]), len(tokens.bytes_b[b[0]])
    group, groups, links = ([a[0]], [b[0]]), [], []
    while True:
        links.append((a[i], b[j]))
        next_a, next_b = end_a <= end_b, end_b <= end_a
        if next_a and next_b:
            groups.append("|".join(",".join(map(str, x)) for x in group))
            group = ([], [])
        if next_a:
            i += 1
            if i == len(a):
                return a, b, groups, links
            end_a += len(tokens.bytes_a[a[i]])
            group[0].append(a[i])
        if next_b:
            j += 1
            end_b += len(tokens.bytes_b[b[j]])
            group[1].append(b[j])


def brute(tokens, texts):
    walks = [walk(tokens, t) for t in texts]
    counts = Counter(x for w in walks if w for x in w[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    rows = [ZERO if w is None else
            (len(w[0]), len(w[1]), len(w[2]), len(w[3]), sum(counts[x] == best[x[1]] for x in w[3]),
             sum(counts[x] for x in w[3]), hashlib.sha256(";".join(w[2]).encode()).hexdigest()) for w in walks]
    return rows, {(a, b): (n, n == best[b]) for (a, b), n in counts.items()}


def texts():
    rng = random.Random(5)
    words = ["the", "Straße", "naïve", "don't", "123456", "é", "日本語", "😀", "<s>", "<|endoftext|>", "<0x41>", "--", "\n",
             "\t\t", "", "", "x" * 40, "=" * 30, "\0", "ñandú", "　", "\r\n"]
    out = [None, "", " ", "  ", "a▁b", "▁", "x", "é" * 900, "a " * 700, "ab" * 800 + " c", "e" * 5000]
    out += [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 30, 400]))) for _ in range(60)]
    return out + out[-3:]


@pytest.mark.parametrize("range_bytes,hot_pairs", [(1 << 16, 1 << 18), (100, 50), (37, 0), (1500, 1)])
def test_equals_the_walk(spark, tokens, range_bytes, hot_pairs):
    held = texts()
    ids = [*range(len(held) - 3), None, None, 0]
    docs = spark.createDataFrame(list(zip(ids, held)), "doc_id long, text string").repartition(3)
    out, lexicon = T.tokenizer_alignment(docs, range_bytes=range_bytes, hot_pairs=hot_pairs)
    want, pairs = brute(tokens, held)
    got = sorted(((r.doc_id is None, r.doc_id or 0), tuple(r)[1:]) for r in out.collect())
    assert got == sorted(((i is None, i or 0), w) for i, w in zip(ids, want))
    assert {(r.a, r.b): (r.n, r.best) for r in lexicon.collect()} == pairs


def test_monoid_is_associative(tokens):
    """Any byte ranges, reduced in any order, give the groups of the whole."""
    rng = random.Random(1)
    text = " ".join(texts()[-9:])
    a, b = tokens.ids_a(" " + text), tokens.ids_b([text])[0]
    ends_a, ends_b = np.cumsum(tokens.len_a[a]), np.cumsum(tokens.len_b[b])
    whole = T._closed_part(tokens, (a, ends_a, b, ends_b))
    for _ in range(30):
        cuts = sorted({0, int(ends_a[-1]), *(rng.randrange(int(ends_a[-1])) for _ in range(rng.randrange(40)))})
        row, parts = [], []
        for lo, hi in zip(cuts, cuts[1:]):
            run = []
            for ids, ends in ((a, ends_a), (b, ends_b)):
                i, j = np.searchsorted(ends, [lo, hi], side="right")
                run += [ids[i:j], ends[i:j]]
            fragment, closed = T.Fragment.of(*run)
            row.append(fragment)
            parts += [closed] if closed else []
        row.insert(0, T.Fragment(closed=True))
        while len(row) > 1:
            i = rng.randrange(len(row) - 1)
            both, closed = row[i].then(row[i + 1])
            row[i:i + 2] = [both]
            parts += [closed] if closed else []
        assert row[0].closed and not any(len(x) for x in row[0].suffix + row[0].prefix)
        done = sorted((T._closed_part(tokens, p) for p in parts), key=lambda p: p["at"])
        assert "".join(p["text"] for p in done) == whole["text"]
        assert sum(p["n_links"] for p in done) == whole["n_links"]
        links = Counter()
        for p in done:
            links.update(dict(zip(p["codes"], p["times"])))
        assert links == dict(zip(whole["codes"], whole["times"]))


@pytest.mark.parametrize("size,shift", [(10, 0), (10, 5), (64, 32)])
def test_pieces_are_tokenised_as_the_whole(tokens, size, shift):
    for text in texts():
        if not text:
            continue
        cut = list(T.pieces(text, size, shift))
        assert np.concatenate([tokens.ids_a(" " + p) for _, p in cut]).tolist() == tokens.ids_a(" " + text).tolist()
        assert np.concatenate(tokens.ids_b([p for _, p in cut])).tolist() == tokens.b.encode(text)
        assert " ".join(p for _, p in cut) == text
        for at, piece in cut:
            assert (" " + text).encode()[at:].startswith(b" " + piece.encode())


def test_empty_table_and_clashing_columns(spark, tokens):
    names = ["rid", "id", "chunk", "codes", "n_a", "closed", "a b", "x.y"]
    docs = spark.createDataFrame([("k%d" % i, t, *["?"] * len(names)) for i, t in enumerate(["a b c", None, "d " * 100])],
                                 "doc_id string, text string" + "".join(f", `{n}` string" for n in names))
    out, _ = T.tokenizer_alignment(docs, range_bytes=50)
    assert sorted(tuple(r) for r in out.collect()) == [
        ("k%d" % i, *w) for i, w in enumerate(brute(tokens, ["a b c", None, "d " * 100])[0])]
    out, lexicon = T.tokenizer_alignment(docs.limit(0))
    assert out.count() == 0 and lexicon.count() == 0
