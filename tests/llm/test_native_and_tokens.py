"""Exact dedup, token counts, BPE and packing against brute force and the
public libraries, with hand-made edge cases."""
import base64
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from convgraph.llm import packing as P
from convgraph.llm.bpe_duckdb import Codec, decode, encode
from convgraph.llm.exact_dedup import exact_dedup, keep_first
from convgraph.llm.queries import ORACLES, QUERIES
from convgraph.llm.token_counts import TokenCounter, token_counts

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, kept boolean, id string, norm string, salt int"
EDGE = [
    (5, "a  b", True, "x", "n", 1), (3, "a\t\nb", None, None, None, None), (9, "a b", False, "y", "m", 2),
    (4, None, None, None, None, None), (2, "", None, None, None, None), (7, " ", None, None, None, None),
    (None, "a b", None, None, None, None), (None, "only null ids", None, None, None, None),
    (8, "rep", None, None, None, None), (8, "rep", None, None, None, None), (8, "other", None, None, None, None),
    (1, "é" * 70_000 + " <|endoftext|> end", None, None, None, None),
]


def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def tiktoken_encoding():
    import public_tokenizers
    import tiktoken
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def expected_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup_edges(spark):
    got = sorted((tuple(r) for r in exact_dedup(edge(spark)).collect()), key=repr)
    assert got == expected_exact([(r[0], r[1]) for r in EDGE])
    assert exact_dedup(empty(spark)).collect() == []


def test_exact_dedup_compares_bytes_when_the_hash_collides(spark):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weak = exact_dedup(df, hash_128=lambda t: F.unhex(F.lit("00")))
    assert sorted((tuple(r) for r in weak.collect()), key=repr) == expected_exact(rows)


def test_exact_dedup_is_native(spark):
    plan = exact_dedup(edge(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_keep_first_keeps_columns(spark):
    kept = keep_first(edge(spark))
    assert kept.columns == edge(spark).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 7, 8, 8, 8]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    res = con.execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(res.fetchall(), key=repr)


def awkward_texts():
    rnd = random.Random(4)
    texts = ["", "a", " ", "  a  b \n\n c\t d ", "a" * 3000, "ab" * 500, " lead", "trail ", "<|endoftext|>",
             "x<|endoftext|><|endoftext|> y", "日本語  テキスト", "\x1c \x85y   z", "'s 'll don't", "1234567 89", " " * 2500 + "x"]
    texts += ["".join(rnd.choice("ab '’sé1.\n\t<|中") for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    return texts


def test_heap_counts_equal_the_library():
    import public_tokenizers
    counter = TokenCounter(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    lib = library()
    for t in awkward_texts():
        assert counter(t) == len(lib.encode(t, add_special_tokens=False).ids), repr(t)


def test_token_counts_edges(spark):
    lib = library()
    got = sorted(map(tuple, token_counts(edge(spark)).collect()), key=repr)
    want = []
    for i, t, *_ in EDGE:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert got == sorted(want, key=repr)
    assert token_counts(empty(spark)).collect() == []


def test_duckdb_codec_equals_tiktoken():
    import public_tokenizers
    codec = Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    enc = tiktoken_encoding()
    rnd = random.Random(8)
    texts = awkward_texts() + ["".join(rnd.choice("abcdefghij") for _ in range(700)),
                               "".join(rnd.choice("aab") for _ in range(400))]
    got = codec.encode(texts)
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t), repr(t)
    assert codec.decode(got) == [t.encode() for t in texts]
    with pytest.raises(ValueError):
        codec.decode([np.array([50256], "<u4").tobytes()])


def test_encode_decode_edges(spark):
    enc = tiktoken_encoding()
    got = decode(encode(edge(spark))).collect()
    want = sorted(((i, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in EDGE), key=repr)
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got), key=repr) == want
    assert decode(encode(empty(spark))).collect() == []


def test_closest_multiset_is_best():
    rnd = random.Random(2)
    for _ in range(200):
        counts = {rnd.randint(1, 30): rnd.randint(1, 4) for _ in range(rnd.randint(1, 6))}
        cap = rnd.randint(5, 64)
        sums = {0}
        for n, k in counts.items():
            sums = {s + n * j for s in sums for j in range(k + 1) if s + n * j <= cap}
        used = P.closest_multiset(counts, cap)
        assert all(0 < used[n] <= counts[n] for n in used)
        assert sum(n * k for n, k in used.items()) == max(sums)


def check_packing(pieces, texts):
    lib = library()
    by_doc, by_seq = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    want = {}
    for i, t in texts:
        want.setdefault(i, []).append(lib.encode(t or "", add_special_tokens=False).ids + [1])
    assert set(by_doc) == set(want)
    for i, rows in by_doc.items():
        assert sum(r.length for r in rows) == sum(map(len, want[i]))
        for r in rows:
            ids = [w[r.start:r.start + r.length] for w in want[i] if len(w) == r.doc_tokens]
            assert r.ids_crc32 in {zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids}
    for rows in by_seq.values():
        rows.sort(key=lambda r: r.offset)
        at = 0
        for r in rows:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == 2048 or at & (at - 1) == 0  # no padding at all
        assert at <= 2048


def test_packing_edges(spark):
    check_packing(P.pack(edge(spark)).collect(), [(r[0], r[1]) for r in EDGE])
    assert P.pack(empty(spark)).collect() == []


def test_packing_small_pools(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_packing(P.pack(docs, pool_tokens=9000).collect(), [(r.doc_id, r.text) for r in docs.collect()])
