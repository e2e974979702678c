"""Token counts: heap-and-linked-list byte-pair merging.

The symbols of a word form a linked list; a heap holds the adjacent pairs that
the merge list knows, and the pair of lowest rank (leftmost among equals) is
popped and merged until none is left.  The count is the number of initial
symbols less the merges; no identifier is ever looked up for output.

Work is per distinct word and worker: texts are cut at single spaces (see
``pretokens``) and counts of chunks and words are remembered in memos of
bounded size.  No shuffle; memory is the memos plus one Arrow batch.

Defined results: null and empty texts have 0 bytes and 0 tokens; a special
string inside a text counts as one token, as the library does by default; a
null id is carried; an empty table gives an empty table.
"""
from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from convgraph.llm.common import id_text, worker_cache
from convgraph.llm.pretokens import chunks, memo


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level
    vocabularies: printable Latin-1 stands for itself, the rest follows 255."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


def load_merges(path: str):
    """(symbol of each byte, {(left, right): (rank, joined symbol)}, special
    strings) of a tokenizers file; symbols are small integers."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    number: dict[str, int] = {}

    def sym(s):
        return number.setdefault(s, len(number))
    of_byte = [sym(s) for s in byte_symbols()]
    pairs = {}
    for rank, m in enumerate(spec["model"]["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        pairs[(sym(a), sym(b))] = (rank, sym(a + b))
    special = [t["content"] for t in spec.get("added_tokens") or []]
    return of_byte, pairs, special


def merged_length(symbols: list[int], pairs: dict) -> int:
    """Number of symbols left after all merges: initial symbols minus merges."""
    n = len(symbols)
    if n < 2:
        return n
    sym = list(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        found = pairs.get((sym[i], sym[i + 1]))
        if found is not None:
            heap.append((found[0], i, sym[i], sym[i + 1], found[1]))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _rank, i, left, right, joined = heapq.heappop(heap)
        j = after[i]
        if sym[i] != left or j >= n or sym[j] != right:
            continue  # one of the two has been merged meanwhile
        merges += 1
        sym[i], sym[j] = joined, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            found = pairs.get((joined, sym[k]))
            if found is not None:
                heapq.heappush(heap, (found[0], i, joined, sym[k], found[1]))
        h = before[i]
        if h >= 0:
            found = pairs.get((sym[h], joined))
            if found is not None:
                heapq.heappush(heap, (found[0], h, sym[h], joined, found[1]))
    return n - merges


class TokenCounter:
    """Counts the tokens of texts; one per worker process and vocabulary."""

    def __init__(self, path: str, pattern: str):
        import regex
        self.of_byte, self.pairs, special = load_merges(path)
        self.match = regex.compile(pattern).findall
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) \
            if special else None
        self.words = memo(f"count-word-{path}", self.word)
        self.first = memo(f"count-first-{path}", self.chunk)
        self.rest = memo(f"count-rest-{path}", self.chunk, " ")

    def word(self, word: str) -> int:
        of = self.of_byte
        return merged_length([of[b] for b in word.encode("utf-8")], self.pairs)

    def chunk(self, chunk: str) -> int:
        return sum(map(self.words.__getitem__, self.match(chunk)))

    def plain(self, text: str) -> int:
        parts = chunks(text)
        return self.first[parts[0]] + sum(map(self.rest.__getitem__, parts[1:]))

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if self.special is not None and self.special.search(text):
            pieces = self.special.split(text)
            return len(pieces) - 1 + sum(self.plain(p) for p in pieces if p)
        return self.plain(text)

    def trim(self):
        for m in (self.words, self.first, self.rest):
            m.trim()


def token_count_udf(path: str, pattern: str):
    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        box = worker_cache(f"counter-{path}")
        if "counter" not in box:
            box["counter"] = TokenCounter(path, pattern)
        counter = box["counter"]
        for texts in batches:
            out = []
            for i, t in enumerate(texts):
                out.append(counter(t))
                if not i % 64:
                    counter.trim()
            yield pd.Series(out, dtype="int64")
    return n_tokens


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 path: str | None = None, pattern: str | None = None, limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row."""
    if pattern is None:
        import public_tokenizers
        pattern = public_tokenizers.PATTERN
    count = token_count_udf(path or vocabulary_path(), pattern)
    rows = id_text(docs, id_col, text_col)
    return (rows.select(F.col("id").alias(id_col), F.octet_length("text").cast("long").alias("n_bytes"),
                        count("text").alias("n_tokens"))
                .withColumn("over_limit", F.col("n_tokens") > limit))
