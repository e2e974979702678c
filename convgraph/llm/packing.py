"""Packing: minimum bin slack.

Texts become token ids (plus an end id).  Every text of at least ``capacity``
ids first gives up full windows; what remains of each text is shorter than a
window.  The remainders are packed window by window: a bitset subset-sum
dynamic program over the multiset of remaining lengths finds the sum closest
to the capacity, and backtracking through the bitsets tells how many pieces of
each length to take.  A multiset that fits is used as often as the counts
allow.  Where no multiset fills a window, one more remainder is cut to fill
it, so only the last window of a task can be short; it is laid out as windows
whose sizes are powers of two, which need no padding either.

Each task packs its own input split in pools of at most ``pool_tokens`` ids:
no shuffle, bounded memory, and the same sequences again if a task is rerun.

Defined results: a null or empty text is one piece of one id (the end id);
equal texts and repeated ids are packed one by one; pieces of one text may
come from several windows, each id is in exactly one piece; an empty table
gives an empty table.
"""
from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, functions as F

from convgraph.llm.common import id_text, worker_cache
from convgraph.llm.token_counts import byte_symbols

CAPACITY = 2048
END_ID = 1
POOL_TOKENS = 4_000_000
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, sequence_tokens long")


def closest_multiset(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """{length: how many} whose sum is the largest one not above capacity."""
    full = 1 << capacity
    mask = (full << 1) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, size = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            size *= 2
            if reach & full:
                break
        if reach & full:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> at & 1:  # this sum needs the step
            used[length] += take
            at -= length * take
    return dict(used)


def plan_windows(lengths: list[int], capacity: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Windows filled to capacity, each a list of (item, start in the item,
    length), and the pieces left over (shorter than a window together)."""
    stock: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for item in range(len(lengths) - 1, -1, -1):
        stock[lengths[item]].append((item, 0))
    counts = {n: len(v) for n, v in stock.items()}
    total = sum(lengths)
    windows: list[list[tuple[int, int, int]]] = []

    def take(length):
        item, start = stock[length].pop()
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        return item, start, length

    while total >= capacity:
        used = closest_multiset(counts, capacity)
        slack = capacity - sum(n * k for n, k in used.items())
        repeat = 1 if slack else min(counts[n] // k for n, k in used.items())
        for _ in range(repeat):
            window = [take(n) for n in sorted(used, reverse=True) for _ in range(used[n])]
            if slack:  # nothing that is left fits: cut the shortest that fills the window
                item, start, length = take(min(n for n in counts if n > slack))
                window.append((item, start, slack))
                stock[length - slack].append((item, start + slack))
                counts[length - slack] = counts.get(length - slack, 0) + 1
            windows.append(window)
            total -= capacity
    rest = [take(n) for n in sorted(counts, reverse=True) for _ in range(counts[n])]
    return windows, rest


def power_windows(pieces: list[tuple[int, int, int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Lay fewer than ``capacity`` ids out as windows of power-of-two sizes."""
    total, windows = sum(p[2] for p in pieces), []
    queue = list(reversed(pieces))
    size = 1 << (capacity.bit_length() - 1)
    while total:
        while size > total:
            size >>= 1
        window, room = [], size
        while room:
            item, start, length = queue.pop()
            cut = min(length, room)
            window.append((item, start, cut))
            if cut < length:
                queue.append((item, start + cut, length - cut))
            room -= cut
        windows.append(window)
        total -= size
    return windows


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file.

    Where the file's ids follow its merges (checked), the same merges run in
    the faster tiktoken; texts with very long unbroken runs, on which that is
    quadratic, and files of another kind go through tokenizers itself."""

    def __init__(self, path: str, pattern: str):
        import json
        import os
        import re
        import tiktoken
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        of_char = {c: b for b, c in enumerate(byte_symbols())}
        self.long_run = re.compile(r"\S{2000}|\s{2000}")
        self.fast = None
        if all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) \
                and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word")
                            for t in spec.get("added_tokens") or []):
            special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
            ranks = {bytes(of_char[c] for c in token): i for token, i in vocab.items() if token not in special}
            self.fast = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        import numpy as np
        if not text:
            return b""
        if self.fast is not None and not self.long_run.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def pack_pool(pool: list[tuple], capacity: int, first_sequence: int, close: bool):
    """pool: (id, start, ids as bytes, tokens of the text), each shorter than a
    window.  Returns (piece rows, next sequence number, pool left over)."""
    import zlib
    rows, seq = [], first_sequence
    windows, rest = plan_windows([len(p[2]) // 4 for p in pool], capacity)
    if close:
        windows, rest = windows + power_windows(rest, capacity), []
    for window in windows:
        offset, size = 0, sum(p[2] for p in window)
        for item, start, length in window:
            doc, begin, ids, total = pool[item]
            rows.append((doc, begin + start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), total,
                         seq, offset, size))
            offset += length
        seq += 1
    left = [(pool[i][0], pool[i][1] + s, pool[i][2][4 * s:4 * (s + n)], pool[i][3]) for i, s, n in rest]
    return rows, seq, left


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None,
         capacity: int = CAPACITY, end_id: int = END_ID, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, sequence_tokens).  ``sequence_id`` is the task number
    in the high bits and a running number in the low 33 bits."""
    import public_tokenizers
    path, pattern = path or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        import zlib
        import pyarrow as pa
        from pyspark import TaskContext
        box = worker_cache(f"encoder-{path}")
        if "encoder" not in box:
            box["encoder"] = Encoder(path, pattern)
        encode = box["encoder"]
        seq = TaskContext.get().partitionId() << 33
        names = [f.split()[0] for f in SCHEMA.split(", ")]

        def table(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in zip(*rows)], names=names)

        pool, held, rows = [], 0, []
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for r in range(batch.num_rows):
                doc, data = ids[r].as_py(), encode(texts[r].as_py()) + end
                total = len(data) // 4
                at = 0
                while total - at >= capacity:
                    piece = data[4 * at:4 * (at + capacity)]
                    rows.append((doc, at, capacity, zlib.crc32(piece), total, seq, 0, capacity))
                    seq, at = seq + 1, at + capacity
                if at < total:
                    pool.append((doc, at, data[4 * at:], total))
                    held += total - at
                if held >= pool_tokens:
                    more, seq, pool = pack_pool(pool, capacity, seq, False)
                    held = sum(len(p[2]) // 4 for p in pool)
                    rows += more
                if len(rows) > 20_000:
                    yield table(rows)
                    rows = []
        more, seq, _ = pack_pool(pool, capacity, seq, True)
        rows += more
        if rows:
            yield table(rows)

    # The ids are packed in the order in which the split holds them.
    out = id_text(docs, id_col, text_col).select(F.col("id").cast("long"), "text").mapInArrow(run, SCHEMA)
    return out.withColumnRenamed("doc_id", id_col)
