"""Cross-tokenizer alignment: an associative fragment monoid.

Two tokenizers cut the bytes of space + text into tokens; the offsets where both
end a token cut the text into groups.  The tokens of any byte range form a
fragment: an open prefix (up to the first common end), the closed groups between
the first and the last common end, and an open suffix.  Putting two fragments
side by side closes one group at most, the left one's suffix with the right
one's prefix, and this is associative, so the fragments of a text can be reduced
as a tree in any grouping.

A text of up to ``RANGE`` bytes is one range and is aligned where it is read.
A longer one is cut into pieces before single spaces, where neither tokenizer
has a token across, at other places for either tokenizer, and the pieces are
tokenised in tasks of their own.  The tokens then go by their last byte to
ranges of ``RANGE`` bytes, which may cut through groups and links; every range
yields its fragment, and rounds of ``FAN`` neighbours each reduce them to one a
text.  A round carries the open ends only; what it closes (the groups as text,
the links) stays with the row that closed it.  At the end the closed parts of a
text go through SHA-256 in order, one part at a time.

The links of a text are stored as distinct id pairs with their number.  Corpus
counts are summed from them, combined per task.  Pairs that make up at least one link
in ``HOT_PAIRS``, so at most that many pairs, are sent to all tasks; the others
meet their counts in a shuffle join.  What is the highest count of an id of the
second tokenizer is one row per id of its vocabulary.

Defined results: a text that is null or empty, or that one of the tokenizers
does not give back byte by byte, has no tokens: zeros and the empty string; rows
that repeat an id or a text, and rows with a null id, are texts of their own; an
empty table gives an empty one.
"""
from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from convgraph.llm.common import dropped, id_text, stored, text_slices, worker_cache

#: Bytes of a range, and about the code points of a piece of a long text.
RANGE = 1 << 16
#: Neighbouring fragments that one round of the reduction composes.
FAN = 8
#: Pairs with at least one link in this many are sent to all tasks (16 bytes each).
HOT_PAIRS = 1 << 18
#: Distinct pairs that a task counts before it hands its sums on.
FLUSH_PAIRS = 1_000_000
#: Bytes of text whose tokens and links are held at once.
SLICE = 400_000

_SAFE = re.compile(r"(?<=\S) (?=\S)")


class Tokens:
    """Both tokenizers: ids, and the bytes of each id."""

    def __init__(self, path_a: str, path_b: str, pattern: str):
        import sentencepiece
        from convgraph.llm.packing import Encoder, byte_symbols
        a = Encoder(path_a, pattern)
        of_char = {c: b for b, c in enumerate(byte_symbols())}
        self.a = a
        self.bytes_a = [b""] * a.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in a.tokenizer.get_vocab(with_added_tokens=True).items():
            if all(c in of_char for c in token):
                self.bytes_a[i] = bytes(of_char[c] for c in token)
        self.path_a, self.plain_a = path_a, None
        if a.fast is not None:
            a.tokenizer = None  # most workers never need it, and two workers share an executor's memory
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i)
                                else piece.replace("▁", " ").encode())
        self.size_b = len(self.bytes_b)
        self.len_a, self.len_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        ids = range(max(len(self.bytes_a), self.size_b))
        self.width = len(ids)
        self.written = [f"{i}{sep}" for sep in ",|;" for i in ids]

    def ids_a(self, text: str) -> np.ndarray:
        """Ids of the text as it is; special strings are plain text."""
        if self.a.fast is not None and not self.a.long_run.search(text):
            return self.a.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        return np.array(self.library_a().encode(text, add_special_tokens=False).ids, dtype=np.int64)

    def library_a(self):
        if self.plain_a is None:
            from tokenizers import Tokenizer
            self.plain_a = Tokenizer.from_file(self.path_a)
            self.plain_a.encode_special_tokens = True
        return self.plain_a

    def ids_b(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with the space that the model puts before it."""
        return [np.array(x, dtype=np.int64) for x in self.b.encode(texts, num_threads=1)]

    def gives(self, ids: np.ndarray, table: list[bytes], data: bytes) -> bool:
        return b"".join(map(table.__getitem__, ids.tolist())) == data


def _tokens(path_a, path_b, pattern) -> Tokens:
    box = worker_cache(f"alignment-{path_a}-{path_b}")
    if "tokens" not in box:
        box["tokens"] = Tokens(path_a, path_b, pattern)
    return box["tokens"]


def align(ids_a, ends_a, ids_b, ends_b):
    """Of two token runs over the same bytes that end together: the end of every
    group, and the links as indices into either run."""
    at = np.searchsorted(ends_b, ends_a)
    common = ends_a[ends_b[at] == ends_a]
    begin = min(ends_a[0], ends_b[0]) - 1
    first = np.searchsorted(ends_b, np.append(begin, ends_a[:-1]), side="right")
    n = at - first + 1
    ia = np.repeat(np.arange(len(ends_a)), n)
    ib = np.arange(len(ia)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return common, ia, ib


def written(tokens: Tokens, ids_a, ends_a, ids_b, ends_b, common):
    """The groups in order as strings to be put together, one per token
    (``a1,a2|b1;`` with the separator after each)."""
    ga, gb = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    last_a, last_b = np.append(ga[1:] != ga[:-1], True), np.append(gb[1:] != gb[:-1], True)
    groups = np.arange(len(common) + 1)
    place_a = np.arange(len(ga)) + np.searchsorted(gb, groups)[ga]
    place_b = np.arange(len(gb)) + np.searchsorted(ga, groups, side="right")[gb]
    out = np.empty(len(ga) + len(gb), dtype=np.int64)
    out[place_a] = ids_a + last_a * tokens.width
    out[place_b] = ids_b + 2 * last_b * tokens.width
    return [*map(tokens.written.__getitem__, out.tolist())]


def distinct(owner: np.ndarray, codes: np.ndarray, owners: int):
    """Distinct codes of each owner with their number, as list arrays."""
    import pyarrow as pa
    span = int(codes.max(initial=0)) + 1
    keys, times = np.unique(owner * span + codes, return_counts=True)
    owner, codes = keys // span, keys % span
    cuts = pa.array(np.searchsorted(owner, np.arange(owners + 1)).astype(np.int32))
    return (pa.ListArray.from_arrays(cuts, pa.array(codes)), pa.ListArray.from_arrays(cuts, pa.array(times)))


# ------------------------------------------------------------ the monoid

class Fragment:
    """Open prefix and suffix as (ids_a, ends_a, ids_b, ends_b); a fragment
    without a common end is all prefix."""

    FIELDS = [f"{side}_{what}_{t}" for side in ("prefix", "suffix") for t in "ab" for what in ("ids", "ends")]
    SCHEMA = "closed boolean, " + ", ".join(f"{f} binary" for f in FIELDS)
    EMPTY = tuple(np.zeros(0, np.int64) for _ in range(4))

    def __init__(self, prefix=EMPTY, closed=False, suffix=EMPTY):
        self.prefix, self.closed, self.suffix = prefix, closed, suffix

    @classmethod
    def of(cls, ids_a, ends_a, ids_b, ends_b):
        """The fragment of a range, and its closed groups as a run (or None)."""
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        if not len(common):
            return cls((ids_a, ends_a, ids_b, ends_b)), None

        def part(lo, hi):
            out = []
            for ids, ends in ((ids_a, ends_a), (ids_b, ends_b)):
                i, j = np.searchsorted(ends, [lo, hi], side="right")
                out += [ids[i:j], ends[i:j]]
            return tuple(out)
        first, last = common[0], common[-1]
        closed = part(first, last) if last > first else None
        return cls(part(first - (1 << 62), first), True, part(last, last + (1 << 62))), closed

    def then(self, right: "Fragment"):
        """This fragment with the next one, and the group it closes as a run (or None)."""
        def both(x, y):
            return tuple(np.concatenate(p) for p in zip(x, y))
        if not right.closed:
            if self.closed:
                return Fragment(self.prefix, True, both(self.suffix, right.prefix)), None
            return Fragment(both(self.prefix, right.prefix)), None
        if not self.closed:
            return Fragment(both(self.prefix, right.prefix), True, right.suffix), None
        return Fragment(self.prefix, True, right.suffix), both(self.suffix, right.prefix)

    def row(self):
        return (self.closed, *[x.tobytes() for x in (*self.prefix, *self.suffix)])

    @classmethod
    def from_row(cls, row: dict):
        parts = [np.frombuffer(row[f], np.int64) for f in cls.FIELDS]
        return cls(tuple(parts[:4]), row["closed"], tuple(parts[4:]))


_PART = "at: bigint, text: string, n_groups: bigint, n_links: bigint, codes: array<bigint>, times: array<bigint>"


def _closed_part(tokens: Tokens, run):
    ids_a, ends_a, ids_b, ends_b = run
    common, ia, ib = align(*run)
    codes, times = np.unique(ids_a[ia] * tokens.size_b + ids_b[ib], return_counts=True)
    return {"at": int(ends_a[-1]), "text": "".join(written(tokens, ids_a, ends_a, ids_b, ends_b, common)),
            "n_groups": len(common), "n_links": len(ia), "codes": codes.tolist(), "times": times.tolist()}


def _record_batch(rows, schema):
    import pyarrow as pa
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow_schema(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(ddl))


# ------------------------------------------------------------ short texts

_STATS = "rid long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _short(rows: DataFrame, paths, kind) -> DataFrame:
    """Statistics and pairs of texts that are one range each."""
    def run(batches):
        import hashlib
        import pyarrow as pa
        from pyspark import TaskContext
        tokens, rid = _tokens(*paths), TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1)
            for lo, hi, data, offs in text_slices(batch, slice_bytes=SLICE):
                n = hi - lo
                held = [t.as_py() for t in texts[lo:hi]]
                of_a, of_b = [tokens.ids_a(" " + t) if t else Fragment.EMPTY[0] for t in held], tokens.ids_b(held)
                raw = data.tobytes()
                for i in range(n):
                    want = b" " + raw[offs[i]:offs[i + 1]]
                    if not held[i] or not (tokens.gives(of_a[i], tokens.bytes_a, want)
                                           and tokens.gives(of_b[i], tokens.bytes_b, want)):
                        of_a[i] = of_b[i] = Fragment.EMPTY[0]
                n_a, n_b = np.array([len(x) for x in of_a]), np.array([len(x) for x in of_b])
                stats = np.zeros((2, n), np.int64)
                shas = [""] * n
                codes, owner = Fragment.EMPTY[0], Fragment.EMPTY[0]
                if n_a.any():
                    # one run over all texts of the slice: each ends at a common end
                    ids_a, ids_b = np.concatenate(of_a), np.concatenate(of_b)
                    ends_a, ends_b = np.cumsum(tokens.len_a[ids_a]), np.cumsum(tokens.len_b[ids_b])
                    common, ia, ib = align(ids_a, ends_a, ids_b, ends_b)
                    parts = written(tokens, ids_a, ends_a, ids_b, ends_b, common)
                    cut = np.concatenate([[0], np.cumsum(n_a + n_b)])
                    for i in np.flatnonzero(n_a):
                        text = "".join(parts[cut[i]:cut[i + 1]])
                        shas[i] = hashlib.sha256(text[:-1].encode()).hexdigest()
                    of_token = np.repeat(np.arange(n), n_a)
                    owner, codes = of_token[ia], ids_a[ia] * tokens.size_b + ids_b[ib]
                    of_group = of_token[np.searchsorted(ends_a, common)]
                    stats = np.array([np.bincount(of_group, minlength=n), np.bincount(owner, minlength=n)])
                pairs = distinct(owner, codes, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(rid, rid + n)), batch.column(0)[lo:hi], pa.array(n_a), pa.array(n_b),
                     pa.array(stats[0]), pa.array(stats[1]), pa.array(shas, pa.string()), *pairs],
                    names=["rid", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"])
                rid += n
    return rows.mapInArrow(run, _STATS.format(kind=kind) + ", codes array<long>, times array<long>")


# ------------------------------------------------------------ long texts

def pieces(text: str, size: int, shift: int = 0):
    """(offset in the bytes of space + text, text without the space before it)
    of pieces of about ``size`` code points, the first shorter by ``shift``."""
    begin, at, target = 0, 0, size - shift
    while True:
        m = _SAFE.search(text, target) if target < len(text) else None
        piece = text[begin:m.start() if m else len(text)]
        yield at, piece
        if m is None:
            return
        at += 1 + len(piece.encode())
        begin, target = m.end(), m.end() + size


def _pieces(rows: DataFrame, kind: str, size: int) -> DataFrame:
    ddl = f"rid long, id {kind}, stream string, at long, text string"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        # long texts count down, short ones up, so that no row number is used twice
        rid = -1 - (TaskContext.get().partitionId() << 33)
        for batch in batches:
            for r in range(batch.num_rows):
                key, text = batch.column(0)[r:r + 1], batch.column(1)[r].as_py()
                for stream, shift in (("a", 0), ("b", size // 2)):
                    for at, piece in pieces(text, size, shift):
                        yield pa.RecordBatch.from_arrays([pa.array([rid]), key, pa.array([stream]), pa.array([at]), pa.array([piece])],
                                                         names=["rid", "id", "stream", "at", "text"])
                rid -= 1
    return rows.mapInArrow(run, ddl)


def _range_tokens(cut: DataFrame, paths, size: int) -> DataFrame:
    """(rid, stream, chunk, at, good, ids, ends): tokens of each piece by the
    range their last byte lies in."""
    ddl = "rid long, stream string, chunk long, at long, good boolean, ids binary, ends binary"

    schema = _arrow_schema(ddl)

    def run(batches):
        tokens = _tokens(*paths)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                want = b" " + r["text"].encode()
                if r["stream"] == "a":
                    ids, table, length = tokens.ids_a(" " + r["text"]), tokens.bytes_a, tokens.len_a
                else:
                    ids, table, length = tokens.ids_b([r["text"]])[0], tokens.bytes_b, tokens.len_b
                if not tokens.gives(ids, table, want):
                    out.append({**{k: r[k] for k in ("rid", "stream", "at")}, "chunk": 0, "good": False, "ids": b"", "ends": b""})
                    continue
                ends = r["at"] + np.cumsum(length[ids])
                chunk = (ends - 1) // size
                cuts = np.append(np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])), len(ids))
                for i, j in zip(cuts[:-1], cuts[1:]):
                    out.append({"rid": r["rid"], "stream": r["stream"], "chunk": int(chunk[i]), "at": r["at"], "good": True,
                                "ids": ids[i:j].tobytes(), "ends": ends[i:j].tobytes()})
            yield _record_batch(out, schema)
    return cut.repartition("rid", "stream", "at").select("rid", "stream", "at", "text").mapInArrow(run, ddl)


_FRAGMENTS = f"rid long, chunk long, {Fragment.SCHEMA}, parts array<struct<{_PART}>>"


def _fragments(good: DataFrame, paths) -> DataFrame:
    """The fragment of every range, with what it closes."""
    lists = good.groupBy("rid", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("stream", "at", "ids", "ends"))).alias("runs"))

    schema = _arrow_schema(_FRAGMENTS)

    def run(batches):
        tokens = _tokens(*paths)
        for batch in batches:
            for r in batch.to_pylist():
                four = [np.concatenate([np.frombuffer(x[what], np.int64) for x in r["runs"] if x["stream"] == stream]
                                       or [Fragment.EMPTY[0]]) for stream in "ab" for what in ("ids", "ends")]
                fragment, closed = Fragment.of(*four)
                yield _record_batch([{"rid": r["rid"], "chunk": r["chunk"], **dict(zip(["closed", *Fragment.FIELDS], fragment.row())),
                                      "parts": [_closed_part(tokens, closed)] if closed else []}], schema)
    return lists.mapInArrow(run, _FRAGMENTS)


def _round(fragments: DataFrame, paths, last: bool) -> DataFrame:
    """Composes runs of FAN neighbours; ``last``: all that a text has, between
    its own two ends."""
    lists = (fragments.select("rid", F.expr(f"chunk div {FAN}").alias("chunk"),
                              F.struct("chunk", "closed", *Fragment.FIELDS).alias("f"))
             .groupBy("rid", "chunk").agg(F.sort_array(F.collect_list("f")).alias("run")))

    schema = _arrow_schema(_FRAGMENTS)

    def run(batches):
        tokens = _tokens(*paths)
        for batch in batches:
            for r in batch.to_pylist():
                # a text begins at a common end, with nothing open
                so_far, parts = Fragment(closed=True) if last else None, []
                for f in r["run"]:
                    right = Fragment.from_row(f)
                    if so_far is None:
                        so_far = right
                        continue
                    so_far, closed = so_far.then(right)
                    if closed:
                        parts.append(_closed_part(tokens, closed))
                yield _record_batch([{"rid": r["rid"], "chunk": r["chunk"], **dict(zip(["closed", *Fragment.FIELDS], so_far.row())),
                                      "parts": parts}], schema)
    return lists.mapInArrow(run, _FRAGMENTS)


def _digests(parts: DataFrame) -> DataFrame:
    """(rid, n_groups, n_links, groups_sha256): the parts of a text in order,
    one at a time through the hash."""
    ddl = "rid long, n_groups long, n_links long, groups_sha256 string"

    schema = _arrow_schema(ddl)

    def run(batches):
        import hashlib
        now, state, groups, links = None, None, 0, 0

        def done():
            return _record_batch([{"rid": now, "n_groups": groups, "n_links": links, "groups_sha256": state.hexdigest()}], schema)
        for batch in batches:
            for r in batch.to_pylist():
                if r["rid"] != now:
                    if now is not None:
                        yield done()
                    now, state, groups, links = r["rid"], hashlib.sha256(), 0, 0
                elif groups:
                    state.update(b";")
                state.update(r["text"][:-1].encode())
                groups, links = groups + r["n_groups"], links + r["n_links"]
        if now is not None:
            yield done()
    return (parts.select("rid", "at", "text", "n_groups", "n_links").repartition("rid").sortWithinPartitions("rid", "at")
            .mapInArrow(run, ddl))


def _long(rows: DataFrame, paths, kind: str, size: int):
    """(statistics, pairs, what was stored) of texts of more than one range."""
    cut = stored(_pieces(rows, kind, size), "alignment-pieces")
    tokens = stored(_range_tokens(cut, paths, size), "alignment-tokens")
    bad = tokens.where("NOT good").select("rid").distinct()
    good = tokens.join(bad, "rid", "left_anti")
    counts = good.groupBy("rid").agg(*[F.sum(F.when(F.col("stream") == s, F.octet_length("ids") / 8)).cast("long").alias(f"n_{s}")
                                       for s in "ab"])
    most = tokens.agg(F.max("chunk")).head()[0]
    rounds = [stored(_fragments(good, paths), "alignment-fragments")]
    while most is not None:
        rounds.append(stored(_round(rounds[-1], paths, most < FAN), "alignment-round"))
        if most < FAN:
            break
        most //= FAN
    parts = rounds[0].select("rid", F.inline("parts"))
    for more in rounds[1:]:
        parts = parts.unionByName(more.select("rid", F.inline("parts")))
    names = cut.where("stream = 'a' AND at = 0").select("rid", "id")
    stats = (names.join(counts, "rid", "left").join(_digests(parts), "rid", "left")
             .select("rid", "id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")],
                     F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")))
    return stats, parts.select("rid", "codes", "times"), [cut, tokens, *rounds]


# ------------------------------------------------------------ corpus counts

def pair_counts(pairs: DataFrame) -> DataFrame:
    """(code, n): links of every id pair over all texts."""
    def run(batches):
        import pyarrow as pa
        none = np.zeros(0, np.int64)

        def summed(held):
            keys, inv = np.unique(np.concatenate([k for k, _ in held] or [none]), return_inverse=True)
            return keys, np.bincount(inv, weights=np.concatenate([n for _, n in held] or [none]), minlength=len(keys)).astype(np.int64)

        def out(keys, sums):
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["code", "n"])
        held, size = [], 0
        for batch in batches:
            held.append(tuple(np.asarray(batch.column(i).flatten()) for i in (0, 1)))
            size += len(held[-1][0])
            if size > 2 * FLUSH_PAIRS:
                keys, sums = summed(held)
                held, size = [(keys, sums)], len(keys)
                if size > FLUSH_PAIRS:
                    yield out(keys, sums)
                    held, size = [], 0
        yield out(*summed(held))
    return pairs.select("codes", "times").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _rated(counts: DataFrame, size_b: int) -> DataFrame:
    """(code, n, best): whether the pair is the commonest of its second id."""
    best = counts.groupBy((F.col("code") % size_b).alias("b")).agg(F.max("n").alias("most"))
    # one row per id of the second vocabulary
    return counts.withColumn("b", F.col("code") % size_b).join(F.broadcast(best), "b").select(
        "code", "n", (F.col("n") == F.col("most")).alias("best"))


def _scores(pairs: DataFrame, counts: DataFrame, size_b: int, hot_pairs: int):
    """(rid, n_best, count_sum) of every text that has links."""
    rated = _rated(counts, size_b)
    total = counts.agg(F.sum("n")).head()[0] or 0
    is_hot = F.col("n") * hot_pairs >= total
    hot = rated.where(is_hot).toPandas().sort_values("code")  # at most hot_pairs rows
    shared = pairs.sparkSession.sparkContext.broadcast(
        tuple(hot[c].to_numpy(np.int64) for c in ("code", "n", "best")))

    def run(batches):
        import pyarrow as pa
        hot_codes, hot_n, hot_best = shared.value
        for batch in batches:
            rows = batch.num_rows
            codes, times = (np.asarray(batch.column(i).flatten()) for i in (1, 2))
            cuts = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))])
            at = np.minimum(np.searchsorted(hot_codes, codes), max(len(hot_codes) - 1, 0))
            known = hot_codes[at] == codes if len(hot_codes) else np.zeros(len(codes), bool)

            def sums(values):
                total = np.concatenate([[0], np.cumsum(np.where(known, values, 0) if len(hot_codes) else np.zeros(len(codes), np.int64))])
                return pa.array(total[cuts[1:]] - total[cuts[:-1]])
            n, best = (hot_n[at], hot_best[at]) if len(hot_codes) else (times, times)
            rest = np.flatnonzero(~known)
            lists = pa.array(np.searchsorted(rest, cuts).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sums(times * best), sums(times * n), pa.ListArray.from_arrays(lists, pa.array(codes[rest])),
                 pa.ListArray.from_arrays(lists, pa.array(times[rest]))],
                names=["rid", "n_best", "count_sum", "codes", "times"])
            assert rows == len(cuts) - 1
    scored = stored(pairs.select("rid", "codes", "times").mapInArrow(
        run, "rid long, n_best long, count_sum long, codes array<long>, times array<long>"), "alignment-scores")
    cold = (scored.select("rid", F.inline(F.arrays_zip("codes", "times"))).toDF("rid", "code", "t")
            .join(rated.where(~is_hot), "code")
            .select("rid", F.when(F.col("best"), F.col("t")).otherwise(0).alias("n_best"), (F.col("t") * F.col("n")).alias("count_sum")))
    return (scored.select("rid", "n_best", "count_sum").unionByName(cold)
            .groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))


def tokenizer_alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None,
                        path_b: str | None = None, pattern: str | None = None, range_bytes: int = RANGE,
                        hot_pairs: int = HOT_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(texts, pairs): per text (id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256); per id pair (a, b, n, best), the lexicon of the
    alignment."""
    import public_tokenizers
    import sentencepiece
    paths = (path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model"),
             pattern or public_tokenizers.PATTERN)
    size_b = sentencepiece.SentencePieceProcessor(model_file=paths[1]).get_piece_size()
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    short = stored(_short(rows.where(F.octet_length("text") < range_bytes), paths, kind), "alignment-short")
    stats, pairs, used = _long(rows.where(F.octet_length("text") >= range_bytes), paths, kind, range_bytes)
    stats = short.select(stats.columns).unionByName(stats)
    pairs = short.select("rid", "codes", "times").unionByName(pairs)
    counts = stored(pair_counts(pairs), "alignment-counts")
    texts = (stats.join(_scores(pairs, counts, size_b, hot_pairs), "rid", "left")
             .select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links",
                     F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"),
                     "groups_sha256"))
    lexicon = _rated(counts, size_b).select(F.expr(f"code div {size_b}").alias("a"), (F.col("code") % size_b).alias("b"), "n", "best")
    return texts, lexicon
