"""Substring dedup: super-k-mer partitioning.

A window is 13 consecutive words.  The minimiser of a window is the 3-word
gram with the smallest hash in it; consecutive windows with the same minimiser
form a super-k-mer, which travels once, as one packed string of its words, to
the bucket of the minimiser.  All windows with the same words have the same
minimiser and so meet in one bucket.  There the strings are unpacked, their
windows are sorted by a 128-bit hash of their words, the windows of a run are
compared by their bytes, and runs of equal windows give the smallest document of
each window exactly.  Windows that also start in a smaller document go back to
their documents as spans.

Inside a task equal super-k-mers are combined first: only the smallest
document of a string is sent, the others are decided on the spot, so a passage
that a third of all documents share reaches its bucket at most once per task.
Grams that are found to be a minimiser of more than one window in ``HOT_SHARE``
in a pass before lose every comparison with other grams.  The pass is
approximate (see ``hot_minimisers``), which affects only the balance of the
buckets: every window is compared whatever the list holds.  Windows
around a hot gram then spread over the minimisers of their other words.  The
pass is made once, on the plain order: where all grams of a passage that very
many documents share are common, the next one of them becomes the minimiser of
its windows, and strings that differ around the passage meet in its bucket.  The
hot list has at most ``HOT_SHARE`` entries.

Defined results: null texts have no words; windows that repeat only inside
their own document stay; of rows that repeat an id none is smaller, so they do
not remove each other's words; rows with a null id come after all others; an
empty table gives an empty one.  Spans go back by id and text hash, so rows
that share an id keep their own spans.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from convgraph.llm.common import (equal_ranges, mix, named, splitmix, text_slices, window_hashes, word_hashes,
                                  word_spans)

WINDOW = 13
GRAM = 3
#: A gram is hot if it is the minimiser of more than one window in this many.
HOT_SHARE = 2000
#: Windows a bucket holds on average at most.
BUCKET_WINDOWS = 2_000_000
#: Packed words a task collects before it sends them to their buckets.
FLUSH_BYTES = 48_000_000
NO_ID = np.iinfo(np.int64).max


def _minimum_over(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of k consecutive values from each position on."""
    out, width = x, 1
    while width * 2 <= k:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[:len(x) - k + 1], out[k - width:]) if width < k else out


def gram_order(words: np.ndarray, hot: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Order value of the gram from each word on: its hash, hot ones last."""
    h = window_hashes(words, gram, seed=5)
    low = h >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, low), len(hot) - 1)
        low = np.where(hot[at] == low, low | np.uint64(1 << 63), low)
    return low


def super_kmers(words: np.ndarray, first: np.ndarray, hot: np.ndarray, window: int = WINDOW):
    """(first word, number of windows, minimiser) of every super-k-mer of a
    slice; ``first``: number of words before each row."""
    n = len(words) - window + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    low = _minimum_over(gram_order(words, hot), window - GRAM + 1)
    row = np.searchsorted(first, np.arange(n), side="right")
    last = np.searchsorted(first, np.arange(window - 1, len(words)), side="right")
    valid = row == last
    new = np.empty(n, dtype=bool)
    new[0] = True
    new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    at = np.flatnonzero(new & valid)
    nxt = np.flatnonzero(new | ~valid)
    ends = np.append(nxt, n)[np.searchsorted(nxt, at, side="right")]
    return at, ends - at, low[at]


def hot_minimisers(rows: DataFrame, window: int = WINDOW, share: int = HOT_SHARE) -> tuple[np.ndarray, int]:
    """Order values of grams that are the minimiser of more than 1 / share of
    all windows, and the number of windows.  The list is approximate: a task
    reports only the grams above the share among its own windows (at most
    ``share`` of them) and its total, and drops rare ones on the way, so a gram
    that is hot over all but rare in many tasks is undercounted and may be
    missing.  A gram in the list is hot indeed.  Only the balance of the
    buckets depends on it."""
    def run(batches):
        import pyarrow as pa
        none = np.zeros(0, np.uint64)
        keys, counts, total = none, np.zeros(0, np.int64), 0
        for batch in batches:
            for _lo, _hi, data, offs in text_slices(batch):
                s, e, first = word_spans(data, offs)
                _at, n, low = super_kmers(word_hashes(data, s, e), first, none, window)
                total += int(n.sum())
                keys, inv = np.unique(np.concatenate([keys, low]), return_inverse=True)
                counts = np.bincount(inv, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
                if len(keys) > 4_000_000:  # rare grams cannot become hot any more unless they come again
                    keep = counts * share * 4 > total
                    keys, counts = keys[keep], counts[keep]
        keep = counts * share > total
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(keys[keep].view(np.int64), -1)), pa.array(np.append(counts[keep], total))],
            names=["gram", "n"])
    per_task = rows.select("text").mapInArrow(run, "gram long, n long")
    sums = per_task.groupBy("gram").agg(F.sum("n").alias("n"))
    total = F.max(F.when(F.col("gram") == -1, F.col("n")))
    top = sums.crossJoin(F.broadcast(sums.agg(total.alias("total")))) \
        .where((F.col("gram") == -1) | (F.col("n") * share > F.col("total"))).collect()
    grams = np.sort(np.array([r.gram for r in top if r.gram >= 0], dtype=np.int64)).view(np.uint64)
    return grams, max((r.n for r in top if r.gram < 0), default=0)


class _Sender:
    """Combines the super-k-mers of a task and packs them per bucket."""

    def __init__(self, buckets: int, window: int):
        self.buckets, self.window = buckets, window
        self.clear()

    def clear(self):
        self.strings: list[bytes] = []
        self.doc, self.tag, self.start, self.count, self.bucket, self.hash = [], [], [], [], [], []
        self.size = 0

    def add(self, data, starts, ends, words, first, ids, tags, at, n, low):
        """``ids``, ``tags``: id and text hash of each row of the slice."""
        row = np.searchsorted(first, at, side="right") - 1
        raw = data.tobytes()
        for a, z in zip(starts[at].tolist(), ends[at + n + self.window - 2].tolist()):
            self.strings.append(raw[a:z])
            self.size += z - a
        self.doc.append(ids[row])
        self.tag.append(tags[row])
        self.start.append(at - first[row])
        self.count.append(n)
        self.bucket.append((mix(low) % np.uint64(self.buckets)).astype(np.int64))
        # 64-bit hash of the whole run of words, to find equal ones
        c = splitmix(3, 1)[0]
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(len(words), c, dtype=np.uint64))
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words) * power)])
            span = prefix[at + n + self.window - 1] - prefix[at]
            inverse = np.uint64(pow(int(c), -1, 1 << 64))
            back = np.cumprod(np.full(len(words) + 1, inverse, dtype=np.uint64))
            self.hash.append(mix(span * back[at]) ^ mix(n.astype(np.uint64)))

    def flush(self):
        """(bucket, payload) rows and spans that are decided already."""
        if not self.strings:
            return [], None
        import pickle
        import zstandard
        doc, tag, start, count = (np.concatenate(x) for x in (self.doc, self.tag, self.start, self.count))
        bucket, h = np.concatenate(self.bucket), np.concatenate(self.hash)
        order = np.lexsort((start, doc, h))
        head = np.empty(len(order), dtype=bool)
        head[0] = True
        head[1:] = h[order][1:] != h[order][:-1]
        lead = order[np.flatnonzero(head)][np.cumsum(head) - 1]
        text = self.strings
        same = np.array([a == b or text[a].split() == text[b].split()
                         for a, b in zip(order.tolist(), lead.tolist())], dtype=bool)
        gone = order[same & (doc[order] > doc[lead])]  # the smaller document is in this task
        stay = np.ones(len(order), dtype=bool)
        stay[gone] = False
        packets = []
        keep = np.flatnonzero(stay)
        keep = keep[np.argsort(bucket[keep], kind="stable")]
        cut = np.flatnonzero(np.diff(bucket[keep])) + 1
        squeeze = zstandard.ZstdCompressor(level=3)
        for part in np.split(keep, cut):
            body = pickle.dumps((doc[part], tag[part], start[part].astype(np.int32), count[part].astype(np.int32),
                                 b"\n".join(b" ".join(text[i].split()) for i in part.tolist())), protocol=5)
            packets.append((int(bucket[part[0]]), squeeze.compress(body)))
        decided = (doc[gone], tag[gone], start[gone], count[gone])
        self.clear()
        return packets, decided


def _first_documents(payloads, window: int):
    """(document, tag, first window, number of windows) of all windows of a bucket
    that also start in a smaller document, sorted."""
    import pickle
    import zstandard
    open_ = zstandard.ZstdDecompressor()
    docs, tags, pos, one, two, begin, end, texts, size = [], [], [], [], [], [], [], [], 0
    for p in payloads:
        doc, tag, start, count, lines = pickle.loads(open_.decompress(p))
        data = np.frombuffer(lines, dtype=np.uint8)
        s, e, _ = word_spans(data, np.array([0, len(data)]))
        words = word_hashes(data, s, e)
        before = np.cumsum(np.concatenate([[0], count + window - 1]))[:-1]
        at = np.repeat(before - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        one.append(window_hashes(words, window, seed=21)[at])
        two.append(window_hashes(words, window, seed=22)[at])
        begin.append(s[at] + size)
        end.append(e[at + window - 1] + size)
        texts.append(data)
        size += len(data)
        docs.append(np.repeat(doc, count))
        tags.append(np.repeat(tag, count))
        pos.append(np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum())))
    doc, tag, at, one, two, begin, end, data = (np.concatenate(x) for x in (docs, tags, pos, one, two, begin, end, texts))
    order = np.lexsort((doc, two, one))
    new = np.empty(len(order), dtype=bool)
    new[0] = True
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    run = np.cumsum(new) - 1
    lead = order[np.flatnonzero(new)][run]
    smallest = doc[lead]
    # a packed window is its words joined by one space, so equal windows are equal bytes
    length = end - begin
    later = np.flatnonzero(~new)
    mine, first = order[later], lead[later]
    same = length[mine] == length[first]
    same[same] = equal_ranges(data, begin[mine[same]], begin[first[same]], length[mine[same]])
    if not same.all():  # other words with the same hashes: told apart by their bytes
        smallest = smallest.copy()
        seen: dict = {}
        for i in np.flatnonzero(np.isin(run, run[later[~same]])).tolist():  # by document within a run
            w = order[i]
            smallest[i] = seen.setdefault(data[begin[w]:end[w]].tobytes(), doc[w])
    found = order[doc[order] > smallest]
    return runs(doc[found], tag[found], at[found])


def runs(doc: np.ndarray, tag: np.ndarray, at: np.ndarray):
    """Join consecutive windows of a document: (document, tag, first, number)."""
    if not len(doc):
        return doc, tag, at, at
    order = np.lexsort((at, tag, doc))
    doc, tag, at = doc[order], tag[order], at[order]
    new = np.empty(len(doc), dtype=bool)
    new[0] = True
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (at[1:] - at[:-1] > 1)
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(doc)) - 1
    return doc[start], tag[start], at[start], at[last] - at[start] + 1


def duplicate_spans(rows: DataFrame, window: int = WINDOW, buckets: int | None = None,
                    share: int = HOT_SHARE) -> DataFrame:
    """(id long, tag, first, windows): spans of windows that also start in a
    document with a smaller id.  ``rows``: (id long, tag long, text)."""
    spark = rows.sparkSession
    hot, total = hot_minimisers(rows, window, share)
    n_buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_WINDOWS))

    def send(batches):
        import pyarrow as pa
        sender = _Sender(n_buckets, window)

        def out(flushed):
            packets, decided = flushed
            keys, bodies = [k for k, _ in packets], [b for _, b in packets]
            if decided is not None and len(decided[0]):
                import pickle
                keys.append(-1 - int(decided[0][0] % n_buckets))
                bodies.append(pickle.dumps(decided, protocol=5))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bodies, pa.binary())],
                                              names=["bucket", "body"])
        for batch in batches:
            ids = batch.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            tags = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in text_slices(batch):
                s, e, first = word_spans(data, offs)
                words = word_hashes(data, s, e)
                at, n, low = super_kmers(words, first[:-1], hot, window)
                if len(at):
                    sender.add(data, s, e, words, first[:-1], ids[lo:hi], tags[lo:hi], at, n, low)
                if sender.size > FLUSH_BYTES:
                    yield out(sender.flush())
        yield out(sender.flush())

    def receive(key, group):
        import pickle
        import pyarrow as pa
        if key[0].as_py() < 0:  # decided by the task that read the documents
            parts = [pickle.loads(b.as_py()) for b in group.column("body")]
            doc, tag, at, n = (np.concatenate(x) for x in zip(*parts))
        else:
            doc, tag, at, n = _first_documents((b.as_py() for b in group.column("body")), window)
        return pa.table({"id": pa.array(doc.astype(np.int64)), "tag": pa.array(tag.astype(np.int64)),
                         "first": pa.array(at.astype(np.int32)),
                         "windows": pa.array(n.astype(np.int32))})

    packed = rows.mapInArrow(send, "bucket long, body binary")
    return packed.groupBy("bucket").applyInArrow(receive, "id long, tag long, first int, windows int")


def remove_spans(rows: DataFrame, spans: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows with n_words, n_removed and kept: the words of the text that
    no span covers, joined by one space.  ``rows``: id, tag, text and any
    other columns, which come back unchanged (without tag and text, the words
    are enough).  A document's spans are bounded by its own words."""
    other = [f for f in rows.schema.fields if f.name not in ("id", "tag", "text")]
    per_doc = spans.groupBy("id", "tag") \
        .agg(F.collect_list("first").alias("_first"), F.collect_list("windows").alias("_windows")).withColumnRenamed("id", "_key")
    held = rows.withColumn("_key", F.coalesce("id", F.lit(int(NO_ID)))).join(per_doc, ["_key", "tag"], "left") \
        .select("text", "_first", "_windows", "id", *[f.name for f in other])

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            at_col, n_col = batch.column(1), batch.column(2)
            for lo, hi, data, offs in text_slices(batch):
                s, e, first = word_spans(data, offs)
                kept, words, removed = [], [], []
                for r in range(lo, hi):
                    a, z = int(first[r - lo]), int(first[r - lo + 1])
                    words.append(z - a)
                    base = int(offs[r - lo])
                    raw = data[base:offs[r - lo + 1]].tobytes()
                    if not at_col[r].is_valid:
                        kept.append(b" ".join(raw.split()))
                        removed.append(0)
                        continue
                    cover = np.zeros(z - a + 1, dtype=np.int32)
                    begin = at_col[r].values.to_numpy()
                    np.add.at(cover, begin, 1)
                    np.add.at(cover, begin + n_col[r].values.to_numpy() + window - 1, -1)
                    stay = np.flatnonzero(np.cumsum(cover[:-1]) == 0) + a
                    removed.append(z - a - len(stay))
                    kept.append(b" ".join([raw[i - base:j - base] for i, j in zip(s[stay].tolist(), e[stay].tolist())]))
                carried = [batch.column(i)[lo:hi] for i in range(3, batch.num_columns)]
                text = batch.column(0)[lo:hi]
                yield pa.RecordBatch.from_arrays(
                    [*carried, text, pa.array(words, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string())],
                    names=[*batch.schema.names[3:], "text", "n_words", "n_removed", "kept"])
    added = [StructField("text", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType()),
             StructField("kept", StringType())]
    return held.mapInArrow(run, StructType([StructField("id", LongType()), *other, *added]))


def _rows(docs: DataFrame, id_col: str, text_col: str, other: tuple = ()) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"), *other)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept): the text without words that are covered
    by a window whose words also start in a document with a smaller id."""
    rows = _rows(docs, id_col, text_col)
    return remove_spans(rows, duplicate_spans(rows, window), window).drop("text").withColumnRenamed("id", id_col)


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with all their columns, repeated words cut out of
    the text.  Texts that lose nothing stay as they are (null ones become
    empty); documents of which nothing is left go."""
    plain = _rows(docs, id_col, text_col)
    kept = F.struct(*[named(c) for c in docs.columns if c != text_col]).alias("_row")
    out = remove_spans(_rows(docs, id_col, text_col, (kept,)), duplicate_spans(plain, window), window)
    lost = F.col("n_removed") > 0
    return out.where(~lost | (F.col("kept") != "")).select(
        *[F.when(lost, F.col("kept")).otherwise(F.col("text")).alias(c) if c == text_col else F.col("_row")[c].alias(c)
          for c in docs.columns])
