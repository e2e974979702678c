"""Shared helpers of the corpus operators: table access, salted joins for hot
keys, process-wide caches of the Python workers, and numpy kernels that find
and hash the words of a batch of texts without a Python loop per word.

Conventions that hold for every operator of this subpackage:

* only the id and text columns named by the caller are read, and they are
  renamed at once, so extra columns cannot clash with result columns;
* a null text counts as the empty text, a null id is carried as null;
* rows that repeat an id are separate rows: each one is judged by its own text
  and rows that also repeat the text share the decision; rows with a null id
  are different documents.
"""
from __future__ import annotations

import sys
import types
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from convgraph.session import checkpoint_dir

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
WHITESPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Texts are handled in slices of about this many bytes, one text at least.
SLICE_BYTES = 2_000_000
#: Words longer than this are hashed one by one.
LONG_WORD = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str):
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with null texts as empty texts."""
    return docs.select(F.col(id_col).alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def whole_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, _row): as ``id_text``, and the row itself as a struct."""
    return docs.select(F.col(id_col).alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.struct(*[named(c) for c in docs.columns]).alias("_row"))


def one_null_row(rows: DataFrame, *by) -> DataFrame:
    """Of the rows (id, text, _row) with a null id one per group of ``by``:
    the one whose columns have the smallest hash, whatever the layout."""
    by = [c.alias(f"_by{i}") for i, c in enumerate(by)]
    best = F.min_by(F.struct("id", "text", "_row"), F.md5(F.to_json("_row"))).alias("_best")
    return rows.where("id IS NULL").groupBy(*by).agg(best).select("_best.*")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to the cluster's shared folder and read them back: one
    evaluation for several readers, and a cut of the lineage that survives
    lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_stored_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: A class of equal rows is spread over up to this many tasks when something
#: about the class is joined back to its rows.
SALTS = 256


def with_salt(rows: DataFrame, id_col: str = "id") -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))


def salt_bits() -> list:
    """Aggregates that note which salts occur in a class: four longs, combined
    before the shuffle, whatever the size of the class."""
    return [F.expr(f"bit_or(if(salt div 64 = {j}, shiftleft(1L, salt % 64), 0L))").alias(f"_bits{j}")
            for j in range(SALTS // 64)]


def per_salt(classes: DataFrame) -> DataFrame:
    """One row per class and salt that occurs in it, as column ``salt``."""
    has = ", ".join(f"_bits{j}" for j in range(SALTS // 64))
    present = F.expr(f"filter(sequence(0, {SALTS - 1}), s -> "
                     f"(get(array({has}), int(s div 64)) & shiftleft(1L, s % 64)) != 0)")
    return classes.withColumn("salt", F.explode(present)).drop(*[f"_bits{j}" for j in range(SALTS // 64)])


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker process."""
    holder = sys.modules.get("_convgraph_llm_worker")
    if holder is None:
        holder = sys.modules["_convgraph_llm_worker"] = types.ModuleType("_convgraph_llm_worker")
    return holder.__dict__.setdefault(name, {})


# ------------------------------------------------------------ word kernels

def _u64(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def splitmix(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit constants."""
    with np.errstate(over="ignore"):
        x = np.arange(1, n + 1, dtype=np.uint64) * _u64(0x9E3779B97F4A7C15) + _u64(seed * 0xD1342543DE82EF95)
        return mix(x) | _u64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _u64(30))) * _u64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _u64(27))) * _u64(0x94D049BB133111EB)
        return h ^ (h >> _u64(31))


def text_slices(batch, column: str = "text", slice_bytes: int = SLICE_BYTES):
    """Cut one Arrow batch into row ranges of bounded bytes: yields (first row,
    last row + 1, bytes of the rows as one array, offset of each row in it)."""
    import pyarrow as pa
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_string(col.type):
        kind = np.int32
    else:
        col, kind = col.cast(pa.large_string()), np.int64
    n = len(col)
    if not n:
        return
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], dtype=kind, count=n + 1 + col.offset)[col.offset:].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + slice_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


SPACE = np.zeros(256, dtype=bool)
SPACE[list(WHITESPACE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offs: np.ndarray):
    """Start and end of every word, and the number of words before each row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offs] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | cut[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | cut[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs, side="left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, eight bytes at a time over all words."""
    n = len(starts)
    length = ends - starts
    h = mix(length.astype(np.uint64) + _u64(0x51ED270B))
    if not n:
        return h
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[:len(data)] = data
    view = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    alive = np.flatnonzero(length <= LONG_WORD)
    at = starts[alive]
    left = length[alive]
    while len(alive):
        piece = view[at]
        short = left < 8
        if short.any():
            keep = (_u64(1) << (np.minimum(left, 7).astype(np.uint64) * _u64(8))) - _u64(1)
            piece = np.where(short, piece & keep, piece)
        h[alive] = mix(h[alive] ^ piece)
        more = left > 8
        alive, at, left = alive[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(length > LONG_WORD):
        import hashlib
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        h[i] = np.uint64(int.from_bytes(digest, "little"))
    return h


#: Ranges longer than this are compared one by one.
LONG_RANGE = 4096


def equal_ranges(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes from a equal the n bytes from b, eight at a time over
    all ranges."""
    same = np.ones(len(a), dtype=bool)
    alive = np.flatnonzero((a != b) & (n > 0))
    for i in alive[n[alive] > LONG_RANGE]:
        same[i] = np.array_equal(data[a[i]:a[i] + n[i]], data[b[i]:b[i] + n[i]])
    alive = alive[n[alive] <= LONG_RANGE]
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[:len(data)] = data
    view = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    x, y, left = a[alive], b[alive], n[alive]
    while len(alive):
        differ = view[x] ^ view[y]
        short = left < 8
        if short.any():
            keep = (_u64(1) << (np.minimum(left, 7).astype(np.uint64) * _u64(8))) - _u64(1)
            differ = np.where(short, differ & keep, differ)
        same[alive[differ != 0]] = False
        more = (differ == 0) & (left > 8)
        alive, x, y, left = alive[more], x[more] + 8, y[more] + 8, left[more] - 8
    return same


def exact_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, owner: np.ndarray):
    """(number of every range, bound of the numbers): equal numbers for equal
    bytes of one owner and for nothing else.  ``keys`` are hashes that equal
    ranges of an owner share; ranges that share one by chance are told apart by
    their bytes."""
    _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    lead, n = first[number], ends - starts
    same = (n == n[lead]) & (owner == owner[lead])
    at = np.flatnonzero(same)
    same[at] = equal_ranges(data, starts[at], starts[lead[at]], n[at])
    bound = len(first)
    if not same.all():
        seen: dict = {}
        for i in np.flatnonzero(np.isin(number, number[~same])).tolist():
            key = (int(owner[i]), data[starts[i]:ends[i]].tobytes())
            number[i] = seen.setdefault(key, bound + len(seen))
        bound += len(seen)
    return number, bound


def word_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Eight bytes of the BLAKE2b digest of every word.  Distinct words of the
    slice are told apart by their bytes and hashed once each, so words made to
    share a value of :func:`word_hashes` differ here."""
    import hashlib
    if not len(starts):
        return np.zeros(0, np.uint64)
    number, _ = exact_ids(data, starts, ends, word_hashes(data, starts, ends), np.zeros(len(starts), np.int64))
    _, first, number = np.unique(number, return_index=True, return_inverse=True)
    raw = data.tobytes()
    digests = b"".join(hashlib.blake2b(raw[a:z], digest_size=8).digest()
                       for a, z in zip(starts[first].tolist(), ends[first].tolist()))
    return np.frombuffer(digests, dtype="<u8")[number]


def window_hashes(words: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Hash of the k words from each position on; len(words) - k + 1 of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = splitmix(seed, k)
    with np.errstate(over="ignore"):
        h = words[:n] * c[0]
        for j in range(1, k):
            h = h + (words[j:n + j] ^ (words[j:n + j] >> _u64(29))) * c[j]
    return mix(h)
