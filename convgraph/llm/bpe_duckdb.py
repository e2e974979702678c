"""Byte-level BPE encoding and decoding: DuckDB recursive queries per partition.

Each worker keeps an in-process DuckDB (one thread, bounded memory) with two
tables: ``merges`` (pair of token ids -> id of the joined token, which is its
rank) and ``vocab`` (id -> bytes).  The distinct words of a batch that are not
known yet become token-position rows, one per byte; a recursive query joins
adjacent rows with the merge table and contracts in every word the leftmost
pair of minimum rank until no word has a pair left.

Long words (over ``LONG`` bytes) run in rounds of bounded depth, so that the
recursion never holds more than ``DEPTH`` generations of a word; there an
iteration contracts all pairs of the minimum rank at once where that gives the
same result as one after the other (no pair formed on the way has a lower
rank), else the leftmost one.

Decoding joins the ids of whole texts with the vocabulary and concatenates the
pieces by an ordered aggregation.

Defined results: null and empty texts have no tokens and decode to no bytes;
special strings are ordinary text; an unknown id cannot be decoded and raises;
a null id column is carried; an empty table gives an empty one.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from convgraph.llm.common import id_text, worker_cache
from convgraph.llm.pretokens import Memo, memo, spaced_chunks

#: Words of one recursive query, and bytes above which a word is a long one.
WORDS, LONG, DEPTH = 16_000, 96, 64
#: Ids of one decoding query; a longer text is a query of its own.
DECODE_IDS = 200_000

# A row is a token with its right neighbour (nxt, at npos) and the rank m of the
# pair.  best: per word the leftmost pair of minimum rank; its right token goes.
ENCODE = """
WITH RECURSIVE step AS (
  SELECT 0 AS it, s.w, s.pos, s.tok, s.nxt, s.npos, m.m
  FROM start s LEFT JOIN merges m ON m.pair = s.tok::BIGINT * 4194304 + s.nxt
  UNION ALL
  SELECT it, w, pos, t.tok, t.nxt, npos, m.m FROM (
    SELECT s.it + 1 AS it, s.w, s.pos, CASE WHEN s.pos = b.pos THEN b.m ELSE s.tok END AS tok,
           CASE WHEN s.pos = b.pos THEN b.nxt2 WHEN s.npos = b.pos THEN b.m ELSE s.nxt END AS nxt,
           CASE WHEN s.pos = b.pos THEN b.npos2 ELSE s.npos END AS npos
    FROM step s JOIN (
      SELECT a.w, a.pos, a.m, a.gone, q.nxt AS nxt2, q.npos AS npos2
      FROM (SELECT w, best & 4294967295 AS pos, (best >> 32)::INTEGER AS m, gone
            FROM (SELECT w, min(m::BIGINT << 32 | pos) AS best, arg_min(npos, m::BIGINT << 32 | pos) AS gone
                  FROM step WHERE m IS NOT NULL GROUP BY w)) a
      JOIN step q ON q.w = a.w AND q.pos = a.gone) b ON b.w = s.w
    WHERE s.pos <> b.gone) t
  LEFT JOIN merges m ON m.pair = t.tok::BIGINT * 4194304 + t.nxt
)
SELECT s.w, s.pos, s.tok FROM step s JOIN (SELECT w, max(it) AS it FROM step GROUP BY w) l USING (w, it)
ORDER BY s.w, s.pos
"""

# One generation of the long-word query.  hit: pairs of minimum rank r, every
# other one in a run of overlapping pairs.  low: contracting it would form a
# pair of lower rank with a neighbour, joined already or not.
ENCODE_LONG = """
WITH RECURSIVE step AS (
  SELECT 0 AS it, w, pos, tok FROM start
  UNION ALL
  SELECT it + 1, w, pos, CASE WHEN hit THEN r ELSE tok END
  FROM (
    SELECT *, coalesce(lag(hit) OVER (PARTITION BY w ORDER BY pos), false) AS eaten
    FROM (
      SELECT it, w, pos, tok, r, kept AND (safe OR pos = leftmost) AS hit
      FROM (
        SELECT s.*, bool_and(NOT kept OR (coalesce(a.m, r) >= r AND coalesce(b.m, r) >= r AND coalesce(c.m, r) >= r
                                          AND coalesce(d.m, r) >= r)) OVER (PARTITION BY w) AS safe,
               min(CASE WHEN kept THEN pos END) OVER (PARTITION BY w) AS leftmost
        FROM (
          SELECT *, lag(tok) OVER o AS back, lead(tok, 2) OVER o AS ahead,
                 coalesce(lag(kept, 2) OVER o, false) AS back_hit, coalesce(lead(kept, 2) OVER o, false) AS ahead_hit
          FROM (
            SELECT *, is_min AND (idx - min(idx) OVER (PARTITION BY w, is_min, run)) % 2 = 0 AS kept
            FROM (
              SELECT *, idx - row_number() OVER (PARTITION BY w, is_min ORDER BY pos) AS run
              FROM (
                SELECT *, coalesce(m = r, false) AS is_min
                FROM (
                  SELECT it, w, pos, tok, m, row_number() OVER (PARTITION BY w ORDER BY pos) AS idx,
                         min(m) OVER (PARTITION BY w) AS r
                  FROM (SELECT it, w, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt
                        FROM step WHERE it < {depth})
                  LEFT JOIN merges ON pair = tok::BIGINT * 4194304 + nxt)
                WHERE r IS NOT NULL)))
          WINDOW o AS (PARTITION BY w ORDER BY pos)) s
        LEFT JOIN merges a ON kept AND a.pair = back::BIGINT * 4194304 + r
        LEFT JOIN merges b ON kept AND b.pair = r::BIGINT * 4194304 + ahead
        LEFT JOIN merges c ON kept AND back_hit AND c.pair = r::BIGINT * 4194304 + r
        LEFT JOIN merges d ON kept AND ahead_hit AND d.pair = r::BIGINT * 4194304 + r)))
  WHERE NOT eaten
)
SELECT w, pos, tok, last FROM (SELECT *, max(it) OVER (PARTITION BY w) AS last FROM step)
WHERE it = last ORDER BY w, pos
"""

DECODE = """
SELECT d, string_agg(piece, '' ORDER BY p) AS text, count(piece) = count(*) AS known
FROM ids LEFT JOIN vocab USING (id) GROUP BY d
"""


class Codec:
    """Encodes and decodes; one per worker process and rank file."""

    def __init__(self, path: str, pattern: str):
        import base64
        import duckdb
        import numpy as np
        import pyarrow as pa
        import regex
        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        left, right, joined = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    joined.append(rank)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        pairs = np.array(left, dtype=np.int64) * 4194304 + np.array(right, dtype=np.int64)
        self._give("m", pa.table({"pair": pairs, "m": np.array(joined, dtype=np.int32)}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM m")
        # bytes as Latin-1 text: one character a byte, whatever the bytes are
        self._give("v", pa.table({"id": np.array(list(ranks.values()), dtype=np.int32),
                                  "piece": [t.decode("latin-1") for t in ranks]}))
        self.con.execute("CREATE TABLE vocab AS SELECT * FROM v")
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.match = regex.compile(pattern).findall
        # ids of words and of chunks, most of which are one word
        self.known: Memo = memo(f"duck-{path}", self._missing)

    def _give(self, name, table):
        self.con.register(name, table)

    def _rows(self, words: list[bytes]):
        import numpy as np
        size = np.array([len(w) for w in words])
        tok = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        w = np.repeat(np.arange(len(words), dtype=np.int32), size)
        pos = (np.arange(len(tok)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        return w, pos, tok

    def _start(self, w, pos, tok):
        import numpy as np
        import pyarrow as pa
        last = np.append(w[1:] != w[:-1], True)
        nxt = np.where(last, -1, np.append(tok[1:], -1)).astype(np.int32)
        npos = np.where(last, -1, np.append(pos[1:], -1)).astype(np.int32)
        self._give("start", pa.table({"w": w, "pos": pos, "tok": tok, "nxt": nxt, "npos": npos}))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word (none of them empty)."""
        import numpy as np
        raw = [w.encode("utf-8") for w in words]
        out: list[bytes] = [b""] * len(raw)
        short = [i for i, b in enumerate(raw) if len(b) <= LONG]
        for lo in range(0, len(short), WORDS):
            part = short[lo:lo + WORDS]
            self._start(*self._rows([raw[i] for i in part]))
            got = self.con.execute(ENCODE).fetchnumpy()
            cut = np.flatnonzero(np.diff(got["w"])) + 1
            for i, ids in zip(part, np.split(np.asarray(got["tok"]).astype("<u4"), cut)):
                out[i] = ids.tobytes()
        for i in (i for i, b in enumerate(raw) if len(b) > LONG):
            w, pos, tok = self._rows([raw[i]])
            while True:
                self._start(w, pos, tok)
                got = self.con.execute(ENCODE_LONG.format(depth=DEPTH)).fetchnumpy()
                w, pos, tok = (np.asarray(got[c]).astype(np.int32) for c in ("w", "pos", "tok"))
                if got["last"][0] < DEPTH:
                    break
            out[i] = tok.astype("<u4").tobytes()
        return out

    def _missing(self, word: str) -> bytes:
        return self.encode_words([word])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [spaced_chunks(t) if t else [] for t in texts]
        found = [list(map(self.known.get, parts)) for parts in cut]
        fresh = {c for parts, ids in zip(cut, found) if None in ids for c, i in zip(parts, ids) if i is None}
        words = {c: self.match(c) for c in fresh}
        unknown = list({w for m in words.values() for w in m if w not in self.known})
        new = dict(zip(unknown, self.encode_words(unknown)))
        for c, m in words.items():
            if c not in new:
                new[c] = b"".join([new[w] if w in new else self.known[w] for w in m])
        out = [b"".join([new[c] if i is None else i for c, i in zip(parts, ids)] if None in ids else ids)
               for parts, ids in zip(cut, found)]
        self.known.update((k, v) for k, v in new.items() if len(k) <= self.known.longest)
        self.known.trim(MEMO)
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        import numpy as np
        import pyarrow as pa
        out: list[bytes] = [b""] * len(ids)
        lo = 0
        while lo < len(ids):
            hi, total = lo, 0
            while hi < len(ids) and (hi == lo or total + len(ids[hi]) // 4 <= DECODE_IDS):
                total += len(ids[hi]) // 4
                hi += 1
            flat = np.frombuffer(b"".join(ids[lo:hi]), dtype="<u4").astype(np.int32)
            d = np.repeat(np.arange(lo, hi, dtype=np.int32), [len(x) // 4 for x in ids[lo:hi]])
            self._give("ids", pa.table({"d": d, "p": np.arange(len(flat), dtype=np.int32), "id": flat}))
            for doc, text, known in self.con.execute(DECODE).fetchall():
                if not known:
                    raise ValueError("an id is not in the vocabulary")
                out[doc] = text.encode("latin-1")
            lo = hi
        return out


def codec(path: str, pattern: str) -> Codec:
    box = worker_cache(f"codec-{path}")
    if "codec" not in box:
        box["codec"] = Codec(path, pattern)
    return box["codec"]


def _defaults(path, pattern):
    import public_tokenizers
    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


#: Texts encoded together: about this many characters, one text at least.
GROUP_CHARS = 2_000_000
#: Words and chunks a worker remembers, and the memory of its DuckDB.
MEMO, MEMORY = 600_000, "300MB"


def _groups(values, size):
    group, held = [], 0
    for v in values:
        group.append(v)
        held += size(v)
        if held >= GROUP_CHARS:
            yield group
            group, held = [], 0
    if group:
        yield group


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """(id, ids): the token ids of every text as little-endian unsigned 32-bit
    integers in one binary value."""
    path, pattern = _defaults(path, pattern)
    rows = id_text(docs, id_col, text_col)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            lo = 0
            for group in _groups((t.as_py() for t in batch.column(1)), len):
                done = codec(path, pattern).encode(group)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:lo + len(group)], pa.array(done, pa.binary())],
                                                 names=["id", "ids"])
                lo += len(group)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids binary") \
        .withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """(id, ids, decoded): the bytes that the ids stand for; null ids are none."""
    path, pattern = _defaults(path, pattern)
    rows = tokens.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            lo = 0
            for group in _groups((t.as_py() for t in batch.column(1)), len):
                done = codec(path, pattern).decode(group)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:lo + len(group)], pa.array(group, pa.binary()), pa.array(done, pa.binary())],
                    names=["id", "ids", "decoded"])
                lo += len(group)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids binary, decoded binary") \
        .withColumnRenamed("id", id_col)
