r"""PII: information-theoretic sanitisation.

Protected entities are what the base rules find (mail and IP addresses, payment
cards, telephone numbers), by their normalised value.  The corpus says how
strongly a term reveals one: with N documents, n(e) that name the entity, n(t)
that hold the term and n(t, e) that hold the term within ``CONTEXT`` words of a
mention, the information that t gives about e is the pointwise mutual
information log(N n(t, e) / (n(t) n(e))), and what there is to know is
IC(e) = log(N / n(e)).  A term discloses e if it gives at least ``THRESHOLD`` of
IC(e), which is the same as log(n(t) / n(t, e)) <= (1 - THRESHOLD) log(N / n(e)),
and stands near e in at least ``SUPPORT`` different contexts, so that copies of
one document prove nothing.  A disclosing term is sanitised wherever it occurs:
it is generalised to its first ``CLASS`` letters if that class of terms does not
itself disclose a protected entity, and removed if it does.

Jobs: one scan notes the contexts of mentions, at most 2 * CONTEXT terms and
their classes for one mention; pairs are counted with map-side combination.  A
second scan counts the documents of the terms in question, combined per task.  A
third finds the base spans and the places of disclosing terms.  The two later
scans see the terms through a Bloom filter of fixed size (``BLOOM_BITS``); what it
lets through is settled by joins, so it affects the cost alone.  Joins that can
meet a hot key (a common term, a common entity) are salted.

The base rules are linear in the text: runs of the classes are entered at their
first character only.

Defined results: a null text is empty and has no spans; every row is a document
(rows that repeat an id or a text, or have a null id, count and are reported
each); an entity that is named in every document has nothing to disclose; an
empty table gives an empty one.  Terms are words, without what is not a letter or
digit at their ends, lower-cased, of two characters at least, that do not overlap
a base span.
"""
from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame, functions as F

from convgraph.llm.common import id_text, stored

KINDS = ("email", "ip", "card", "phone")
#: What the method adds, after the base kinds.
ADDED = ("general", "removed")
CONTEXT = 10
THRESHOLD = 0.9
SUPPORT = 3
CLASS = 3
BLOOM_BITS = 1 << 23
BLOOM_MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
SALTS = 16
#: Terms that a task counts before it hands its sums on, and raw words that it remembers.
FLUSH_TERMS = 500_000

# ------------------------------------------------------------ base rules

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def _emails(text: str):
    """Spans of the mail rule: the run of local characters before an @ that a
    domain follows, not before the end of the last match."""
    done = 0
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at) if at > done and text[at - 1] in _LOCAL_CHARS else None
        if domain is None:
            at = text.find("@", at + 1)
            continue
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        yield start, domain.end()
        done = domain.end()
        at = text.find("@", done)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, normalised value) by kind, then start."""
    out = []
    if "@" in text:
        out += [("email", s, e, text[s:e].lower()) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append(("ip", *m.span(), ".".join(parts)))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:  # 19 digits with a separator between any two
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = _digits(m.group())
            if 8 <= len(digits) <= 15:
                out.append(("phone", *m.span(), digits))
    return out


# ------------------------------------------------------------ terms

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


_OTHER_SPACE = re.compile(r"[\x09-\x0D]")


def distinct_words(text: str) -> set[str]:
    """The words of a text; the empty string may be among them."""
    return set((_OTHER_SPACE.sub(" ", text) if _OTHER_SPACE.search(text) else text).split(" "))


def term(word: str) -> str | None:
    """The term of a word, or None."""
    if word.isalnum():
        return word.lower() if len(word) > 1 else None
    lo, hi = 0, len(word)
    while lo < hi and not word[lo].isalnum():
        lo += 1
    while hi > lo and not word[hi - 1].isalnum():
        hi -= 1
    return word[lo:hi].lower() if hi - lo >= 2 else None


def term_class(t: str) -> str:
    return t[:CLASS] + "*"


def _free_words(text: str, spans):
    """(start, end, position) of the words that overlap no base span; positions
    count all words.  Also the range of word positions of every span."""
    taken = sorted((s, e, i) for i, (_k, s, e, _v) in enumerate(spans))
    words, places = [], [[None, None] for _ in spans]
    waiting, active = 0, []
    for n, m in enumerate(_WORD.finditer(text)):
        s, e = m.span()
        active = [x for x in active if x[1] > s]
        while waiting < len(taken) and taken[waiting][0] < e:
            if taken[waiting][1] > s:
                active.append(taken[waiting])
            waiting += 1
        for _s, _e, i in active:
            places[i][0] = n if places[i][0] is None else places[i][0]
            places[i][1] = n
        if not active:
            words.append((s, e, n))
    return words, places


def mentions(text: str, context: int = CONTEXT):
    """{entity: {term: the first context in which it stands near the entity}};
    the term None stands for the entity alone."""
    import bisect
    import hashlib
    spans = base_spans(text)
    if not spans:
        return {}
    words, places = _free_words(text, spans)
    at = [n for _s, _e, n in words]
    out: dict = {}
    for (kind, _s, _e, value), (first, last) in zip(spans, places):
        i, j = bisect.bisect_left(at, first - context), bisect.bisect_right(at, last + context)
        near = [t for t in (term(text[s:e]) for s, e, _n in words[i:j]) if t]
        found = out.setdefault(f"{kind}:{value}", {None: None})
        if near:
            key = int.from_bytes(hashlib.blake2b("\n".join(near).encode(), digest_size=8).digest(), "little", signed=True)
            for t in near:
                found.setdefault(t, key)
                found.setdefault(term_class(t), key)
    return out


# ------------------------------------------------------------ Bloom filter

def _bits(t: str):
    """Places of a term in the filter, from 32 bits of its bytes: all that equal
    ones cost is a row that a join drops."""
    h = zlib.crc32(t.encode())
    for c in BLOOM_MIX:
        yield (h * c >> 9) & (BLOOM_BITS - 1)


def _bloom(terms: DataFrame):
    """The terms (column ``term``) as a bit array: at most BLOOM_BITS / 64 rows
    come to the driver, whatever the number of terms."""
    import numpy as np

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            at = np.array([b for t in batch.column(0).to_pylist() for b in _bits(t)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at // 64), pa.array((np.uint64(1) << (at % 64).astype(np.uint64)).view(np.int64))], names=["word", "bits"])
    words = terms.select("term").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(BLOOM_BITS // 64, dtype=np.uint64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return terms.sparkSession.sparkContext.broadcast(bits.tobytes())


class _Known(dict):
    """word -> its term and class as far as the filter knows them, remembered."""

    def __init__(self, bits: bytes, classes: bool):
        super().__init__()
        self.bits, self.classes, self.of_class = bits, classes, {}

    def has(self, t: str) -> bool:
        for b in _bits(t):
            if not self.bits[b >> 3] >> (b & 7) & 1:
                return False
        return True

    def __missing__(self, word: str):
        t, out = term(word), ()
        if t is not None:
            if self.has(t):
                out = (t,)
            if self.classes:
                c = t[:CLASS]
                known = self.of_class.get(c)
                if known is None:
                    known = self.of_class[c] = (c + "*",) if self.has(c + "*") else ()
                    if len(self.of_class) > FLUSH_TERMS:
                        self.of_class.clear()
                out += known
        if len(word) <= 64:
            if len(self) >= FLUSH_TERMS:
                self.clear()
            self[word] = out
        return out


# ------------------------------------------------------------ jobs

def _mention_rows(rows: DataFrame, context: int) -> DataFrame:
    """(entity, term, context): one row per document, entity and term near it; a
    null term for the entity itself."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            out = ([], [], [])
            for text in batch.column(0).to_pylist():
                for entity, found in mentions(text, context).items():
                    out[0].extend([entity] * len(found))
                    out[1].extend(found.keys())
                    out[2].extend(found.values())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())],
                                             names=["entity", "term", "context"])
    # no entity without a digit or an @: most documents need not reach Python
    return rows.where(F.col("text").rlike("[0-9@]")).select("text").mapInArrow(run, "entity string, term string, context long")


def _salted(many: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join in which a hot key of ``many`` is spread over SALTS tasks."""
    many = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return many.join(few, [key, "_salt"]).drop("_salt")


def term_documents(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n_term): documents that hold each of ``terms`` (a term or class)."""
    bits = _bloom(terms)

    def run(batches):
        import pyarrow as pa
        from collections import Counter
        known, counts = _Known(bits.value, True), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                              names=["term", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update({t for found in map(known.__getitem__, distinct_words(text)) if found for t in found})
                if len(counts) > FLUSH_TERMS:
                    yield out()
                    counts.clear()
        yield out()
    counted = rows.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    return counted.join(terms.select("term").distinct(), "term", "left_semi")


def disclosing_terms(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT,
                     context: int = CONTEXT) -> DataFrame:
    """(entity, term, n_entity, n_term, n_both, n_contexts, share): terms and
    classes (ending in *) that give at least ``threshold`` of what there is to
    know about an entity."""
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    near = _mention_rows(rows, context).groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n"))
    near = stored(near.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("n_contexts")),
                  "disclosure-pairs")
    entities = near.where("term IS NULL").select("entity", F.col("n_both").alias("n_entity"))
    pairs = near.where((F.col("n_contexts") >= support) & F.col("term").isNotNull())
    counts = stored(term_documents(rows, pairs.select("term").distinct()), "disclosure-terms")
    total = float(max(rows.count(), 1))
    told = _salted(_salted(pairs, entities, "entity", "term"), counts, "term", "entity")
    share = 1 - F.log(F.col("n_term") / F.col("n_both")) / F.log(F.lit(total) / F.col("n_entity"))
    return (told.where(F.col("n_entity") < total).withColumn("share", share).where(F.col("share") >= threshold)
            .select("entity", "term", "n_entity", "n_term", "n_both", "n_contexts", "share"))


def actions(disclosing: DataFrame) -> DataFrame:
    """(term, kind): whether a disclosing term is generalised or removed."""
    found = disclosing.select("term").distinct()
    classes = found.where(F.col("term").endswith("*")).select(F.col("term").alias("class"))
    terms = found.where(~F.col("term").endswith("*")).withColumn(
        "class", F.concat(F.substring("term", 1, CLASS), F.lit("*")))
    return terms.join(classes.withColumn("told", F.lit(True)), "class", "left").select(
        "term", F.when(F.col("told"), F.lit("removed")).otherwise(F.lit("general")).alias("kind"))


_SPAN = "struct<kind: string, start: bigint, end: bigint>"


def _places(rows: DataFrame, revealing: DataFrame, with_text: bool) -> DataFrame:
    """(rid, id, base, hits[, text]): base spans and places of terms that pass
    the filter."""
    bits = _bloom(revealing)
    kind = rows.schema["id"].dataType.simpleString()
    hit = "struct<term: string, start: bigint, end: bigint>"
    ddl = f"rid bigint, id {kind}, base array<{_SPAN}>, hits array<{hit}>" + ", text string" * with_text

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        rid, known = TaskContext.get().partitionId() << 33, _Known(bits.value, False)

        def lists(rows, first):
            cuts = [0]
            for r in rows:
                cuts.append(cuts[-1] + len(r))
            flat = [x for r in rows for x in r]
            structs = pa.StructArray.from_arrays(
                [pa.array([x[0] for x in flat], pa.string()), *[pa.array([x[i] for x in flat], pa.int64()) for i in (1, 2)]],
                names=[first, "start", "end"])
            return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), structs)
        for batch in batches:
            base, hits, texts = [], [], batch.column(1).to_pylist()
            for text in texts:
                spans = base_spans(text)
                found = []
                words = {w for w in distinct_words(text) if known[w]}
                if words:
                    for s, e, _n in _free_words(text, spans)[0]:
                        if text[s:e] in words:
                            t = known[text[s:e]][0]
                            while not text[s].isalnum():
                                s += 1
                            while not text[e - 1].isalnum():
                                e -= 1
                            found.append((t, s, e))
                base.append([x[:3] for x in spans])
                hits.append(found)
            n = batch.num_rows
            cols = [pa.array(range(rid, rid + n), pa.int64()), batch.column(0), lists(base, "kind"), lists(hits, "term")]
            rid += n
            yield pa.RecordBatch.from_arrays(cols + [batch.column(1)] * with_text,
                                             names=["rid", "id", "base", "hits"] + ["text"] * with_text)
    return rows.mapInArrow(run, ddl)


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                  support: int = SUPPORT, context: int = CONTEXT, with_text: bool = False) -> DataFrame:
    """(id, base, added[, text]): spans as arrays of (kind, start, end), code
    points, end exclusive, by kind and start."""
    revealing = stored(actions(disclosing_terms(docs, text_col, threshold, support, context)), "disclosure-actions")
    places = stored(_places(id_text(docs, id_col, text_col), revealing, with_text), "disclosure-places")
    hits = places.where(F.size("hits") > 0).select("rid", F.inline("hits"))
    added = _salted(hits, revealing, "term", "rid").groupBy("rid").agg(
        F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    none = F.array().cast(f"array<{_SPAN}>")
    return places.join(added, "rid", "left").select(
        F.col("id").alias(id_col), "base", F.coalesce("added", none).alias("added"), *["text"] * with_text)


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """(id, text): protected entities become <kind>, disclosing terms the first
    letters of their class and an asterisk, or nothing; of overlapping spans the
    first by place counts."""
    found = private_spans(docs, id_col, text_col, with_text=True, **parameters)

    def replace(text, spans):
        import pandas as pd
        out = []
        for t, own in zip(text, spans):
            parts, done = [], 0
            for s, e, kind in sorted((x["start"], x["end"], x["kind"]) for x in own):
                if s < done:
                    continue
                shown = {"general": t[s:s + CLASS] + "*", "removed": ""}.get(kind, f"<{kind}>")
                parts += [t[done:s], shown]
                done = e
            out.append("".join([*parts, t[done:]]))
        return pd.Series(out)
    return found.select(id_col, F.pandas_udf(replace, "string")("text", F.concat("base", "added")).alias("text"))
