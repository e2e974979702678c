"""MinHash near-dedup: multi-index Hamming join over b-bit signatures.

A text becomes the set of its distinct 5-word shingles (64-bit hashes over
BLAKE2b digests of the words, so no one makes words that collide at will) and a
signature of 5 m minima, each cut to b = 16 bits.  Pairs whose signatures differ
in at most 2 m - 1 symbols are wanted.  With m = 7 two sets of similarity 0.85
differ in 5.25 symbols on average and 3 in 10,000 such pairs in more than 13;
with m = 10 sets of similarity 0.8 differ in 10 and 9 in 10,000 in more than 19;
for more similar sets the loss falls fast.  The signature is split into m chunks
of 5 symbols.  By the pigeonhole principle a wanted pair has a chunk with at
most one wrong symbol, as m chunks with two or more would make 2 m.  The
allowed error of a chunk is enumerated as a wildcard: each chunk gives 5 keys,
each over the other 4 symbols, so every wanted pair shares one of its keys.

Texts with equal sets are one node from the start.  The members of a bucket
(equal key) are linked in two steps, without listing its pairs:

1. star: every member against the bucket's smallest id; distance and size
   filter, then the exact intersection of the full sets;
2. buckets whose members are not yet all connected are cut into blocks of
   about 512, or less where texts are so long that these would hold more than
   ``BLOCK_SHINGLES`` on average; a task takes two blocks, compares signatures with numpy, and
   confirms on the full sets only pairs that pass the distance, that are not
   connected yet and for which this bucket is the first one they share.  It
   returns confirmed links that connect something, at most one per member.

Buckets of any size are handled whole: there is no cap.  The links' connected
components give the classes.

Defined results: null and white-space-only texts have an empty set and are
linked with nothing; fewer than five words make one shingle; rows that repeat
an id are judged row by row; rows with a null id join a class of equal sets
but never name it while it has another id; an empty table gives an empty one.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from convgraph.llm.common import (LOWER, dropped, id_text, mix, one_null_row, per_salt, salt_bits, splitmix, stored,
                                   text_slices, whole_rows, window_hashes, with_salt, word_digests, word_spans)
from convgraph.operators.graph import connected_components
from convgraph.operators.relations import global_positions

SHINGLE = 5
CHUNK = 5
BLOCK = 512
#: Shingles of a block on average (64 MB), where its texts are long.
BLOCK_SHINGLES = 1 << 23
#: Bytes of text whose shingles a task makes at a time, one text at least.
SLICE = 500_000


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offs)
    words = word_digests(data, starts, ends)
    windows = window_hashes(words, k)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        if z - a >= k:
            out.append(np.unique(windows[a:z - k + 1]))
        elif z > a:
            out.append(window_hashes(words[a:z], z - a, seed=100 + z - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature_rows(sets: list[np.ndarray], chunks: int) -> list[bytes | None]:
    """The b-bit signature of each set, 2 bytes a symbol; None if empty."""
    symbols = chunks * CHUNK
    full = [s for s in sets if len(s)]
    if not full:
        return [None] * len(sets)
    x = np.concatenate(full)
    at = np.cumsum([0] + [len(s) for s in full[:-1]])
    sig = np.empty((len(full), symbols), dtype="<u2")
    with np.errstate(over="ignore"):
        for j, a in enumerate(splitmix(11, symbols)):
            sig[:, j] = mix(np.minimum.reduceat(x * a, at)) >> np.uint64(48)
    it = iter(sig)
    return [next(it).tobytes() if len(s) else None for s in sets]


def signatures(rows: DataFrame, chunks: int) -> DataFrame:
    """(id, text) -> (id, n, set_hash, sig)."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import hashlib
        import pyarrow as pa
        for batch in batches:
            for lo, hi, data, offs in text_slices(batch, slice_bytes=SLICE):
                sets = shingle_sets(data, offs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                     pa.array(signature_rows(sets, chunks), pa.binary())], names=["id", "n", "set_hash", "sig"])
    return rows.mapInArrow(run, f"id {kind}, n long, set_hash binary, sig binary")


def set_rows(rows: DataFrame, chunks: int) -> DataFrame:
    """(id, text) -> (node, n, sig, members): the full sets."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for lo, hi, data, offs in text_slices(batch, slice_bytes=SLICE):
                sets = shingle_sets(data, offs)
                ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(signature_rows(sets, chunks), pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["node", "n", "sig", "members"])
    return rows.mapInArrow(run, f"node {kind}, n long, sig binary, members array<long>")


def bucket_keys(reps: DataFrame, chunks: int) -> DataFrame:
    """(node, n, slot, key): one key per chunk and wildcard."""
    keys = []
    for c in range(chunks):
        for w in range(CHUNK):
            at = 2 * CHUNK * c
            rest = F.concat(F.substring("sig", at + 1, 2 * w),
                            F.substring("sig", at + 2 * w + 3, 2 * (CHUNK - 1 - w)))
            keys.append(F.struct(F.lit(c * CHUNK + w).cast("byte").alias("slot"),
                                 F.xxhash64(F.lit(c * CHUNK + w), rest).alias("key")))
    return reps.select("node", "n", F.inline(F.array(*keys)))


def distance(a: str, b: str, chunks: int):
    return F.expr(f"size(filter(sequence(0, {chunks * CHUNK - 1}), "
                  f"i -> substring({a}, 2 * i + 1, 2) <> substring({b}, 2 * i + 1, 2)))")


def similar(common, na, nb, percent: int):
    return 100 * common >= percent * (na + nb - common)


def link_block(group, percent: int, chunks: int):
    """Confirmed links of one pair of blocks that connect something new.
    ``group``: node, label, n, sig, members, block; slot, one, two alike."""
    import pandas as pd
    slot, one, two = int(group["slot"].iloc[0]), int(group["one"].iloc[0]), int(group["two"].iloc[0])
    chunk, wild = divmod(slot, CHUNK)
    group = group.sort_values("node", ignore_index=True)
    sig = np.frombuffer(b"".join(group["sig"]), dtype="<u2").reshape(-1, chunks * CHUNK)
    n = group["n"].to_numpy()
    block = group["block"].to_numpy()
    node, members = group["node"].tolist(), group["members"].tolist()
    _, label = np.unique(group["label"].to_numpy(), return_inverse=True)
    root = list(range(len(node)))
    head: dict[int, int] = {}
    for i, l in enumerate(label.tolist()):
        root[i] = head.setdefault(l, i)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    wanted = []
    for i in np.flatnonzero(block == one).tolist():
        other = np.arange(i + 1, len(node)) if one == two else np.flatnonzero(block == two)
        other = other[(label[other] != label[i])
                      & (100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i]))]
        if not len(other):
            continue
        wrong = (sig[other] != sig[i]).reshape(-1, chunks, CHUNK)
        per_chunk = wrong.sum(axis=2)
        far = per_chunk.sum(axis=1)
        first = per_chunk[:, :chunk].min(axis=1, initial=2) >= 2  # no earlier chunk matches
        here = per_chunk[:, chunk]
        first &= ((here == 1) & wrong[:, chunk, wild]) | ((here == 0) & (wild == 0))
        for k in np.flatnonzero(first & (far < 2 * chunks)).tolist():
            wanted.append((int(far[k]), i, int(other[k])))
    wanted.sort()
    links = []
    for _, i, j in wanted:
        a, b = find(i), find(j)
        if a != b:
            both = len(np.intersect1d(members[i], members[j], assume_unique=True))
            if similar(both, int(n[i]), int(n[j]), percent):
                root[max(a, b)] = min(a, b)
                links.append((node[i], node[j]))
    return pd.DataFrame(links, columns=["src", "dst"])


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85,
               chunks: int = 7) -> DataFrame:
    """(id, n_shingles, component_id, kept): texts whose similarity is at least
    ``percent`` hundredths are linked; a component is named by its smallest id.
    7 chunks fit ``percent`` of 85 or more, 10 chunks 80 or more."""
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    sigs = stored(signatures(rows, chunks), "signatures")
    classes = with_salt(sigs.where("n > 0")).groupBy("set_hash", "n") \
        .agg(F.min("id").alias("node"), F.min("sig").alias("sig"), *salt_bits())
    reps = stored(classes, "classes")
    nodes = reps.where("node IS NOT NULL").select("node", "n", "sig")

    keys = bucket_keys(nodes, chunks)
    buckets = keys.groupBy("slot", "key") \
        .agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")).where("size > 1") \
        .withColumn("blocks", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")) \
        .drop("shingles")
    members = stored(keys.drop("n").join(buckets, ["slot", "key"]), "members")  # rows of shared buckets only

    needed = members.select(F.col("node").alias("id")).distinct()
    sets = stored(set_rows(rows.where("id IS NOT NULL").join(needed, "id", "left_semi"), chunks), "sets")

    def side(name):
        return sets.select(*[F.col(c).alias(f"{c}_{name}") for c in ("node", "n", "sig", "members")])
    pairs = members.where("node <> hub").select("hub", F.col("node").alias("leaf")).distinct()
    near = (pairs.join(side("h"), F.col("hub") == F.col("node_h"))
                 .join(side("l"), F.col("leaf") == F.col("node_l"))
                 .where(100 * F.least("n_h", "n_l") >= percent * F.greatest("n_h", "n_l"))
                 .where(distance("sig_h", "sig_l", chunks) < 2 * chunks)
                 .withColumn("both", F.size(F.array_intersect("members_h", "members_l")))
                 .where(similar(F.col("both"), F.col("n_h"), F.col("n_l"), percent)))
    star = stored(near.select(F.col("hub").alias("src"), F.col("leaf").alias("dst")).distinct(), "star")

    # Labels: equal ones prove that two nodes are connected; they need not be final.
    up = star.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("label"))
    up = up.join(up.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left") \
           .select("node", F.coalesce("top", "label").alias("label"))
    labelled = members.join(up, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = labelled.groupBy("slot", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")) \
        .where("lo <> hi").select("slot", "key")
    left = (labelled.join(open_, ["slot", "key"])
            .where("size > 2")  # two members: the star has seen the pair
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("peer", F.explode(F.expr("sequence(0, blocks - 1)")))
            .select("slot", "key", F.least("block", "peer").alias("one"), F.greatest("block", "peer").alias("two"),
                    "block", "node", "label")
            .join(sets, "node"))
    more = left.groupBy("slot", "key", "one", "two").applyInPandas(
        lambda g: link_block(g, percent, chunks), f"src {kind}, dst {kind}")
    links = stored(star.union(more), "links")

    roots = connected_components(links).withColumnRenamed("id", "node")
    named = (reps.drop("sig").join(roots, "node", "left")
             .withColumn("component_id", F.coalesce("root", "node")).drop("node", "root"))
    out = (with_salt(sigs).join(per_salt(named), ["set_hash", "n", "salt"], "left")
           .withColumn("component_id", F.coalesce("component_id", "id"))
           .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                   F.col("id").eqNullSafe(F.col("component_id")).alias("kept")))
    dropped(members, sets, star, links)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80,
             chunks: int = 10) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of
    each group, the one with the smallest id.  A document is a distinct pair of
    id and text, or a distinct text of rows without an id; these come after all
    ids, take part in every comparison, and of equal ones with words one row
    stays.  If ids are null or repeated, documents are numbered first."""
    unclear = docs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL")
    if unclear.isEmpty():  # an id is a row
        ids = near_dedup(docs, id_col, text_col, percent, chunks).where("kept") \
            .select(F.col(id_col).alias("_kept_id"))
        return docs.join(ids, docs[id_col] == ids["_kept_id"], "left_semi")
    rows = whole_rows(docs, id_col, text_col)
    words = F.col("text").rlike(r"[^\x20\x09-\x0D]")  # texts without any are linked with nothing
    rows = rows.where(F.col("id").isNotNull() | ~words).unionByName(one_null_row(rows.where(words), F.col("text"))) \
        .withColumn("sha", F.unhex(F.sha2("text", 256)))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha"))
    names = global_positions(rows.select(F.col("id").alias("_id"), F.col("sha").alias("_sha")).distinct(),
                             [F.col("_id").asc_nulls_last(), F.col("_sha")], "number")
    names = stored(names, "document-numbers")
    texts = rows.groupBy("id", "sha").agg(F.min("text").alias("text"))
    texts = stored(texts.join(names, same).select("number", "text"), "numbered-documents")
    kept = near_dedup(texts, "number", "text", percent, chunks).where("kept").select("number")
    stay = names.join(kept, "number", "left_semi")
    return rows.join(stay, same, "left_semi").select(*[F.col("_row")[c].alias(c) for c in docs.columns])
