"""Merkle dataset manifest: a nested-struct rollup.

Every row is a leaf, the SHA-256 of its fields.  The leaves of a tree (one per
value of ``tree_col``) are ranked by id, and the rank is written in base 8.
Within a block of 8 ** DIGITS consecutive leaves the digits are grouped away
one after the other, last digit first: each grouping nests its children, in
order, as an array of structs in their parent, whose digest is the hash of
theirs.  All groupings of a block run on one partitioning by (tree, block), so
a block costs one shuffle of narrow rows and no row ever holds more than
8 ** DIGITS leaves.  The digests of the blocks are the leaves of the next round, until each
tree is one block; the trees' roots, ranked by tree, are rolled up in the same
way into the root of the manifest.

On the way back every block meets the proof of its own digest, one row each, by
a union and a grouping; its nested structs are then exploded level by level, and
each child adds the digests left and right of it.  There is no join between
nodes: the one join adds an offset to the ranks, one row per partition.

A run of children that is one node and also all nodes of its level is passed on
unhashed, as the tree ends there; as ranks have no gaps this is so exactly if the
run is the first of its tree and has one child, which its own digits tell.

Defined results: nulls in any column are the field ``-``; a null tree value is a
tree of its own, the first; leaves with the same id (null ids first) are ordered
by their hash, so the result does not depend on the layout; equal rows are
leaves of their own, next to each other; an empty table has no rows and no
root.  Only the columns named are read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from convgraph.llm.common import dropped, stored

FAN = 8
#: A block holds at most FAN ** DIGITS nodes.
DIGITS = 3
#: Columns of a document that its leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields=FIELDS, **other: Column) -> Column:
    """Digest of a row; ``other`` gives fields another value than their column's."""
    return digest(*[field(other.get(c, F.col(c))) for c in fields])


def fold(of: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, of, lambda acc, step: F.sha2(F.concat(step["left"], acc, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """All sibling digests of a proof as one string, from the leaf to the root."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def _ranked(rows: DataFrame, tree: str, order: list) -> tuple[DataFrame, list]:
    """Adds ``pos``, the place of each row among those of its tree, from 0 on.

    The rows are range partitioned by (tree, order); equal rows are dealt out by
    a seeded draw.  A task counts within the runs of equal trees it holds; only
    its first run can go on from tasks before, so one number per task is added."""
    order = [F.col(tree).asc_nulls_first(), *order, F.col("_drawn")]
    ranged = (rows.withColumn("_drawn", F.rand(29)).repartitionByRange(*order).sortWithinPartitions(*order)
              .drop("_drawn"))

    def count(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        task, run, n, last, begun = TaskContext.get().partitionId(), 0, 0, None, False
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            trees = batch.column(batch.schema.get_field_index(tree))
            codes = trees.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new = np.append(True, codes[1:] != codes[:-1])
            new[0] = begun and trees[0].as_py() != last
            runs = run + np.cumsum(new)
            start = np.maximum.accumulate(np.where(new, np.arange(rows), 0))
            at = np.arange(rows) - start + np.where(runs == run, n, 0)
            run, n, last, begun = int(runs[-1]), int(at[-1]) + 1, trees[rows - 1].as_py(), True
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(rows, task)), pa.array(runs), pa.array(at)],
                names=[*batch.schema.names, "_task", "_run", "_at"])

    kind = StructType([*ranged.schema.fields, *[StructField(c, LongType()) for c in ("_task", "_run", "_at")]])
    counted = stored(ranged.mapInArrow(count, kind), "merkle-ranks")
    runs = counted.groupBy("_task", "_run").agg(F.first(tree).alias(tree), F.count(F.lit(1)).alias("n"))
    ends = Window.partitionBy("_task")
    ends = runs.withColumn("_last", F.max("_run").over(ends)).where("_run = 0 OR _run = _last")
    before = F.sum("n").over(Window.partitionBy(tree).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    # one row per task that has rows
    offsets = (ends.select("_task", "_run", F.coalesce(before, F.lit(0)).alias("_before")).where("_run = 0"))
    out = counted.join(F.broadcast(offsets), ["_task", "_run"], "left")
    return out.withColumn("pos", F.col("_at") + F.coalesce("_before", F.lit(0))) \
              .drop("_task", "_run", "_at", "_before"), [counted]


def _nest(nodes: DataFrame, digits: int) -> DataFrame:
    """(tree, block, digest, hashed, kids) of nodes (tree, pos, digest, item)."""
    size = FAN ** digits
    names = [f"d{i}" for i in range(digits)]
    level = nodes.select("tree", F.expr(f"pos div {size}").alias("block"),
                         *[F.expr(f"cast((pos div {FAN ** i}) % {FAN} as byte)").alias(f"d{i}") for i in range(digits)],
                         F.struct("digest", "item").alias("node")).repartition("tree", "block")
    while names:
        digit, names = names[0], names[1:]
        level = level.groupBy("tree", "block", *names).agg(
            F.sort_array(F.collect_list(F.struct(F.col(digit).alias("digit"), "node"))).alias("kids"))
        # the digits left, if all 0, and block 0: the first run of its tree
        first = F.expr(" AND ".join(["block = 0", *[f"{d} = 0" for d in names]]))
        level = level.withColumn("kids", F.col("kids.node")) \
            .withColumn("hashed", ~(first & (F.size("kids") == 1))) \
            .withColumn("digest", F.when(F.col("hashed"), F.sha2(F.array_join("kids.digest", ""), 256))
                        .otherwise(F.col("kids")[0]["digest"]))
        level = level.select("tree", "block", *names, F.struct("digest", "hashed", "kids").alias("node"))
    return level.select("tree", "block", "node.*")


def _unnest(blocks: DataFrame, digits: int) -> DataFrame:
    """(tree, pos, item, proof, top, digest) of blocks that know the proof of their own digest."""
    level = blocks.select("tree", F.col("block").alias("pos"), F.struct("digest", "hashed", "kids").alias("node"),
                          "proof", "top")
    for _ in range(digits):
        level = level.select("tree", "pos", "proof", "top", F.col("node.hashed").alias("hashed"),
                             F.col("node.kids.digest").alias("digests"), F.posexplode("node.kids").alias("i", "kid"))
        step = F.struct(F.array_join(F.slice("digests", F.lit(1), F.col("i")), "").alias("left"),
                        F.array_join(F.slice("digests", F.col("i") + 2, F.lit(FAN)), "").alias("right"))
        level = level.select("tree", (F.col("pos") * FAN + F.col("i")).alias("pos"), F.col("kid").alias("node"), "top",
                             F.when(F.col("hashed"), F.concat(F.array(step), "proof")).otherwise(F.col("proof")).alias("proof"))
    return level.select("tree", "pos", "node.item", "node.digest", "proof", "top")


NO_PROOF = "cast(array() AS array<struct<left: string, right: string>>)"


def _forest(nodes: DataFrame, digits: int) -> list[DataFrame]:
    """Rounds of blocks until every tree is one block."""
    rounds = []
    while True:
        rounds.append(stored(_nest(nodes, digits), f"merkle-{len(rounds)}"))
        if rounds[-1].where("block > 0").isEmpty():
            return rounds
        nodes = rounds[-1].select("tree", F.col("block").alias("pos"), "digest", F.lit(None).cast("int").alias("item"))


def _proofs(rounds: list[DataFrame], tops: DataFrame, digits: int) -> DataFrame:
    """Proofs of the first round's nodes, given (tree, proof, top) of its trees."""
    above = tops.withColumn("pos", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        mine = blocks.select("tree", "block", "digest", "hashed", "kids", F.lit(None).cast(above.schema["proof"].dataType).alias("proof"),
                             F.lit(None).cast(above.schema["top"].dataType).alias("top"))
        theirs = above.select("tree", F.col("pos").alias("block"),
                              *[F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in ("digest", "hashed", "kids")],
                              "proof", "top")
        met = mine.unionByName(theirs).groupBy("tree", "block").agg(
            *[F.first(c, ignorenulls=True).alias(c) for c in ("digest", "hashed", "kids", "proof", "top")])
        above = _unnest(met, digits)
    return above


def manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", fields=FIELDS, digits: int = DIGITS,
             **carried: Column) -> DataFrame:
    """One row per row of ``docs``: (id, tree, position, leaf, subroot, root,
    proof), the proof an array from the leaf to the root of (left, right): the
    digests of the run's other children, put together.  ``carried`` columns,
    expressions over ``docs``, come along."""
    leaves = docs.select(F.col(tree_col).alias("tree"), F.col(id_col).alias("id"), leaf(fields).alias("digest"),
                         F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in carried.items()]).alias("carried"))
    leaves = stored(leaves, "merkle-leaves")
    ranked, used = _ranked(leaves, "tree", [F.col("id").asc_nulls_first(), F.col("digest"), F.col("carried")])
    trees = _forest(ranked.select("tree", "pos", "digest", F.struct("id", "carried").alias("item")), digits)
    dropped(leaves, *used)
    # all subroots are one tree; a subroot's item is the tree that it stands for
    ordered, used = _ranked(trees[-1].select(F.lit(0).alias("all"), F.col("tree").alias("key"), "digest"), "all",
                            [F.col("key").asc_nulls_first()])
    top = _forest(ordered.select(F.col("all").alias("tree"), "pos", "digest",
                                 F.struct(F.col("key").alias("key")).alias("item")), digits)
    dropped(*used)
    root = top[-1].select("tree", F.expr(NO_PROOF).alias("proof"), F.struct(F.col("digest").alias("root")).alias("top"))
    per_tree = _proofs(top, root, digits).select(
        F.col("item.key").alias("tree"), "proof", F.struct("top.root", F.col("digest").alias("subroot")).alias("top"))
    per_leaf = _proofs(trees, per_tree, digits)
    return per_leaf.select(F.col("item.id").alias(id_col), F.col("tree").alias(tree_col), F.col("pos").alias("position"),
                           F.col("digest").alias("leaf"), "top.subroot", "top.root", "proof",
                           *[F.col("item.carried")[n].alias(n) for n in carried])
