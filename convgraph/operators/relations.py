"""Relational operators: dedup, explode, id assignment, ordered string
aggregation, audits (P8-P16, J1-J4, A1-A15, W1-W3, U1-U4).

Scale notes
* "first row per key" is a hash aggregate of ``min(struct(order..., row))``
  -- partial aggregation combines map-side, so a key holding a third of the
  rows costs one row per map task, not a skewed window partition.
* global numbering (dense ids, ranks, running sums) never uses a
  single-partition window: rows are range-partitioned, the partition layout
  is pinned with a reliable checkpoint, and per-partition offsets (one row
  per partition) are added back through a broadcast join.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convgraph.session import cut_lineage

_IDX_BITS = 33  # monotonically_increasing_id layout: partition id << 33 | index


def _cols(cols):
    return [F.col(c) if isinstance(c, str) else c for c in cols]


# --------------------------------------------------------------------------
# distributed global order helpers
# --------------------------------------------------------------------------
def _ordered_partitions(df: DataFrame, order: list, num_partitions: int | None):
    # without an explicit count AQE may coalesce the range partitions of a
    # small (aggregated) table; large inputs keep the session's parallelism
    ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    ranged = (ranged.sortWithinPartitions(*order)
                .withColumn("_mid", F.monotonically_increasing_id()))
    # pin the range layout: ids must not change if a stage is recomputed
    ranged = cut_lineage(ranged)
    ranged = (ranged.withColumn("_pid", F.shiftright("_mid", _IDX_BITS))
                    .withColumn("_idx", F.col("_mid").bitwiseAND((1 << _IDX_BITS) - 1))
                    .drop("_mid"))
    return ranged


def global_positions(df: DataFrame, order: list, pos_col: str = "pos",
                     num_partitions: int | None = None) -> DataFrame:
    """1-based position of each row in the total order ``order``.

    Equivalent to ``row_number() over (order by ...)`` but distributed: one
    range shuffle, a tiny per-partition count table, a broadcast join.
    ``order`` must be a total order (add a key column to break ties).
    """
    ranged = _ordered_partitions(df, _cols(order), num_partitions)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # offsets has one row per partition: its size is bounded by the
    # partition count, never by the data
    return (ranged.join(F.broadcast(offsets), "_pid")
                  .withColumn(pos_col, F.col("_off") + F.col("_idx") + 1)
                  .drop("_pid", "_idx", "_off"))


def global_running_sum(df: DataFrame, order: list, value: str, out: str = "running",
                       num_partitions: int | None = None) -> DataFrame:
    """``sum(value) over (order by ... rows unbounded preceding)`` without a
    single-partition window.  ``order`` must be a total order."""
    return global_running_sums(df, order, {value: out}, num_partitions)


def global_running_sums(df: DataFrame, order: list, sums: dict[str, str],
                        num_partitions: int | None = None) -> DataFrame:
    """Running sums of several columns ({value column: output column}) in one
    pass.  ``order`` must be a total order."""
    ranged = _ordered_partitions(df, _cols(order), num_partitions)
    per = ranged.groupBy("_pid").agg(*[F.sum(v).alias("_s_" + o) for v, o in sums.items()])
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("_pid", *[F.coalesce(F.sum("_s_" + o).over(w), F.lit(0)).alias("_o_" + o) for o in sums.values()])
    local = Window.partitionBy("_pid").orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.select("*", *[F.sum(v).over(local).alias("_l_" + o) for v, o in sums.items()]) \
                .join(F.broadcast(offsets), "_pid")
    out = out.select("*", *[(F.col("_o_" + o) + F.col("_l_" + o)).alias(o) for o in sums.values()])
    return out.drop("_pid", "_idx", *[p + o for o in sums.values() for p in ("_o_", "_l_")])


def competition_rank(df: DataFrame, value: str, out: str = "rank",
                     descending: bool = True) -> DataFrame:
    """``rank() over (order by value desc)`` through a value histogram:
    rank = 1 + number of rows with a strictly better value.  The histogram
    has one row per distinct value."""
    hist = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    order = [F.col(value).desc()] if descending else [F.col(value).asc()]
    cum = global_running_sum(hist, order, "_c", "_cum")
    ranks = cum.select(value, (F.col("_cum") - F.col("_c") + 1).alias(out))
    return df.join(ranks, value)


def exact_percentiles(df: DataFrame, value: str, percentiles, group: str | None = None) -> DataFrame:
    """Exact linear-interpolated percentiles (numpy's default rule) from a
    (group, value) histogram: its running counts tell which value holds each
    rank, so equal values are one row, whatever their number, and the rows
    themselves are neither ranked nor copied.  Returns (group?, p, value)."""
    keys = [group] if group else []
    hist = (df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
              .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))
    cum = global_running_sum(hist, [*keys, "_v"], "_c", "_cum")
    if keys:  # read once for the groups and once each for large and small ones
        cum = cut_lineage(cum)
    stats = cum.groupBy(*keys).agg(F.min(F.col("_cum") - F.col("_c")).alias("_off"), F.sum("_c").alias("_n"))
    cum = join_per_group(cum, stats, group, "_n") if keys else cum.crossJoin(F.broadcast(stats))
    to = F.col("_cum") - F.col("_off")
    wanted = F.array(*[F.lit(float(p)) for p in percentiles])
    h = lambda p: 1 + (F.col("_n") - 1) * p
    hit = cum.select(*keys, "_v", "_n", (to - F.col("_c")).alias("_a"), to.alias("_b"), F.explode(wanted).alias("p")) \
             .withColumn("_h", h(F.col("p")))
    holds = lambda r: (r > F.col("_a")) & (r <= F.col("_b"))
    low, high = F.floor("_h"), F.ceil("_h")
    out = hit.filter(holds(low) | holds(high)).groupBy(*keys, "p").agg(
        F.first("_h").alias("_h"), F.max(F.when(holds(low), F.col("_v"))).alias("_lo"),
        F.max(F.when(holds(high), F.col("_v"))).alias("_hi"))
    frac = F.col("_h") - F.floor("_h")
    return out.select(*keys, "p", (F.col("_lo") + frac * (F.col("_hi") - F.col("_lo"))).alias(value))


#: Groups whose rows are joined in place.
LARGEST = 1000


def join_per_group(rows: DataFrame, per: DataFrame, group: str, size: str) -> DataFrame:
    """``rows`` joined with ``per``, one row per group, by the group.  The
    ``LARGEST`` groups by the column ``size`` of ``per`` come by broadcast, so
    that no task gets a whole large group; the others meet in a shuffle."""
    top = per.filter(F.col(group).isNotNull()).orderBy(F.col(size).desc(), F.col(group)).limit(LARGEST)
    large = F.broadcast(top.select(group))
    near = rows.join(F.broadcast(top), group)
    rest = rows.join(large, group, "left_anti").join(per.join(large, group, "left_anti"), group)
    return near.unionByName(rest)


# --------------------------------------------------------------------------
# P8-P16
# --------------------------------------------------------------------------
def explode_parallel(df: DataFrame, keep: list[str], arrays: list[str]) -> DataFrame:
    """Explode equal-length array columns together; a row with empty
    arrays is kept once with NULLs (``explode_outer``)."""
    z = F.explode_outer(F.arrays_zip(*[F.col(a) for a in arrays])).alias("_z")
    return df.select(*keep, z).select(*keep, *[F.col("_z")[a].alias(a) for a in arrays])


def empty_to_null(col) -> Column:
    """P9: '' becomes NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(c, F.lit(""))


def invalidate_when(df: DataFrame, condition: Column, cols: list[str]) -> DataFrame:
    """NULL a group of columns where ``condition`` holds (the flag is
    computed once, before any column changes -- trap T4), then drop exact
    duplicates."""
    flagged = df.withColumn("_inv", condition)
    for c in cols:
        flagged = flagged.withColumn(c, F.when(F.col("_inv"), F.lit(None)).otherwise(F.col(c)))
    return flagged.drop("_inv").dropDuplicates()


def drop_like(df: DataFrame, fragment: str = None, suffix: str = None) -> DataFrame:
    """P13"""
    drop = [c for c in df.columns
            if (fragment and fragment in c) or (suffix and c.endswith(suffix))]
    return df.drop(*drop)


def concat_null_safe(*cols) -> Column:
    """P16"""
    return F.concat(*[F.coalesce(c, F.lit("")) for c in _cols(cols)])


# --------------------------------------------------------------------------
# joins J1-J4
# --------------------------------------------------------------------------
def complete_context(rel: DataFrame, posts: DataFrame, ctx_id: str, id_col: str,
                     fill: dict[str, str]) -> DataFrame:
    """Left join the post table on ``ctx_id = id`` and fill missing
    context fields (``combine_first`` = coalesce, P10)."""
    p = posts.select(F.col(id_col).alias("_cid"),
                     *[F.col(src).alias("_f_" + dst) for dst, src in fill.items()])
    out = rel.join(p, rel[ctx_id] == p["_cid"], "left")
    for dst in fill:
        out = out.withColumn(dst, F.coalesce(F.col(dst), F.col("_f_" + dst)))
    return out.drop("_cid", *["_f_" + d for d in fill])


# --------------------------------------------------------------------------
# aggregations A1-A15
# --------------------------------------------------------------------------
def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """A1: every copy of a duplicated key (``keep=False``) with its count."""
    counts = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_copies"))
                .filter("n_copies > 1"))
    return df.join(counts, keys, "inner")


def mismatch_patterns(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """A2: for each duplicated key, the columns whose values differ; then the
    distinct patterns with their key counts."""
    def differs(c):  # two values, or a value and a NULL: one pass, no copy of the rows per column
        null = F.col(c).isNull()
        return (F.coalesce(F.min(c) != F.max(c), F.lit(False)) | (F.bool_or(null) & F.bool_or(~null))).alias("_d_" + c)
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[differs(c) for c in cols])
    names = F.array_compact(F.array(*[F.when(F.col("_d_" + c), F.lit(c)) for c in cols]))
    return (per_key.filter("_n > 1")
                   .select(F.array_join(names, ",").alias("differing_columns"))
                   .groupBy("differing_columns").agg(F.count(F.lit(1)).alias("n_keys")))


def collapse_duplicates(df: DataFrame, keys: list[str], set_col: str,
                        union_col: str) -> DataFrame:
    """A3: group by all key columns (NULL keys kept), sorted set of
    ``set_col`` and sorted union of the array column ``union_col`` (A7).  One
    grouping over the exploded elements: they are made distinct per key before
    the shuffle and after it, so a buffer holds the result, not the copies."""
    rows = df.select(*keys, set_col, F.explode_outer(union_col).alias("_e"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(set_col)).alias(set_col),
                                   F.array_sort(F.collect_set("_e")).alias(union_col))


def union_of_arrays(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, sorted distinct elements of all arrays of the key)."""
    return (df.select(key, F.explode(col).alias("_e")).distinct()
              .groupBy(key).agg(F.array_sort(F.collect_list("_e")).alias(col)))


def ordered_concat(df: DataFrame, key: str, order: list[str], text: str,
                   sep: str = ". ", out: str = "context_text") -> DataFrame:
    """Texts of a group in (order...) order joined by ``sep``.

    ``collect_list`` order is undefined, so structs are collected and sorted.
    Rows are de-duplicated first, as in the reference.
    """
    fields = [F.col(c) for c in order] + [F.col(text).alias("_t")]
    return (df.dropDuplicates([key, *order, text])
              .filter(F.col(text).isNotNull())
              .groupBy(key)
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*fields))),
                                            lambda s: s["_t"]), sep).alias(out)))


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row per key by ``order`` (ascending).

    The order columns and a row hash are minimised per 64-bit key hash first
    (map-side, without the texts); the rows that can still win, about one per
    key, then give the first row per full key, so hash collisions are sorted
    out and full texts travel once per key, not once per copy.
    """
    rest = [c for c in df.columns if c not in key and c not in order]
    h = df.withColumn("_h", F.xxhash64(*key)).withColumn("_k", F.struct(*[F.col(c) for c in order]))
    low = h.groupBy("_h").agg(F.min("_k").alias("_low"), F.min(F.xxhash64(*key, F.lit(1))).alias("_a"),
                              F.max(F.xxhash64(*key, F.lit(1))).alias("_b"))
    # a hash with one key keeps only rows of the smallest order; others are compared in full
    near = h.join(low, "_h").filter((F.col("_k") == F.col("_low")) | (F.col("_a") != F.col("_b")))
    packed = F.min(F.struct(*[F.col(c) for c in order + rest])).alias("_first")
    return near.groupBy(*key).agg(packed).select(*key, *[F.col("_first")[c].alias(c) for c in order + rest])


def dense_ids(df: DataFrame, cols: list[str], out: str = "new_id",
              start: int = 0) -> DataFrame:
    """Dense id of each distinct value of ``cols`` in sorted order
    (``ngroup``), from ``start``.  NULL keys are dropped (pandas default)."""
    if len(cols) == 1 and dict(df.dtypes)[cols[0]] == "string":
        return _dense_text_ids(df, cols[0], out, start)
    distinct = df.select(*cols).dropna().dropDuplicates()
    numbered = global_positions(distinct, cols, "_pos")
    numbered = numbered.withColumn(out, F.col("_pos") - 1 + start).drop("_pos")
    return df.join(numbered, cols, "left")


#: Code points of a text by which it is ordered before its whole is looked at.
PREFIX = 48


def _dense_text_ids(df: DataFrame, col: str, out: str, start: int, prefix: int = PREFIX) -> DataFrame:
    """Dense ids of long texts through a two-level dictionary.  A text is known
    by its SHA-256 and ordered by its first code points; only texts that
    share these with another text are ordered by the whole.  So one copy of the
    rows is shuffled, with the digest they are joined on, and of the dictionary
    the short keys and the tied texts."""
    digest = F.unhex(F.sha2(F.col(col), 256))
    keyed = df.withColumn("_digest", digest)
    words = (df.where(F.col(col).isNotNull()).select(digest.alias("_digest"), F.substring(col, 1, prefix).alias("_prefix"))
             .dropDuplicates(["_digest"]))
    # a prefix that is shorter than the limit is the whole text, so it ties with longer ones only if it is as long
    tied = (words.where(F.length("_prefix") == prefix).groupBy("_prefix").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
            .select("_prefix"))
    whole = (df.select(F.substring(col, 1, prefix).alias("_prefix"), digest.alias("_digest"), F.col(col).alias("_whole"))
             .where(F.length("_prefix") == prefix).join(tied, "_prefix", "left_semi").dropDuplicates(["_digest"]).drop("_prefix"))
    ordered = words.join(whole, "_digest", "left").withColumn("_whole", F.coalesce("_whole", F.lit("")))
    numbered = global_positions(ordered, ["_prefix", "_whole", "_digest"], "_pos")
    ids = numbered.select("_digest", (F.col("_pos") - 1 + start).alias(out))
    return keyed.join(ids, "_digest", "left").drop("_digest")


def pseudonymise(df: DataFrame, id_col: str, name_col: str, prefix: str = "user",
                 out: str = "anonymised_user_id") -> DataFrame:
    """W2 + J4: ``prefix + ngroup(id, name)``, joined back on both columns,
    identifiers dropped."""
    ided = dense_ids(df, [id_col, name_col], "_uid")
    return ided.withColumn(out, F.concat(F.lit(prefix), F.col("_uid").cast("string"))) \
               .drop("_uid", id_col, name_col)


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NULL count per column, long form (column, n_null)."""
    cols = cols or df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "n_null")


def rows_with_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows that lack a value in any of the columns, and all rows."""
    lacks = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols or df.columns])
    return df.agg(F.count_if(lacks).alias("n_any_null"), F.count(F.lit(1)).alias("n_rows"))


def completion_rate(df: DataFrame, col: str) -> Column:
    """A13 as an aggregate expression: share of non-NULL values."""
    return F.try_divide(F.count_if(F.col(col).isNotNull()), F.count(F.lit(1)))


def set_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of only-A, only-B and both over distinct keys."""
    da = a.select(key).distinct().withColumn("_a", F.lit(1))
    db = b.select(key).distinct().withColumn("_b", F.lit(1))
    j = da.join(db, key, "full")
    return j.agg(F.count_if(F.col("_b").isNull()).alias("only_a"),
                 F.count_if(F.col("_a").isNull()).alias("only_b"),
                 F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"))


def length_histogram(df: DataFrame, length_col: str) -> DataFrame:
    """A9"""
    return df.groupBy(length_col).agg(F.count(F.lit(1)).alias("n_rows"))


def share_below(col: str, threshold) -> Column:
    """A10: percent of rows with ``col < threshold``."""
    return F.avg((F.col(col) < threshold).cast("double")) * 100


def summary_stats(df: DataFrame, col: str,
                  percentiles=(0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 0.9999)) -> DataFrame:
    """Mean, min, max, count and exact linear percentiles, long form
    (stat, value).  Percentiles come from distributed order statistics."""
    aggs = [F.avg(col).alias("mean"), F.min(col).cast("double").alias("min"),
            F.max(col).cast("double").alias("max"), F.count(col).cast("double").alias("count")]
    wide = df.agg(*aggs)
    basic = wide.unpivot([], wide.columns, "stat", "value")
    pct = exact_percentiles(df, col, percentiles).select(
        F.concat(F.lit("p"), F.regexp_replace(F.format_number(F.col("p") * 100, 2), r"\.?0+$", "")).alias("stat"),
        F.col(col).alias("value"))
    pct = pct.withColumn("stat", F.regexp_replace("stat", r"\.", "_"))
    return basic.unionByName(pct)


def union_all(dfs: list[DataFrame]) -> DataFrame:
    """U1"""
    return reduce(lambda x, y: x.unionByName(y), dfs)


# W12
def order_by_group_time(df: DataFrame, group: str, time: str, key: str) -> DataFrame:
    """Rows ordered by (group, time, key): range-partitioned on the group so
    every group is contiguous, then sorted inside each partition (no single
    sorted partition)."""
    return df.repartitionByRange(group).sortWithinPartitions(group, time, key)


# W13
def first_n(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows in ``order`` (a debug cap: TakeOrderedAndProject)."""
    return df.orderBy(*_cols(order)).limit(n)
