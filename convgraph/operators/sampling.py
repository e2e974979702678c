"""Sampling and splitting by group (H1-H5).

Seeded generators cannot be reproduced across engines or re-executions, so
every draw is a rank by ``md5(seed:group)``: deterministic under task retry
and executor loss, and checkable in SQL.  Groups are ranked with the
distributed global ranking (no one-partition window), and rows are joined
back to the chosen groups, so whole groups always stay together.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convgraph.operators.relations import global_positions


def hash_rank_key(col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(col).cast("string")))


def ranked_groups(df: DataFrame, group: str, seed: int) -> DataFrame:
    g = df.select(group).distinct().withColumn("_h", hash_rank_key(group, seed))
    return global_positions(g, [F.col("_h"), F.col(group)], "_rank").drop("_h")


# H1
def cluster_sample(df: DataFrame, group: str, target_rows: int, seed: int = 42) -> DataFrame:
    """Whole groups, k = floor(target_rows / mean group size), without
    replacement.  Returns the rows of the chosen groups."""
    stats = df.agg(F.count(F.lit(1)).alias("_rows"), F.count_distinct(group).alias("_groups"))
    k = F.floor(F.lit(float(target_rows)) / (F.col("_rows") / F.col("_groups")))
    ranked = ranked_groups(df, group, seed).crossJoin(F.broadcast(stats.select(k.alias("_k"))))
    chosen = ranked.filter(F.col("_rank") <= F.col("_k")).select(group)
    return df.join(chosen, group, "left_semi")


# H2
def split_by_groups(df: DataFrame, group: str, train: float = 0.6, val: float = 0.2,
                    seed: int = 42, out: str = "split") -> DataFrame:
    """train / val / test by group: ceil(test * n) groups go to test, then
    ceil(val / (train + val) * rest) to val, the rest to train.  No group
    crosses a split."""
    test = 1 - train - val
    ranked = ranked_groups(df, group, seed)
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))
    n_test = F.ceil(F.lit(test) * F.col("_n"))
    n_val = F.ceil(F.lit(val / (train + val)) * (F.col("_n") - n_test))
    cuts = n.select(n_test.alias("_t"), n_val.alias("_v"))
    lab = (ranked.crossJoin(F.broadcast(cuts))
                 .select(group, F.when(F.col("_rank") <= F.col("_t"), F.lit("test"))
                              .when(F.col("_rank") <= F.col("_t") + F.col("_v"), F.lit("val"))
                              .otherwise(F.lit("train")).alias(out)))
    return df.join(lab, group)


def test_share_literal(train: float = 0.6, val: float = 0.2) -> str:
    """The float the split uses for the test share, for SQL oracles."""
    return repr(1 - train - val)


# H3
def split_shares(df: DataFrame, split: str = "split") -> DataFrame:
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    return (df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"))
              .crossJoin(F.broadcast(n)).withColumn("share", F.col("n_rows") / F.col("_n")).drop("_n"))


# H4
def debug_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


# H5
def seeded_runs(spark, base_seed: int, n_runs: int) -> DataFrame:
    """Parameter table of repeated runs: (run, seed = base + run)."""
    return spark.range(1, n_runs + 1).select(F.col("id").alias("run"),
                                             (F.col("id") + base_seed).alias("seed"))


def ceil_int(x: float) -> int:
    return int(math.ceil(x))
