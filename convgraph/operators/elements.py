"""Element (hashtag / mention / emoji / topic) statistics.

Elements are array columns.  Frequencies are explode + hash aggregation
(map-side combined); the cumulative-share cut runs on the aggregated
vocabulary with the distributed running sum, never a one-partition window.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convgraph.operators.relations import global_running_sum


# A23
def frequencies(df: DataFrame, col: str, out: str = "element") -> DataFrame:
    return (df.select(F.explode(col).alias(out))
              .groupBy(out).agg(F.count(F.lit(1)).alias("frequency")))


# A24 + W5
def top_percentile(freq: DataFrame, element: str, percentile: float) -> DataFrame:
    """Elements, most frequent first (ties by element), while the cumulative
    share of all occurrences stays <= ``percentile``."""
    total = freq.agg(F.sum("frequency").alias("_tot"))
    cum = global_running_sum(freq, [F.col("frequency").desc(), F.col(element).asc()],
                             "frequency", "cumulative_frequency")
    cum = cum.crossJoin(F.broadcast(total)).withColumn(
        "cumulative_pct", F.col("cumulative_frequency") * 100.0 / F.col("_tot")).drop("_tot")
    return cum.filter(F.col("cumulative_pct") <= percentile)


# A25
def tfidf_by_label(df: DataFrame, col: str, long_labels: DataFrame, id_col: str = "id",
                   element: str = "element") -> DataFrame:
    """One document per label (all elements of the rows carrying it),
    tf = raw count, idf = ln((1 + n) / (1 + df)) + 1 (smoothed), each label
    vector L2-normalised.  Long form (label, element, tfidf), non-zero only."""
    toks = df.select(id_col, F.explode(col).alias(element))
    lab = long_labels.select(id_col, "label")
    tf = toks.join(lab, id_col).groupBy("label", element).agg(F.count(F.lit(1)).alias("tf"))
    n_docs = tf.select("label").distinct().agg(F.count(F.lit(1)).alias("_nd"))
    dfreq = tf.groupBy(element).agg(F.count(F.lit(1)).alias("_df"))
    w = (tf.join(dfreq, element).crossJoin(F.broadcast(n_docs))
           .withColumn("_w", F.col("tf") * (F.log((1 + F.col("_nd")) / (1 + F.col("_df"))) + 1)))
    norm = w.groupBy("label").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    # one row per label: bounded by the label set
    return w.join(F.broadcast(norm), "label").select("label", element, (F.col("_w") / F.col("_norm")).alias("tfidf"))


# A26
def element_label_matrix(df: DataFrame, col: str, long_labels: DataFrame, min_frequency: int,
                         id_col: str = "id", element: str = "element") -> DataFrame:
    """Absolute count of rows with label L containing element e, and the
    share of e's occurrences; elements with frequency >= ``min_frequency``."""
    toks = df.select(id_col, F.explode(col).alias(element))
    freq = toks.groupBy(element).agg(F.count(F.lit(1)).alias("frequency")) \
               .filter(F.col("frequency") >= min_frequency)
    ab = (toks.join(freq, element).join(long_labels.select(id_col, "label"), id_col)
              .groupBy(element, "label", "frequency").agg(F.count(F.lit(1)).alias("absolute")))
    return ab.select(element, "label", "absolute", (F.col("absolute") / F.col("frequency")).alias("relative"))


def element_label_tables(df: DataFrame, col: str, labels: list[str], element: str = "element") -> DataFrame:
    """One row per element, none left out: ``frequency``, and for each 0/1 label
    column ``abs_<label>``, its occurrences in rows that carry the label (0 where
    there are none), and ``rel_<label>``, their share.  One grouping, no join: the
    labels travel with the elements of their row.  NULL labels count as 0."""
    toks = df.select(F.explode(col).alias(element), *[F.coalesce(F.col(l), F.lit(0)).alias(l) for l in labels])
    sums = toks.groupBy(element).agg(F.count(F.lit(1)).alias("frequency"),
                                     *[F.count_if(F.col(l) == 1).alias("abs_" + l) for l in labels])
    return sums.select("*", *[(F.col("abs_" + l) / F.col("frequency")).alias("rel_" + l) for l in labels])


def element_label_report(tables: DataFrame, label: str, min_frequency: int, n: int, element: str = "element") -> DataFrame:
    """The ``n`` elements with the largest and the ``n`` with the smallest share
    of ``label`` (ties by element) among those seen at least ``min_frequency``
    times; an element that is both is one row.  A top-k report: two
    TakeOrderedAndProject."""
    rows = tables.filter(F.col("frequency") >= min_frequency)
    return extremes(rows, "rel_" + label, element, n).drop("end").dropDuplicates([element])


# A27
def select_by_frequency(freq: DataFrame, threshold: int, element: str = "element") -> DataFrame:
    """Elements seen more than ``threshold`` times, without those that hold a
    line break."""
    return freq.filter((F.col("frequency") > threshold) & ~F.contains(F.col(element), F.lit("\n")))


def share_above(freq: DataFrame, threshold: int) -> DataFrame:
    """Percent of the elements and of their occurrences above a cut."""
    hit = F.col("frequency") > threshold
    return freq.agg((F.avg(hit.cast("double")) * 100).alias("pct_elements"),
                    F.try_divide(F.sum(F.when(hit, F.col("frequency")).otherwise(0)) * 100.0, F.sum("frequency"))
                    .alias("pct_occurrences"))


# A29
def flag_columns(df: DataFrame, col: str, chosen: list[str], prefix: str | None = None) -> DataFrame:
    """One 0/1 column ``<prefix>_<element>`` per chosen element; every row is
    kept, a NULL array holds none of them.  ``chosen`` is the list that the
    selection file holds, a bounded report of the selection rule."""
    held = F.coalesce(F.col(col), F.array().cast("array<string>"))
    return df.select("*", *[F.array_contains(held, e).cast("int").alias(f"{prefix or col}_{e}") for e in chosen])


def membership_flags(df: DataFrame, col: str, chosen: DataFrame, element: str = "element",
                     id_col: str = "id") -> DataFrame:
    """Which chosen elements each row holds (long form, as the chosen list
    is data dependent).  ``chosen`` is bounded by the selection rule and is
    joined, never collected."""
    toks = df.select(id_col, F.explode(col).alias(element))
    return toks.join(chosen.select(element), element, "left_semi")


# W11
def extremes(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """``nlargest(n)`` and ``nsmallest(n)`` with an explicit tie key: two
    TakeOrderedAndProject top-k's."""
    top = df.orderBy(F.col(value).desc(), F.col(key).asc()).limit(n).withColumn("end", F.lit("top"))
    bottom = df.orderBy(F.col(value).asc(), F.col(key).asc()).limit(n).withColumn("end", F.lit("bottom"))
    return top.unionByName(bottom)
