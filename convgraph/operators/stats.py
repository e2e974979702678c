"""Statistical tests (I1-I10): aggregate in Spark, close the formula on the
tiny aggregated rows.

Spark SQL has neither ``erf`` nor ``gamma`` nor their inverses.  The tails are
native expressions that SQL can repeat:

* normal: a trapezoid sum for erfc with the term its poles add (relative error
  near 1e-15), a short Taylor sum near 0;
* normal quantile: a rough start and two Newton steps on that tail;
* Student t and F: the beta integral in the angle whose squared sine is its
  variable, where half-integer parameters leave no singularity, by the double
  exponential rule over the part where the integrand is not negligible; the same
  rule over the rest normalises it, so no gamma function is needed.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convgraph.operators.relations import exact_percentiles, global_positions, global_running_sum, join_per_group
from convgraph.session import cut_lineage, pickle_by_value, release

#: Step and terms of the trapezoid sum for erfc.
_STEP, _TERMS = 0.5, 13
#: Below this the Taylor sum is used.
_NEAR = 0.1


def erfc(x: Column) -> Column:
    """2 / sqrt(pi) times the integral of exp(-s^2) from x on."""
    z = F.abs(x)
    total = over(F.lit(1.0), z * z)
    for n in range(1, _TERMS + 1):
        q = (n * _STEP) ** 2
        total = total + 2.0 * math.exp(-q) / (z * z + q)
    tail = _STEP / math.pi * z * F.exp(-z * z) * total
    # the poles of the sum lie within the strip of the trapezoid rule up to here
    tail = tail + F.when(z < math.pi / _STEP, over(F.lit(2.0), 1.0 - F.exp(2.0 * math.pi / _STEP * z))).otherwise(0.0)
    near = 1.0 - 2.0 / math.sqrt(math.pi) * z * (1.0 + z * z * (-1.0 / 3 + z * z * (1.0 / 10 + z * z * (-1.0 / 42 + z * z / 216))))
    upper = F.when(z < _NEAR, near).when(z < 26.0, tail).otherwise(F.lit(0.0) * z)
    return F.when(x >= 0, upper).otherwise(2.0 - upper)


def erfc_sql(x: str) -> str:
    z = f"abs({x})"
    terms = " + ".join([f"1.0e0 / ({z} * {z})"] + [
        f"{2.0 * math.exp(-(n * _STEP) ** 2)!r}::DOUBLE / ({z} * {z} + {(n * _STEP) ** 2!r})" for n in range(1, _TERMS + 1)])
    tail = (f"({_STEP / math.pi!r}::DOUBLE * {z} * exp(-{z} * {z}) * ({terms}) "
            f"+ CASE WHEN {z} < {math.pi / _STEP!r} THEN 2.0e0 / (1.0e0 - exp({2.0 * math.pi / _STEP!r}::DOUBLE * {z})) ELSE 0 END)")
    near = (f"(1.0e0 - {2.0 / math.sqrt(math.pi)!r}::DOUBLE * {z} * (1.0e0 - {z} * {z} / 3.0e0 + {z} ** 4 / 10.0e0 "
            f"- {z} ** 6 / 42.0e0 + {z} ** 8 / 216.0e0))")
    upper = f"(CASE WHEN {z} < {_NEAR} THEN {near} WHEN {z} < 26 THEN {tail} ELSE 0.0e0 * {z} END)"
    return f"(CASE WHEN {x} >= 0 THEN {upper} ELSE 2.0e0 - {upper} END)"


def normal_sf(z: Column) -> Column:
    """P(Z > z)."""
    return 0.5 * erfc(z / math.sqrt(2.0))


def bonferroni(p: Column, m: Column) -> Column:
    return F.least(p * m, F.lit(1.0))


def over(a, b) -> Column:
    """a / b, NULL where b is 0 (a group without trials, constant values)."""
    return F.try_divide(a, b)


def pooled_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Pooled two-proportion z; NULL without trials or without variance."""
    pool = over(x1 + x2, n1 + n2)
    se = F.sqrt(pool * (1 - pool) * (over(F.lit(1.0), n1) + over(F.lit(1.0), n2)))
    return F.when(se > 0, over(over(x1, n1) - over(x2, n2), se))


# ---------------------------------------------------------------- I1 / I2 (+J14)
def proportion_pairs(props: DataFrame, group: str, successes: str, trials: str) -> DataFrame:
    """All unordered pairs of groups (J14, on the per-group table): pooled
    two-proportion z, chi2 = z^2 (2x2, no continuity correction), two-sided
    p, Bonferroni over the pairs."""
    a = props.select(F.col(group).alias("group_a"), F.col(successes).alias("_x1"), F.col(trials).alias("_n1"))
    b = props.select(F.col(group).alias("group_b"), F.col(successes).alias("_x2"), F.col(trials).alias("_n2"))
    # the per-group table has one row per group; the pair table is |groups|^2 / 2
    pairs = a.join(b, F.col("group_a") < F.col("group_b"))
    z = pooled_z(F.col("_x1"), F.col("_n1"), F.col("_x2"), F.col("_n2"))
    out = pairs.select("group_a", "group_b", z.alias("z"))
    m = F.count(F.lit(1)).over(Window.partitionBy())
    out = out.select("group_a", "group_b", "z", (F.col("z") * F.col("z")).alias("chi2"),
                     erfc(F.abs(F.col("z")) / math.sqrt(2.0)).alias("p_value"), m.alias("_m"))
    return out.select("group_a", "group_b", "z", "chi2", "p_value",
                      bonferroni(F.col("p_value"), F.col("_m")).alias("p_adjusted")) \
              .withColumn("reject", F.col("p_adjusted") < 0.05)


# ---------------------------------------------------------------- I3
def proportion_vs_half(props: DataFrame, group: str, successes: str, trials: str,
                       value: float = 0.5) -> DataFrame:
    """One-sample z per group, H1: p > value, variance from the sample
    proportion; Bonferroni over the groups."""
    p = over(F.col(successes), F.col(trials))
    se = F.sqrt(over(p * (1 - p), F.col(trials)))
    z = F.when(se > 0, over(p - value, se))
    m = F.count(F.lit(1)).over(Window.partitionBy())
    out = props.select(F.col(group).alias("group"), z.alias("z"), m.alias("_m"))
    out = out.withColumn("p_value", normal_sf(F.col("z")))
    return out.select("group", "z", "p_value", bonferroni(F.col("p_value"), F.col("_m")).alias("p_adjusted")) \
              .withColumn("rejected", F.col("p_adjusted") < 0.05)


# ---------------------------------------------------------------- I4
def two_sample_larger(x1: Column, n1: Column, x2: Column, n2: Column) -> tuple[Column, Column]:
    z = pooled_z(x1, n1, x2, n2)
    return z, normal_sf(z)


# ---------------------------------------------------------------- moments
def group_moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, sample variance, central moments m2..m4 per group (two
    passes: mean first, then centred powers, for stable sums)."""
    mean = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    c = join_per_group(df, mean, group, "n").withColumn("_d", F.col(value) - F.col("mean"))
    m = c.groupBy(group, "n", "mean").agg((F.sum(F.col("_d") ** 2)).alias("_s2"),
                                          (F.sum(F.col("_d") ** 3)).alias("_s3"),
                                          (F.sum(F.col("_d") ** 4)).alias("_s4"))
    return m.select(group, "n", "mean", over(F.col("_s2"), F.col("n") - 1).alias("var"),
                    (F.col("_s2") / F.col("n")).alias("m2"), (F.col("_s3") / F.col("n")).alias("m3"),
                    (F.col("_s4") / F.col("n")).alias("m4"))


# normality by moments
def jarque_bera(moments: DataFrame) -> DataFrame:
    """NULL statistics where all values are equal."""
    s = over(F.col("m3"), F.pow(F.col("m2"), 1.5))
    k = over(F.col("m4"), F.col("m2") * F.col("m2")) - 3
    jb = F.col("n") / 6.0 * (s * s + k * k / 4.0)
    return moments.select("*", s.alias("skew"), k.alias("kurt"), jb.alias("jb"),
                          F.exp(-jb / 2.0).alias("jb_p"))


# I7
def levene(df: DataFrame, group: str, value: str) -> DataFrame:
    """Brown-Forsythe (median-centred) Levene W with its F degrees of
    freedom; W is NULL for one group or where all distances are equal.  The
    exact median comes from distributed order statistics."""
    meds = exact_percentiles(df, value, [0.5], group).select(group, F.col(value).alias("_med"))
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"))
    z = join_per_group(df, cut_lineage(meds.join(sizes, group)), group, "_rows") \
        .select(group, F.abs(F.col(value) - F.col("_med")).alias("_z"))
    zi = z.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.avg("_z").alias("_zi"))
    zall = z.agg(F.avg("_z").alias("_zbar"), F.count(F.lit(1)).alias("_total"))
    within = join_per_group(z, zi, group, "_n").agg(F.sum((F.col("_z") - F.col("_zi")) ** 2).alias("_w"))
    between = zi.crossJoin(zall).agg(F.sum(F.col("_n") * (F.col("_zi") - F.col("_zbar")) ** 2).alias("_b"),
                                     F.count(F.lit(1)).alias("_k"), F.first("_total").alias("_total"))
    r = between.crossJoin(within)
    w = over(over(F.col("_total") - F.col("_k"), F.col("_k") - 1) * F.col("_b"), F.col("_w"))
    return r.select(w.alias("w"), (F.col("_k") - 1).cast("double").alias("df1"),
                    (F.col("_total") - F.col("_k")).cast("double").alias("df2"))


# I8
def t_tests(m1: dict, m2: dict) -> dict:
    """Column expressions for Student and Welch t from two moment rows
    (dicts of Columns n, mean, var)."""
    n1, n2, v1, v2 = m1["n"], m2["n"], m1["var"], m2["var"]
    diff = m1["mean"] - m2["mean"]
    sp2 = over((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2)
    t_student = over(diff, F.sqrt(sp2 * (over(F.lit(1.0), n1) + over(F.lit(1.0), n2))))
    a, b = over(v1, n1), over(v2, n2)
    t_welch = over(diff, F.sqrt(a + b))
    df_welch = over((a + b) ** 2, over(a * a, n1 - 1) + over(b * b, n2 - 1))
    return {"t_student": t_student, "df_student": (n1 + n2 - 2).cast("double"),
            "t_welch": t_welch, "df_welch": df_welch}


# I9
def mann_whitney(df: DataFrame, flag: str, value: str) -> DataFrame:
    """Mann-Whitney U with mid-ranks, two-sided: the exact law where one sample
    has at most EXACT_SAMPLE values and none tie, else the tie-corrected normal
    approximation with continuity correction.  Ranks come from a value
    histogram and a distributed running count: no global sort of the rows."""
    hist = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c"),
                                 F.count_if(F.col(flag)).alias("_c1"))
    cum = global_running_sum(hist, [F.col(value).asc()], "_c", "_cum")
    midrank = F.col("_cum") - F.col("_c") + (F.col("_c") + 1) / 2.0
    agg = cum.agg(F.sum(F.col("_c1") * midrank).alias("r1"), F.sum("_c1").alias("n1"),
                  F.sum("_c").alias("n"), F.sum(F.col("_c").cast("double") ** 3 - F.col("_c")).alias("_ties"))
    n1, n = F.col("n1").cast("double"), F.col("n").cast("double")
    n2 = n - n1
    u1 = F.col("r1") - n1 * (n1 + 1) / 2.0
    u2 = n1 * n2 - u1
    mu = n1 * n2 / 2.0
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - over(F.col("_ties"), n * (n - 1))))
    z = over(F.greatest(u1, u2) - mu - 0.5, sigma)
    exact = (F.col("_ties") == 0) & (F.least(n1, n2) <= EXACT_SAMPLE) & (F.least(n1, n2) > 0)
    out = agg.select(F.col("n1").cast("long").alias("n1"), n2.cast("long").alias("n2"), u1.alias("u"),
                     z.alias("z"), F.when(z.isNotNull(), F.least(2.0 * normal_sf(z), F.lit(1.0))).alias("_normal"), exact.alias("exact"))
    return out.withColumn("p_value", F.coalesce(_exact_p("n1", "n2", "u", "exact"), "_normal")).drop("_normal")


# ---------------------------------------------------------------- t / F tails
#: Nodes of the double exponential rule: every 1 / 32 from -3.5 to 3.5.
_NODES = [k / 32.0 for k in range(-112, 113)]
#: Half width of the part of the beta integral that counts, in units of
#: 1 / sqrt(sum of its exponents).
_WIDTH = 14.0


def _beta_part(lo: Column, hi: Column, p: Column, q: Column, top: Column) -> Column:
    """Integral of sin^p cos^q from lo to hi, divided by exp(top)."""
    rule = F.lit([math.pi / 2 * math.sinh(s) for s in _NODES])
    half, middle = (hi - lo) / 2.0, (hi + lo) / 2.0

    def term(acc, u):
        at = middle + half * F.tanh(u)
        # sinh(s) = 2 u / pi, so cosh(s) = sqrt(1 + (2 u / pi)^2)
        weight = F.sqrt(1.0 + F.pow(2.0 / math.pi * u, 2)) / F.pow(F.cosh(u), 2)
        # a power of 0 is 1, also at the end where the logarithm is not finite
        log = F.when(p > 0, p * F.log(F.sin(at))).otherwise(0.0) + F.when(q > 0, q * F.log(F.cos(at))).otherwise(0.0)
        return acc + F.coalesce(weight * F.exp(log - top), F.lit(0.0))
    return half * (math.pi / 2 / 32.0) * F.aggregate(rule, F.lit(0.0), term)


def beta_share(angle: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta I_x(a, b) for a, b >= 1/2 at x = sin(angle)^2."""
    p, q = 2.0 * a - 1.0, 2.0 * b - 1.0
    total = F.greatest(p + q, F.lit(1e-9))
    mode = F.atan2(F.sqrt(F.greatest(p, F.lit(0.0))), F.sqrt(F.greatest(q, F.lit(0.0))))
    width = _WIDTH / F.sqrt(total)
    lo, hi = F.greatest(mode - width, F.lit(0.0)), F.least(mode + width, F.lit(math.pi / 2))
    cut = F.least(F.greatest(angle, lo), hi)
    top = (F.when(p > 0, p * F.log(F.sin(mode))).otherwise(0.0) + F.when(q > 0, q * F.log(F.cos(mode))).otherwise(0.0))
    below, above = _beta_part(lo, cut, p, q, top), _beta_part(cut, hi, p, q, top)
    return F.when(angle.isNotNull(), over(below, below + above))


def f_sf(f: Column, d1: Column, d2: Column) -> Column:
    """P(F > f) with d1 and d2 degrees of freedom."""
    return F.when(f < 0, F.lit(1.0)).otherwise(beta_share(F.atan2(F.sqrt(d2), F.sqrt(d1 * f)), d2 / 2.0, d1 / 2.0))


def t_two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| > |t|)."""
    return beta_share(F.atan2(F.sqrt(df), F.abs(t)), df / 2.0, F.lit(0.5))


def beta_share_sql(angle: str, a: str, b: str) -> str:
    """The same as a scalar subquery of DuckDB (one row of list sums)."""
    def part(lo, hi):
        at = f"(({hi} + {lo}) / 2 + ({hi} - {lo}) / 2 * tanh(u))"
        log = (f"(CASE WHEN p > 0 THEN p * ln(greatest(sin({at}), 1e-300)) ELSE 0 END "
               f"+ CASE WHEN q > 0 THEN q * ln(greatest(cos({at}), 1e-300)) ELSE 0 END)")
        return (f"(({hi} - {lo}) / 2 * list_sum(list_transform(nodes, lambda u: sqrt(1 + pow({2.0 / math.pi!r} * u, 2)) "
                f"/ pow(cosh(u), 2) * exp({log} - top))))")
    return f"""(SELECT below / (below + above) FROM (SELECT {part("lo", "cut")} AS below, {part("cut", "hi")} AS above FROM (
      SELECT *, least(greatest(angle, lo), hi) AS cut,
             (CASE WHEN p > 0 THEN p * ln(sin(mode)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(cos(mode)) ELSE 0 END) AS top,
             list_transform(range(-112, 113), lambda k: {math.pi / 2!r} * sinh(k / 32.0e0)) AS nodes FROM (
        SELECT *, greatest(mode - {_WIDTH} / sqrt(greatest(p + q, 1e-9)), 0) AS lo,
               least(mode + {_WIDTH} / sqrt(greatest(p + q, 1e-9)), {math.pi / 2!r}) AS hi FROM (
          SELECT angle, p, q, atan2(sqrt(greatest(p, 0)), sqrt(greatest(q, 0))) AS mode FROM (
            SELECT ({angle})::DOUBLE AS angle, 2.0e0 * ({a}) - 1 AS p, 2.0e0 * ({b}) - 1 AS q))))))"""


# ---------------------------------------------------------------- normal quantile
#: The rational start of the normal quantile (Hastings).
_START = ((2.515517, 0.802853, 0.010328), (1.432788, 0.189269, 0.001308))


def normal_quantile(p: Column) -> Column:
    """z with P(Z <= z) = p, for 0 < p < 1."""
    small = F.least(p, 1.0 - p)
    t = F.sqrt(-2.0 * F.log(small))
    (a0, a1, a2), (b1, b2, b3) = _START
    z = t - (a0 + a1 * t + a2 * t * t) / (1.0 + b1 * t + b2 * t * t + b3 * t * t * t)
    out = F.transform(F.array(z), lambda x: _newton(x, small))
    out = F.transform(out, lambda x: _newton(x, small))[0]
    return F.when(p < 0.5, -out).when(p > 0.5, out).otherwise(F.lit(0.0))


def _newton(z: Column, upper: Column) -> Column:
    """One step towards P(Z > z) = upper."""
    return z + (normal_sf(z) - upper) * math.sqrt(2.0 * math.pi) * F.exp(z * z / 2.0)


# ---------------------------------------------------------------- I6
#: Royston's polynomials (algorithm AS R94), highest power first.
_W_LAST = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0)
_W_NEXT = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0)
_W_GAMMA = (0.459, -2.273)
_W_MU_SMALL = (-0.0006714, 0.025054, -0.39978, 0.5440)
_W_SIGMA_SMALL = (-0.0020322, 0.062767, -0.77857, 1.3822)
_W_MU = (0.0038915, -0.083751, -0.31082, -1.5861)
_W_SIGMA = (0.0030302, -0.082676, -0.4803)


def _poly(coefficients, x: Column) -> Column:
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + c
    return out


def shapiro_wilk(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, w, p_value): order statistics times weights from expected
    normal scores.  Values are ranked by a range partitioning over all groups;
    what a group needs beyond its moments (its two largest and two smallest
    scores and the sum of squares of all) comes with one aggregation, so no
    group meets in one task.  NULL for fewer than three values, 1 where all are
    equal; null values do not count."""
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    moments = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    # the groups before a group, as their number of rows: one row per group
    sizes = global_running_sum(moments.select("g", "n"), [F.col("g").asc_nulls_first()], "n", "upto")
    bounds = moments.join(sizes.select(F.col("g").alias("h"), "upto"), F.col("g").eqNullSafe(F.col("h"))).drop("h")
    # equal values share their places among them, so a draw may break ties
    ranked = global_positions(rows.withColumn("_draw", F.rand(17)), [F.col("g").asc_nulls_first(), "v", "_draw"], "pos")
    scored = (ranked.join(bounds, ranked["g"].eqNullSafe(bounds["g"])).select(ranked["g"], "v", "n", "mean",
              (F.col("pos") - F.col("upto") + F.col("n")).alias("i"))
              .withColumn("m", normal_quantile((F.col("i") - 0.375) / (F.col("n") + 0.25))))
    d = F.col("v") - F.col("mean")
    from_end = F.col("n") - F.col("i")
    ends = [F.sum(F.when((F.col("i") - 1 == k) | (from_end == k), d * F.signum("m"))).alias(f"x{k}") for k in (0, 1)]
    tops = [F.max(F.when(from_end == k, F.col("m"))).alias(f"m{k}") for k in (0, 1)]
    inner = (F.col("i") > 2) & (from_end > 1)
    sums = scored.groupBy("g", "n").agg(F.sum(F.col("m") ** 2).alias("mm"), F.sum(d * d).alias("ss"),
                                        F.coalesce(F.sum(F.when(inner, F.col("m") * d)), F.lit(0.0)).alias("inner"), *ends, *tops)
    n, u = F.col("n").cast("double"), 1.0 / F.sqrt(F.col("n").cast("double"))
    mm, m0, m1 = F.col("mm"), F.col("m0"), F.col("m1")
    few = F.col("n") <= 5
    sums = sums.withColumn("a0", F.when(F.col("n") == 3, F.lit(math.sqrt(0.5))).otherwise(_poly(_W_LAST, u) + m0 / F.sqrt(mm)))
    sums = sums.withColumn("a1", F.when(~few, _poly(_W_NEXT, u) + m1 / F.sqrt(mm)))
    a0, a1 = F.col("a0"), F.col("a1")
    eps = F.when(few, over(mm - 2.0 * m0 * m0, 1.0 - 2.0 * a0 * a0)).otherwise(
        over(mm - 2.0 * m0 * m0 - 2.0 * m1 * m1, 1.0 - 2.0 * a0 * a0 - 2.0 * a1 * a1))
    # of up to five values the second smallest and largest are inner ones too
    second = F.when(F.col("n") <= 3, F.lit(0.0)).when(few, m1 / F.sqrt(eps) * F.col("x1")).otherwise(a1 * F.col("x1"))
    b = a0 * F.col("x0") + second + F.when(F.col("n") <= 4, F.lit(0.0)).otherwise(F.col("inner") / F.sqrt(eps))
    sums = sums.withColumn("w", F.when(F.col("n") >= 3, F.least(over(b * b, F.col("ss")), F.lit(1.0))))
    w, ln = F.col("w"), F.log(n)
    gamma = _poly(_W_GAMMA, n)
    three = F.greatest(6.0 / math.pi * (F.asin(F.sqrt(w)) - math.asin(math.sqrt(0.75))), F.lit(0.0))
    small = (-F.log(gamma - F.log(1.0 - w)) - _poly(_W_MU_SMALL, n)) / F.exp(_poly(_W_SIGMA_SMALL, n))
    large = (F.log(1.0 - w) - _poly(_W_MU, ln)) / F.exp(_poly(_W_SIGMA, ln))
    sums = sums.select("g", "n", "w", three.alias("three"), F.when(F.col("n") <= 11, small).otherwise(large).alias("z"),
                       ((F.col("n") > 3) & (F.col("n") <= 11) & (F.log(1.0 - w) >= gamma)).alias("none"))
    p = (F.when(w >= 1.0, F.lit(1.0)).when(F.col("n") == 3, F.col("three")).when(F.col("none"), F.lit(1e-99))
         .otherwise(normal_sf(F.col("z"))))
    return sums.select(F.col("g").alias(group), "n", "w", F.when(w.isNotNull(), p).alias("p_value"))


# ---------------------------------------------------------------- I9, small samples
#: The exact law is used where a sample is not larger than this and no values tie.
EXACT_SAMPLE = 8


def exact_rank_sum_p(n1: int, n2: int, u: float) -> float:
    """Two-sided p of U = max(u, n1 n2 - u) without ties: the numbers of
    arrangements by their U are the coefficients of the product of
    (1 - q^(n + i)) / (1 - q^i), i from 1 to the smaller size."""
    m, n = sorted((int(n1), int(n2)))
    least = int(round(min(u, n1 * n2 - u)))
    ways = np.zeros(least + 1)
    ways[0] = 1.0
    for i in range(1, m + 1):
        if n + i <= least:
            ways[n + i:] = ways[n + i:] - ways[:least + 1 - n - i]
        pad = -len(ways) % i
        ways = np.cumsum(np.append(ways, np.zeros(pad)).reshape(-1, i), axis=0).ravel()[:least + 1]
    return min(2.0 * float(ways.sum()) / math.comb(n + m, m), 1.0)


@F.pandas_udf(T.DoubleType())
def _exact_p(n1: pd.Series, n2: pd.Series, u: pd.Series, wanted: pd.Series) -> pd.Series:
    # one row per test
    return pd.Series([exact_rank_sum_p(a, b, c) if w else None for a, b, c, w in zip(n1, n2, u, wanted)], dtype="float64")


# --- fixed values: names of the tests and texts of the conclusions --------
TEST_STUDENT = "t-test"
TEST_WELCH = "Welch's t-test"
TEST_RANKS = "Mann-Whitney U test"
CONCLUSION_DIFFERENT = "reject, we can assume a difference"
CONCLUSION_EQUAL = "no reject, we can assume the means are equal"
# --------------------------------------------------------------------------


# I10
def compare_means(df: DataFrame, flag: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Decision tree over two samples: Shapiro-Wilk on each and Levene on both
    choose between Student's t, Welch's t and Mann-Whitney U.  Rows without flag
    or value do not count."""
    # two columns, read by four jobs
    g = cut_lineage(df.select(F.col(flag).cast("boolean").alias("_g"), F.col(value).alias("_v")).dropna())
    mom = group_moments(g, "_g", "_v").join(
        shapiro_wilk(g, "_g", "_v").select("_g", F.col("p_value").alias("normal_p")), "_g")
    kept = ["n", "mean", "var", "normal_p"]
    one = mom.filter(F.col("_g")).select(*[F.col(c).alias(c + "_1") for c in kept])
    zero = mom.filter(~F.col("_g")).select(*[F.col(c).alias(c + "_2") for c in kept])
    lev = levene(g, "_g", "_v")
    mw = mann_whitney(g, "_g", "_v").select(F.col("p_value").alias("mw_p"), F.col("exact").alias("mw_exact"))
    # one row each
    row = one.crossJoin(zero).crossJoin(lev).crossJoin(mw)
    tt = t_tests({"n": F.col("n_1"), "mean": F.col("mean_1"), "var": F.col("var_1")},
                 {"n": F.col("n_2"), "mean": F.col("mean_2"), "var": F.col("var_2")})
    # one row, written so that the tails below see plain columns
    row = cut_lineage(row.select("*", *[v.alias(k) for k, v in tt.items()]))
    release(g)
    row = row.withColumn("levene_p", f_sf(F.col("w"), F.col("df1"), F.col("df2"))) \
             .withColumn("student_p", t_two_sided_p(F.col("t_student"), F.col("df_student"))) \
             .withColumn("welch_p", t_two_sided_p(F.col("t_welch"), F.col("df_welch")))
    # a test without a p (too few values, all equal) is not passed
    normal = F.coalesce((F.col("normal_p_1") > alpha) & (F.col("normal_p_2") > alpha), F.lit(False))
    homo = F.coalesce(F.col("levene_p") > alpha, F.lit(False))
    test = F.when(normal & homo, F.lit(TEST_STUDENT)).when(normal, F.lit(TEST_WELCH)).otherwise(F.lit(TEST_RANKS))
    p = F.when(normal & homo, F.col("student_p")).when(normal, F.col("welch_p")).otherwise(F.col("mw_p"))
    concl = F.when(p < alpha, F.lit(CONCLUSION_DIFFERENT)).otherwise(F.lit(CONCLUSION_EQUAL))
    return row.select(normal.alias("normality_pass"), homo.alias("homoscedasticity_pass"),
                      test.alias("test"), p.alias("p_value"), concl.alias("conclusion"),
                      F.col("n_1").alias("n1"), F.col("n_2").alias("n2"),
                      F.col("normal_p_1").alias("normal_p1"), F.col("normal_p_2").alias("normal_p2"), "levene_p", "mw_exact")


pickle_by_value(__name__)
