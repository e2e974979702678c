"""Tails, quantiles and the tests built on them against closed forms,
published examples and enumeration."""
import itertools
import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from convgraph.operators import stats as ST


def _values(spark, rows, names, **columns):
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{n} double" for n in names))
    return df.select(*names, *[c.alias(n) for n, c in columns.items()]).collect()


def test_erfc_is_exact_everywhere(spark):
    xs = [0, 1e-12, 1e-6, 0.0999999, 0.1, 0.3, 1, 2.5, 6.283, 6.284, 9, 20, 25.9, -0.05, -1, -7]
    for r in _values(spark, [(x,) for x in xs], "x", e=ST.erfc(F.col("x"))):
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-13)


def test_normal_quantile(spark):
    ps = [1e-15, 1e-9, 1e-4, 0.02, 0.3, 0.4999999, 0.5, 0.8, 0.999, 1 - 1e-9]
    for r in _values(spark, [(p,) for p in ps], "p", z=ST.normal_quantile(F.col("p"))):
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-8 if r.p > 0.9 else 1e-10)


def test_t_and_f_tails_where_they_are_closed(spark):
    def t_tail(t, d):
        if d == 1:
            return 1 - 2 / math.pi * math.atan(t)
        u = t / math.sqrt(d + t * t)
        return 1 - u if d == 2 else 1 - (1.5 * u - 0.5 * u ** 3)
    rows = [(s * t, d) for t in (0, 0.01, 0.7, 2, 15, 400) for d in (1, 2, 4) for s in (1, -1)]
    for r in _values(spark, rows, "td", p=ST.t_two_sided_p(F.col("t"), F.col("d"))):
        assert r.p == pytest.approx(t_tail(abs(r.t), r.d), abs=1e-13)
    rows = [(f, 2, d) for f in (0, 0.01, 1, 3.3, 40) for d in (1, 2, 3, 17, 1000, 10 ** 6)]
    for r in _values(spark, rows, "fab", p=ST.f_sf(F.col("f"), F.col("a"), F.col("b"))):
        assert r.p == pytest.approx((1 + 2 * r.f / r.b) ** (-r.b / 2), abs=1e-9)
    # many degrees of freedom: normal; a fractional number against its integral by brute force
    for r in _values(spark, [(1.959963984540054, 1e9)], "td", p=ST.t_two_sided_p(F.col("t"), F.col("d"))):
        assert r.p == pytest.approx(0.05, abs=1e-7)
    steps, df = 200_000, 2.37
    grid = [(k + 0.5) / steps * math.pi / 2 for k in range(steps)]
    dens = [math.cos(a) ** (df - 1) for a in grid]
    cut = math.atan(0.7 / math.sqrt(df))
    want = sum(d for a, d in zip(grid, dens) if a > cut) / sum(dens)
    for r in _values(spark, [(0.7, df)], "td", p=ST.t_two_sided_p(F.col("t"), F.col("d"))):
        assert r.p == pytest.approx(want, abs=1e-5)


def test_tails_of_nothing_are_null(spark):
    df = spark.sql("SELECT CAST(NULL AS DOUBLE) AS t, 3D AS d")
    assert df.select(ST.t_two_sided_p(F.col("t"), F.col("d"))).head()[0] is None
    assert df.select(ST.f_sf(F.col("t"), F.col("d"), F.col("d"))).head()[0] is None


def test_shapiro_wilk_published_and_library_values(spark):
    """The weights of 11 men (Shapiro and Wilk 1965: W = 0.79) and values that a
    statistics library gives for small samples."""
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    rows = [("men", float(x)) for x in men] + [("three", float(x)) for x in (1, 2, 4)] + [("same", 1.0)] * 5 \
        + [("two", 1.0), ("two", 2.0), ("none", None)] + [(None, float(x * x)) for x in range(30)]
    random.Random(1).shuffle(rows)
    got = {r.g: r for r in ST.shapiro_wilk(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert (round(got["men"].w, 2), round(got["men"].p_value, 4)) == (0.79, 0.0067)
    assert (round(got["three"].w, 4), round(got["three"].p_value, 4)) == (0.9643, 0.6369)
    assert (got["same"].w, got["same"].p_value) == (1.0, 1.0)
    assert got["two"].w is None and got["two"].p_value is None and "none" not in got and got[None].n == 30


@pytest.mark.parametrize("n", [5, 11, 200])
def test_shapiro_wilk_level(spark, n):
    """Of normal samples about one in twenty is rejected at 5 %, of larger exponential ones more."""
    rng = random.Random(n)
    samples = 300
    rows = [(f"n{k}", rng.gauss(3, 2)) for k in range(samples) for _ in range(n)] \
        + [(f"e{k}", rng.expovariate(1)) for k in range(samples) for _ in range(n)]
    got = ST.shapiro_wilk(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()
    share = {kind: sum(r.p_value < 0.05 for r in got if r.g[0] == kind) / samples for kind in "ne"}
    assert all(0 < r.w <= 1 for r in got) and 0.01 < share["n"] < 0.1 and (n < 11 or share["e"] > share["n"])


def test_exact_rank_law_equals_enumeration():
    for m, n in [(1, 1), (2, 3), (3, 3), (4, 6), (5, 5), (1, 9), (8, 4)]:
        us = [sum(c) - m * (m - 1) // 2 for c in itertools.combinations(range(m + n), m)]
        for u in range(m * n + 1):
            want = min(1, 2 * sum(x <= min(u, m * n - u) for x in us) / len(us))
            assert ST.exact_rank_sum_p(m, n, u) == pytest.approx(want, abs=1e-12)
            assert ST.exact_rank_sum_p(n, m, u) == pytest.approx(want, abs=1e-12)


def test_rank_test_picks_the_law(spark):
    def run(a, b):
        rows = [(True, float(x)) for x in a] + [(False, float(x)) for x in b]
        return ST.mann_whitney(spark.createDataFrame(rows, "f boolean, v double"), "f", "v").head()
    r = run([1, 2, 5], [3, 4, 6, 7])
    assert r.exact and r.u == 2 and r.p_value == pytest.approx(2 * 4 / 35)
    assert run(range(8), [x + 0.5 for x in range(100)]).exact
    assert not run(range(9), [x + 0.5 for x in range(9)]).exact
    assert not run([1, 2, 2], [3, 4, 6]).exact
    r = run([], [1, 2])
    assert not r.exact and r.p_value is None
