"""Registered queries: significance tests over aggregated tables."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from convgraph.operators import stats as ST
from convgraph.plans import standins as S
from convgraph.plans.q_labels import _REPLY_SQL, _e3_edges, _e3_labels
from convgraph.operators import labels as L
from convgraph.plans.registry import query, r6

_SQ2 = math.sqrt(2.0)


def _props(spark, sf):
    return L.flagged_reply_share(_e3_edges(spark, sf), _e3_labels(spark, sf), S.E3_NONE_LABEL)


_PAIRS_SQL = _REPLY_SQL + """
, pr AS (SELECT a.source_label AS group_a, b.source_label AS group_b, a.successes AS x1, a.trials AS n1,
                b.successes AS x2, b.trials AS n2 FROM g a JOIN g b ON a.source_label < b.source_label),
zz AS (SELECT group_a, group_b,
         CASE WHEN sqrt(((x1 + x2) / (n1 + n2)) * (1 - (x1 + x2) / (n1 + n2)) * (1.0 / n1 + 1.0 / n2)) > 0
              THEN (x1 / n1 - x2 / n2) / sqrt(((x1 + x2) / (n1 + n2)) * (1 - (x1 + x2) / (n1 + n2)) * (1.0 / n1 + 1.0 / n2))
         END AS z FROM pr),
pv AS (SELECT group_a, group_b, z, z * z AS chi2, """ + ST.erfc_sql(f"(abs(z) / {_SQ2})") + """ AS p_value,
         count(*) OVER () AS m FROM zz)
"""


# ---------------------------------------------------------------- I1
@query("chi2_allpairs", _PAIRS_SQL + """
SELECT group_a, group_b, round(chi2, 6) AS chi2, round(p_value, 6) AS p_value,
       round(least(p_value * m, 1.0), 6) AS p_adjusted, least(p_value * m, 1.0) < 0.05 AS reject FROM pv
""")
def chi2_allpairs(spark, sf):
    t = ST.proportion_pairs(_props(spark, sf), "source_label", "successes", "trials")
    return t.select("group_a", "group_b", r6(F.col("chi2")).alias("chi2"), r6(F.col("p_value")).alias("p_value"),
                    r6(F.col("p_adjusted")).alias("p_adjusted"), "reject")


# ---------------------------------------------------------------- I2
@query("z_allpairs", _PAIRS_SQL + """
SELECT group_a, group_b, round(z, 6) AS z, round(p_value, 6) AS p_value,
       round(least(p_value * m, 1.0), 6) AS p_adjusted, least(p_value * m, 1.0) < 0.05 AS reject FROM pv
""")
def z_allpairs(spark, sf):
    t = ST.proportion_pairs(_props(spark, sf), "source_label", "successes", "trials")
    return t.select("group_a", "group_b", r6(F.col("z")).alias("z"), r6(F.col("p_value")).alias("p_value"),
                    r6(F.col("p_adjusted")).alias("p_adjusted"), "reject")


# ---------------------------------------------------------------- I3
@query("z_one_sample", _REPLY_SQL + """
, zz AS (SELECT source_label AS "group",
           CASE WHEN sqrt((successes / trials) * (1 - successes / trials) / trials) > 0
                THEN (successes / trials - 0.5) / sqrt((successes / trials) * (1 - successes / trials) / trials) END AS z,
           count(*) OVER () AS m FROM g),
pv AS (SELECT "group", z, 0.5 * """ + ST.erfc_sql(f"(z / {_SQ2})") + """ AS p_value, m FROM zz)
SELECT "group", round(z, 6) AS z, round(p_value, 6) AS p_value, round(least(p_value * m, 1.0), 6) AS p_adjusted,
       least(p_value * m, 1.0) < 0.05 AS rejected FROM pv
""")
def z_one_sample(spark, sf):
    t = ST.proportion_vs_half(_props(spark, sf), "source_label", "successes", "trials")
    return t.select("group", r6(F.col("z")).alias("z"), r6(F.col("p_value")).alias("p_value"),
                    r6(F.col("p_adjusted")).alias("p_adjusted"), "rejected")


# ---------------------------------------------------------------- I4 (+A21 on a binary labelling)
def _flag_crosstab(spark, sf):
    lab = _e3_labels(spark, sf)
    node = lab.groupBy("id").agg(F.max((F.col("label") != S.E3_NONE_LABEL).cast("int")).alias("flagged"))
    e = _e3_edges(spark, sf).select("src", "dst")
    j = e.join(node.toDF("src", "fs"), "src").join(node.toDF("dst", "fd"), "dst")
    return j.agg(F.sum(F.when(F.col("fs") == 1, F.col("fd"))).alias("x1"),
                 F.count_if(F.col("fs") == 1).alias("n1"),
                 F.sum(F.when(F.col("fs") == 0, F.col("fd"))).alias("x2"),
                 F.count_if(F.col("fs") == 0).alias("n2"))


@query("z_two_sample", f"""
WITH e AS ({S.E3_EDGES_SQL}),
l AS (SELECT event_id AS id, event_type AS label FROM events UNION ALL SELECT event_id, 'high_value' FROM events WHERE value >= 100),
nd AS (SELECT id, max(CAST(label <> '{S.E3_NONE_LABEL}' AS INTEGER)) AS f FROM l GROUP BY id),
j AS (SELECT a.f AS fs, b.f AS fd FROM e JOIN nd a ON e.src = a.id JOIN nd b ON e.dst = b.id),
c AS (SELECT CAST(sum(fd) FILTER (WHERE fs = 1) AS BIGINT) AS x1, count(*) FILTER (WHERE fs = 1) AS n1,
             CAST(sum(fd) FILTER (WHERE fs = 0) AS BIGINT) AS x2, count(*) FILTER (WHERE fs = 0) AS n2 FROM j),
zz AS (SELECT *, (x1 / n1 - x2 / n2) / sqrt(((x1 + x2) / (n1 + n2)) * (1 - (x1 + x2) / (n1 + n2)) * (1.0 / n1 + 1.0 / n2)) AS z FROM c)
SELECT x1, n1, x2, n2, round(z, 6) AS z, round(0.5 * {ST.erfc_sql(f"(z / {_SQ2})")}, 6) AS p_value FROM zz
""")
def z_two_sample(spark, sf):
    c = _flag_crosstab(spark, sf)
    z, p = ST.two_sample_larger(F.col("x1"), F.col("n1"), F.col("x2"), F.col("n2"))
    return c.select(F.col("x1").cast("long").alias("x1"), "n1", F.col("x2").cast("long").alias("x2"), "n2",
                    r6(z).alias("z"), r6(p).alias("p_value"))


# ---------------------------------------------------------------- moments on orders
_ORD = "o_orderstatus = 'F'"


def _orders_flag(spark, sf):
    o = S.table(spark, sf, "orders")
    return o.select((F.col("o_orderstatus") == "F").alias("flag"), F.col("o_totalprice").alias("v"))


_MOM_SQL = f"""
WITH o AS (SELECT {_ORD} AS flag, o_totalprice AS v FROM orders),
mn AS (SELECT flag, count(*) AS n, avg(v) AS mean FROM o GROUP BY flag),
mo AS (SELECT o.flag, mn.n, mn.mean, sum((v - mean) ^ 2) AS s2, sum((v - mean) ^ 3) AS s3, sum((v - mean) ^ 4) AS s4
       FROM o JOIN mn ON o.flag = mn.flag GROUP BY o.flag, mn.n, mn.mean),
m AS (SELECT flag, n, mean, s2 / (n - 1) AS var, s2 / n AS m2, s3 / n AS m3, s4 / n AS m4 FROM mo)
"""


# ---------------------------------------------------------------- I6
@query("jarque_bera", _MOM_SQL + """
, j AS (SELECT flag, n, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) - 3 AS kurt FROM m),
jb AS (SELECT flag, n, skew, kurt, n / 6.0 * (skew * skew + kurt * kurt / 4.0) AS jb FROM j)
SELECT flag, n, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round(jb, 6) AS jb, round(exp(-jb / 2.0), 6) AS jb_p FROM jb
""")
def jarque_bera(spark, sf):
    m = ST.jarque_bera(ST.group_moments(_orders_flag(spark, sf), "flag", "v"))
    return m.select("flag", "n", *[r6(F.col(c)).alias(c) for c in ["skew", "kurt", "jb", "jb_p"]])


# ---------------------------------------------------------------- I7
@query("levene", f"""
WITH o AS (SELECT {_ORD} AS flag, o_totalprice AS v FROM orders),
md AS (SELECT flag, quantile_cont(v, 0.5) AS med FROM o GROUP BY flag),
z AS (SELECT o.flag, abs(v - med) AS z FROM o JOIN md ON o.flag = md.flag),
zi AS (SELECT flag, count(*) AS n, avg(z) AS zi FROM z GROUP BY flag),
za AS (SELECT avg(z) AS zbar, count(*) AS nn FROM z),
w AS (SELECT sum((z.z - zi.zi) ^ 2) AS w FROM z JOIN zi ON z.flag = zi.flag),
b AS (SELECT sum(n * (zi - zbar) ^ 2) AS b, count(*) AS k, any_value(nn) AS nn FROM zi CROSS JOIN za)
SELECT round((nn - k) / (k - 1) * b / w, 6) AS w, CAST(k - 1 AS DOUBLE) AS df1, CAST(nn - k AS DOUBLE) AS df2 FROM b CROSS JOIN w
""")
def levene(spark, sf):
    lv = ST.levene(_orders_flag(spark, sf), "flag", "v")
    return lv.select(r6(F.col("w")).alias("w"), "df1", "df2")


# ---------------------------------------------------------------- I8
@query("welch_t", _MOM_SQL + """
, a AS (SELECT n AS n1, mean AS m1, var AS v1 FROM m WHERE flag), b AS (SELECT n AS n2, mean AS m2, var AS v2 FROM m WHERE NOT flag),
t AS (SELECT (m1 - m2) / sqrt((((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) * (1.0 / n1 + 1.0 / n2)) AS t_student,
             CAST(n1 + n2 - 2 AS DOUBLE) AS df_student,
             (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t_welch,
             (v1 / n1 + v2 / n2) ^ 2 / ((v1 / n1) ^ 2 / (n1 - 1) + (v2 / n2) ^ 2 / (n2 - 1)) AS df_welch FROM a CROSS JOIN b)
SELECT round(t_student, 6) AS t_student, df_student, round(t_welch, 6) AS t_welch, round(df_welch, 6) AS df_welch FROM t
""")
def welch_t(spark, sf):
    m = ST.group_moments(_orders_flag(spark, sf), "flag", "v")
    a = m.filter(F.col("flag")).select(F.col("n").alias("n1"), F.col("mean").alias("m1"), F.col("var").alias("v1"))
    b = m.filter(~F.col("flag")).select(F.col("n").alias("n2"), F.col("mean").alias("m2"), F.col("var").alias("v2"))
    tt = ST.t_tests({"n": F.col("n1"), "mean": F.col("m1"), "var": F.col("v1")},
                    {"n": F.col("n2"), "mean": F.col("m2"), "var": F.col("v2")})
    return a.crossJoin(b).select(r6(tt["t_student"]).alias("t_student"), tt["df_student"].alias("df_student"),
                                 r6(tt["t_welch"]).alias("t_welch"), r6(tt["df_welch"]).alias("df_welch"))


# ---------------------------------------------------------------- I9
@query("mann_whitney", f"""
WITH h AS (SELECT o_totalprice AS v, count(*) AS c, count(*) FILTER (WHERE {_ORD}) AS c1 FROM orders GROUP BY 1),
cu AS (SELECT v, c, c1, sum(c) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM h),
a AS (SELECT sum(c1 * (cum - c + (c + 1) / 2.0)) AS r1, CAST(sum(c1) AS DOUBLE) AS n1, CAST(sum(c) AS DOUBLE) AS n,
             sum(CAST(c AS DOUBLE) ^ 3 - c) AS ties FROM cu),
u AS (SELECT n1, n - n1 AS n2, r1 - n1 * (n1 + 1) / 2.0 AS u1, n, ties FROM a),
z AS (SELECT n1, n2, u1, (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2.0 - 0.5)
          / sqrt(n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM u)
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(u1, 6) AS u, round(z, 6) AS z,
       round(least(2.0 * 0.5 * {ST.erfc_sql(f"(z / {_SQ2})")}, 1.0), 6) AS p_value FROM z
""")
def mann_whitney(spark, sf):
    mw = ST.mann_whitney(_orders_flag(spark, sf), "flag", "v")
    return mw.select("n1", "n2", r6(F.col("u")).alias("u"), r6(F.col("z")).alias("z"),
                     r6(F.col("p_value")).alias("p_value"))


# ---------------------------------------------------------------- I6: Shapiro-Wilk
def _shapiro_sql(src: str) -> str:
    """CTEs from (k, v) to sw(k, n, w, p_value): ranks by window, one weight a row."""
    (a0, a1, a2), (b1, b2, b3) = ST._START

    def poly(cs, x):
        return " + ".join(f"{float(c)!r}::DOUBLE * pow({x}, {len(cs) - 1 - i})" for i, c in enumerate(cs))

    def newton(z):
        return (f"{z} + (0.5e0 * {ST.erfc_sql(f'({z} / {_SQ2})')} - small) * {math.sqrt(2 * math.pi)!r}::DOUBLE * exp({z} * {z} / 2)")
    return f"""
sw_r AS (SELECT k, v::DOUBLE AS v, row_number() OVER (PARTITION BY k ORDER BY v) AS i, count(*) OVER (PARTITION BY k) AS n,
                avg(v) OVER (PARTITION BY k) AS mean FROM {src} WHERE v IS NOT NULL),
sw_q AS (SELECT *, (i - 0.375e0) / (n + 0.25e0) AS q, least((i - 0.375e0) / (n + 0.25e0), 1 - (i - 0.375e0) / (n + 0.25e0)) AS small FROM sw_r),
sw_t AS (SELECT *, sqrt(-2 * ln(small)) AS t FROM sw_q),
sw_0 AS (SELECT *, t - ({a0}e0 + {a1}e0 * t + {a2}e0 * t * t) / (1 + {b1}e0 * t + {b2}e0 * t * t + {b3}e0 * t * t * t) AS z FROM sw_t),
sw_1 AS (SELECT * REPLACE ({newton("z")} AS z) FROM sw_0),
sw_2 AS (SELECT * REPLACE ({newton("z")} AS z) FROM sw_1),
sw_m AS (SELECT *, CASE WHEN q < 0.5 THEN -z WHEN q > 0.5 THEN z ELSE 0 END AS m FROM sw_2),
sw_g AS (SELECT k, n, sum(m * m) AS mm, max(m) FILTER (WHERE i = n) AS m0, max(m) FILTER (WHERE i = n - 1) AS m1 FROM sw_m GROUP BY k, n),
sw_a AS (SELECT *, CASE WHEN n = 3 THEN {math.sqrt(0.5)!r}::DOUBLE ELSE {poly(ST._W_LAST, "(1 / sqrt(n))")} + m0 / sqrt(mm) END AS a0,
                {poly(ST._W_NEXT, "(1 / sqrt(n))")} + m1 / sqrt(mm) AS a1 FROM sw_g),
sw_e AS (SELECT *, sqrt(CASE WHEN n <= 5 THEN (mm - 2 * m0 * m0) / (1 - 2 * a0 * a0)
                        ELSE (mm - 2 * m0 * m0 - 2 * m1 * m1) / (1 - 2 * a0 * a0 - 2 * a1 * a1) END) AS root FROM sw_a WHERE n >= 3),
sw_b AS (SELECT r.k, r.n, pow(sum(v * CASE WHEN i = 1 THEN -a0 WHEN i = r.n THEN a0 WHEN r.n = 3 THEN 0 WHEN r.n > 5 AND i = 2 THEN -a1
                                  WHEN r.n > 5 AND i = r.n - 1 THEN a1 ELSE m / root END), 2) AS b2, sum(pow(v - mean, 2)) AS ss
         FROM sw_m r JOIN sw_e e ON r.k = e.k GROUP BY r.k, r.n),
sw_w AS (SELECT k, n, CASE WHEN ss > 0 THEN least(b2 / ss, 1) ELSE 1 END AS w FROM sw_b),
sw_z AS (SELECT *, CASE WHEN w >= 1 THEN 0 WHEN n <= 11 THEN (-ln({poly(ST._W_GAMMA, "n")} - ln(1 - w)) - ({poly(ST._W_MU_SMALL, "n")}))
                                      / exp({poly(ST._W_SIGMA_SMALL, "n")})
                        ELSE (ln(1 - w) - ({poly(ST._W_MU, "ln(n)")})) / exp({poly(ST._W_SIGMA, "ln(n)")}) END AS z FROM sw_w),
sw AS (SELECT k, n, w, CASE WHEN w >= 1 THEN 1
                            WHEN n = 3 THEN greatest({6 / math.pi!r}::DOUBLE * (asin(sqrt(w)) - {math.asin(math.sqrt(0.75))!r}::DOUBLE), 0)
                            ELSE 0.5e0 * {ST.erfc_sql(f"(z / {_SQ2})")} END AS p_value FROM sw_z)"""


@query("shapiro_wilk", f"""
WITH x AS (SELECT 'c' || (c_custkey // 5) % 40 AS k, c_acctbal AS v FROM customer UNION ALL
           SELECT 's' || s_nationkey, s_acctbal FROM supplier UNION ALL
           SELECT o_orderstatus, o_totalprice FROM orders UNION ALL
           SELECT 'p' || n_regionkey, n_nationkey * n_nationkey FROM nation), {_shapiro_sql("x")}
SELECT k, n, round(w, 6) AS w, round(p_value, 6) AS p_value FROM sw
""")
def shapiro_wilk(spark, sf):
    """Balances of groups of customers and of each nation's suppliers, order
    prices by status, and squares by region: samples from three values on."""
    c, s, o, n = (S.table(spark, sf, t) for t in ("customer", "supplier", "orders", "nation"))
    x = (c.select(F.concat(F.lit("c"), F.expr("(c_custkey div 5) % 40")).alias("k"), F.col("c_acctbal").cast("double").alias("v"))
         .unionByName(s.select(F.concat(F.lit("s"), "s_nationkey").alias("k"), F.col("s_acctbal").cast("double").alias("v")))
         .unionByName(o.select(F.col("o_orderstatus").alias("k"), F.col("o_totalprice").cast("double").alias("v")))
         .unionByName(n.select(F.concat(F.lit("p"), "n_regionkey").alias("k"),
                               (F.col("n_nationkey") * F.col("n_nationkey")).cast("double").alias("v"))))
    w = ST.shapiro_wilk(x, "k", "v").where(F.col("w").isNotNull())
    return w.select("k", "n", r6(F.col("w")).alias("w"), r6(F.col("p_value")).alias("p_value"))


# ---------------------------------------------------------------- I10 over samples that take each branch
def _samples(spark, sf):
    """(test, flag, v): mean balances of runs of customers (by the central limit
    near normal; runs of one length, then of two lengths), order prices by status,
    and a skewed figure of the nations of one region against the others."""
    c, o, n = (S.table(spark, sf, t) for t in ("customer", "orders", "nation"))

    def means(length):
        run = F.expr(f"c_custkey div {length}").alias("run")
        return c.groupBy(run).agg(F.avg("c_acctbal").alias("v"))
    equal = means(10).select(F.lit("equal spread").alias("test"), (F.col("run") % 2 == 0).alias("flag"), "v")
    wide = means(3).select(F.lit("two spreads").alias("test"), F.lit(True).alias("flag"), "v")
    narrow = means(30).select(F.lit("two spreads").alias("test"), F.lit(False).alias("flag"), "v")
    prices = o.select(F.lit("skewed").alias("test"), (F.col("o_orderstatus") == "F").alias("flag"), F.col("o_totalprice").cast("double").alias("v"))
    few = n.select(F.lit("few").alias("test"), (F.col("n_regionkey") == 1).alias("flag"),
                   F.exp(F.col("n_nationkey").cast("double") / 2).alias("v"))
    return equal.unionByName(wide).unionByName(narrow).unionByName(prices).unionByName(few)


_SAMPLES_SQL = """
x AS (SELECT 'equal spread' AS test, (c_custkey // 10) % 2 = 0 AS flag, avg(c_acctbal) AS v FROM customer GROUP BY c_custkey // 10
      UNION ALL SELECT 'two spreads', true, avg(c_acctbal) FROM customer GROUP BY c_custkey // 3
      UNION ALL SELECT 'two spreads', false, avg(c_acctbal) FROM customer GROUP BY c_custkey // 30
      UNION ALL SELECT 'skewed', o_orderstatus = 'F', o_totalprice FROM orders
      UNION ALL SELECT 'few', n_regionkey = 1, exp(n_nationkey / 2.0e0) FROM nation)"""
_TESTS = ["equal spread", "two spreads", "skewed", "few"]


@query("compare_means", f"""
WITH {_SAMPLES_SQL},
y AS (SELECT test || CASE WHEN flag THEN '+' ELSE '-' END AS k, v FROM x), {_shapiro_sql("y")},
mo AS (SELECT test, count(*) FILTER (WHERE flag) AS n1, count(*) FILTER (WHERE NOT flag) AS n2, avg(v) FILTER (WHERE flag) AS a1,
              avg(v) FILTER (WHERE NOT flag) AS a2, var_samp(v) FILTER (WHERE flag) AS v1, var_samp(v) FILTER (WHERE NOT flag) AS v2 FROM x GROUP BY test),
t AS (SELECT *, (a1 - a2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS ts, (n1 + n2 - 2)::DOUBLE AS ds,
             (a1 - a2) / sqrt(v1 / n1 + v2 / n2) AS tw,
             pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS dw FROM mo),
md AS (SELECT test, flag, quantile_cont(v, 0.5) AS med FROM x GROUP BY test, flag),
ab AS (SELECT x.test, x.flag, abs(v - med) AS z FROM x JOIN md USING (test, flag)),
gz AS (SELECT test, flag, count(*) AS n, avg(z) AS zi, sum(z) AS s FROM ab GROUP BY test, flag),
tz AS (SELECT test, sum(n) AS n, sum(s) / sum(n) AS zbar FROM gz GROUP BY test),
lb AS (SELECT test, sum(gz.n * pow(zi - zbar, 2)) AS b, max(tz.n) - 2 AS d2 FROM gz JOIN tz USING (test) GROUP BY test),
lw AS (SELECT test, sum(pow(z - zi, 2)) AS w FROM ab JOIN gz USING (test, flag) GROUP BY test),
lv AS (SELECT test, d2 * b / w AS f, d2 FROM lb JOIN lw USING (test)),
rk AS (SELECT test, flag, rank() OVER (PARTITION BY test ORDER BY v) + (count(*) OVER (PARTITION BY test, v) - 1) / 2.0e0 AS r,
              count(*) OVER (PARTITION BY test, v) AS ties FROM x),
ru AS (SELECT test, sum(r) FILTER (WHERE flag) - count(*) FILTER (WHERE flag) * (count(*) FILTER (WHERE flag) + 1) / 2.0e0 AS u,
              sum(ties * ties - 1.0e0) AS tied FROM rk GROUP BY test),
rz AS (SELECT test, u, tied = 0 AND least(n1, n2) <= {ST.EXACT_SAMPLE} AS exact,
              (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0e0 - 0.5e0)
              / sqrt(n1 * n2 / 12.0e0 * ((n1 + n2 + 1) - tied / ((n1 + n2) * (n1 + n2 - 1.0e0)))) AS z FROM ru JOIN mo USING (test)),
pl AS (SELECT range AS i FROM range(25)),
en AS (SELECT a.i + b.i + c.i + d.i + e.i - 10 AS u, count(*) AS ways FROM pl a, pl b, pl c, pl d, pl e
       WHERE a.i < b.i AND b.i < c.i AND c.i < d.i AND d.i < e.i GROUP BY 1),
ex AS (SELECT test, least(2 * (SELECT sum(ways) FROM en WHERE en.u <= least(rz.u, 100 - rz.u)) / (SELECT sum(ways) FROM en), 1) AS p FROM rz WHERE exact),
p AS (SELECT t.test, n1, n2, rz.exact, a.p_value AS np1, b.p_value AS np2,
             {ST.beta_share_sql("atan2(sqrt(d2), sqrt(f))", "d2 / 2.0e0", "0.5e0")} AS levene_p,
             {ST.beta_share_sql("atan2(sqrt(ds), abs(ts))", "ds / 2.0e0", "0.5e0")} AS student_p,
             {ST.beta_share_sql("atan2(sqrt(dw), abs(tw))", "dw / 2.0e0", "0.5e0")} AS welch_p,
             CASE WHEN rz.exact THEN ex.p ELSE least({ST.erfc_sql(f"(z / {_SQ2})")}, 1) END AS rank_p
      FROM t JOIN lv USING (test) JOIN rz USING (test) LEFT JOIN ex USING (test) JOIN sw a ON a.k = t.test || '+' JOIN sw b ON b.k = t.test || '-'),
r AS (SELECT *, np1 > 0.05 AND np2 > 0.05 AS normal, levene_p > 0.05 AS homo FROM p),
c AS (SELECT *, CASE WHEN normal AND homo THEN student_p WHEN normal THEN welch_p ELSE rank_p END AS pv FROM r)
SELECT test AS sample, normal AS normality_pass, homo AS homoscedasticity_pass,
       CASE WHEN normal AND homo THEN '{ST.TEST_STUDENT}' WHEN normal THEN '{ST.TEST_WELCH.replace("'", "''")}' ELSE '{ST.TEST_RANKS}' END AS test,
       round(pv, 6) AS p_value, CASE WHEN pv < 0.05 THEN '{ST.CONCLUSION_DIFFERENT}' ELSE '{ST.CONCLUSION_EQUAL}' END AS conclusion,
       n1, n2, round(np1, 6) AS normal_p1, round(np2, 6) AS normal_p2, round(levene_p, 6) AS levene_p, exact AS mw_exact FROM c
""")
def compare_means(spark, sf):
    """The decision tree over four pairs of samples."""
    samples, out = _samples(spark, sf), None
    for name in _TESTS:
        r = ST.compare_means(samples.where(F.col("test") == name), "flag", "v")
        r = r.select(F.lit(name).alias("sample"), *[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes])
        out = r if out is None else out.unionByName(r)
    return out


# ---------------------------------------------------------------- I7, I8: tails
@query("mean_test_tails", f"""
WITH x AS (SELECT o_orderpriority AS g, o_orderstatus = 'F' AS flag, o_totalprice AS v FROM orders),
m AS (SELECT g, count(*) FILTER (WHERE flag) AS n1, count(*) FILTER (WHERE NOT flag) AS n2, avg(v) FILTER (WHERE flag) AS a1,
             avg(v) FILTER (WHERE NOT flag) AS a2, var_samp(v) FILTER (WHERE flag) AS v1, var_samp(v) FILTER (WHERE NOT flag) AS v2 FROM x GROUP BY g),
t AS (SELECT g, (a1 - a2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS ts, (n1 + n2 - 2)::DOUBLE AS ds,
             (a1 - a2) / sqrt(v1 / n1 + v2 / n2) AS tw, v1 / v2 AS f, n1 - 1.0e0 AS d1, n2 - 1.0e0 AS d2,
             pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS dw FROM m)
SELECT g AS priority, round({ST.beta_share_sql("atan2(sqrt(ds), abs(ts))", "ds / 2.0e0", "0.5e0")}, 6) AS student_p,
       round({ST.beta_share_sql("atan2(sqrt(dw), abs(tw))", "dw / 2.0e0", "0.5e0")}, 6) AS welch_p,
       round({ST.beta_share_sql("atan2(sqrt(d2), sqrt(d1 * f))", "d2 / 2.0e0", "d1 / 2.0e0")}, 6) AS variance_ratio_p FROM t
""")
def mean_test_tails(spark, sf):
    """Student, Welch and variance ratio tails of order prices by status, per priority."""
    o = S.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("g"), (F.col("o_orderstatus") == "F").alias("flag"),
                                            F.col("o_totalprice").cast("double").alias("v"))

    def side(cond, k):
        return [F.count_if(cond).alias(f"n{k}"), F.avg(F.when(cond, F.col("v"))).alias(f"m{k}"), F.var_samp(F.when(cond, F.col("v"))).alias(f"v{k}")]
    m = o.groupBy("g").agg(*side(F.col("flag"), 1), *side(~F.col("flag"), 2))
    one, two = ({"n": F.col(f"n{k}"), "mean": F.col(f"m{k}"), "var": F.col(f"v{k}")} for k in (1, 2))
    t = m.select("g", "n1", "n2", ST.over(F.col("v1"), F.col("v2")).alias("f"), *[c.alias(n) for n, c in ST.t_tests(one, two).items()])
    return t.select(F.col("g").alias("priority"),
                    r6(ST.t_two_sided_p(F.col("t_student"), F.col("df_student"))).alias("student_p"),
                    r6(ST.t_two_sided_p(F.col("t_welch"), F.col("df_welch"))).alias("welch_p"),
                    r6(ST.f_sf(F.col("f"), F.col("n1") - 1.0, F.col("n2") - 1.0)).alias("variance_ratio_p"))
