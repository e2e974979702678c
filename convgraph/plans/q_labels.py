"""Registered queries: label statistics, elements, features."""
from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from convgraph.operators import elements as E
from convgraph.operators import features as FT
from convgraph.operators import labels as L
from convgraph.plans import standins as S
from convgraph.plans.registry import query, r6

LAB = S.LABELS
_LABELLED = f"WITH lab AS ({S.LABELLED_SQL})"


def _e3_labels(spark, sf):
    """Long labels of E3 nodes: the event type, plus 'high_value'."""
    ev = S.table(spark, sf, "events")
    return ev.select(F.col("event_id").alias("id"), F.col("event_type").alias("label")).unionByName(
        ev.filter(F.col("value") >= 100).select(F.col("event_id").alias("id"), F.lit("high_value").alias("label")))


_E3_LABELS_SQL = ("SELECT event_id AS id, event_type AS label FROM events UNION ALL "
                  "SELECT event_id, 'high_value' FROM events WHERE value >= 100")


def _e3_edges(spark, sf):
    return S.e3_edges_raw(spark, sf).groupBy("src", "dst").agg(F.max("context_type").alias("context_type"))


# ---------------------------------------------------------------- A16
@query("label_prevalence", _LABELLED + " " + " UNION ALL ".join(
    f"SELECT '{l}' AS label, CAST(sum({l}) AS BIGINT) AS n, round(avg({l}) * 100, 6) AS pct FROM lab" for l in LAB))
def label_prevalence(spark, sf):
    p = L.prevalence(S.labelled(spark, sf), LAB)
    return p.select("label", "n", r6(F.col("pct")).alias("pct"))


# ---------------------------------------------------------------- A17
def _corr_sql(a, b):
    return (f"CASE WHEN (count(*) * sum({a}*{a}) - sum({a})*sum({a})) * (count(*) * sum({b}*{b}) - sum({b})*sum({b})) > 0 "
            f"THEN (count(*) * sum({a}*{b}) - sum({a})*sum({b})) / sqrt(CAST((count(*) * sum({a}*{a}) - sum({a})*sum({a})) AS DOUBLE) "
            f"* CAST((count(*) * sum({b}*{b}) - sum({b})*sum({b})) AS DOUBLE)) END")


@query("label_correlation", _LABELLED + " " + " UNION ALL ".join(
    f"SELECT '{a}' AS label_a, '{b}' AS label_b, round({_corr_sql(a, b)}, 6) AS corr FROM lab"
    for a, b in product(LAB, LAB)))
def label_correlation(spark, sf):
    c = L.correlation(S.labelled(spark, sf), LAB)
    return c.select("label_a", "label_b", r6(F.col("corr")).alias("corr"))


# ---------------------------------------------------------------- A18
@query("label_cooccurrence", _LABELLED + " " + " UNION ALL ".join(
    f"SELECT '{a}' AS label_a, '{b}' AS label_b, CAST(sum({a} * {b}) AS BIGINT) AS n FROM lab"
    for a, b in product(LAB, LAB)))
def label_cooccurrence(spark, sf):
    return L.cooccurrence(S.labelled(spark, sf), LAB)


# ---------------------------------------------------------------- A19
@query("labels_per_row", _LABELLED + f"""
SELECT {' + '.join(LAB)} AS n_labels, count(*) AS n_rows FROM lab GROUP BY 1
""")
def labels_per_row(spark, sf):
    return L.labels_per_row(S.labelled(spark, sf), LAB)


# ---------------------------------------------------------------- A20 + A21
@query("label_transitions", f"""
WITH e AS ({S.E3_EDGES_SQL}), l AS ({_E3_LABELS_SQL}),
ct AS (SELECT ls.label AS src_label, ld.label AS dst_label, count(*) AS n_pairs
       FROM e JOIN l ls ON e.src = ls.id JOIN l ld ON e.dst = ld.id GROUP BY 1, 2)
SELECT src_label, dst_label, n_pairs,
       round(n_pairs * 100.0 / sum(n_pairs) OVER (), 6) AS pct_all,
       round(n_pairs * 100.0 / sum(n_pairs) OVER (PARTITION BY src_label), 6) AS pct_row
FROM ct
""")
def label_transitions(spark, sf):
    t = L.transitions(_e3_edges(spark, sf), _e3_labels(spark, sf))
    return t.select("src_label", "dst_label", "n_pairs", r6(F.col("pct_all")).alias("pct_all"),
                    r6(F.col("pct_row")).alias("pct_row"))


# ---------------------------------------------------------------- A22
_REPLY_SQL = f"""
WITH e AS ({S.E3_EDGES_SQL}), l AS ({_E3_LABELS_SQL}),
j AS (SELECT ls.label AS source_label, CAST(ld.label <> '{S.E3_NONE_LABEL}' AS INTEGER) AS flag
      FROM e JOIN l ls ON e.src = ls.id LEFT JOIN l ld ON e.dst = ld.id),
g AS (SELECT source_label, CAST(coalesce(sum(flag), 0) AS BIGINT) AS successes, count(flag) AS trials
      FROM j GROUP BY 1)
"""


@query("reply_proportion", _REPLY_SQL + """
SELECT source_label, successes, trials, round(successes / trials, 6) AS proportion FROM g
""")
def reply_proportion(spark, sf):
    g = L.flagged_reply_share(_e3_edges(spark, sf), _e3_labels(spark, sf), S.E3_NONE_LABEL)
    return g.select("source_label", "successes", "trials", r6(F.col("proportion")).alias("proportion"))


# ---------------------------------------------------------------- I5 (+ J9)
def _kappa_sql(l):
    pa, pb = f"(sum(a.{l}) / count(*))", f"(sum(b.{l}) / count(*))"
    po = f"(sum(CAST(a.{l} = b.{l} AS INTEGER)) / count(*))"
    pe = f"({pa} * {pb} + (1 - {pa}) * (1 - {pb}))"
    return f"CASE WHEN {pe} < 1 THEN ({po} - {pe}) / (1 - {pe}) END"


@query("cohen_kappa", f"""
WITH lab AS ({S.LABELLED_SQL}), sec AS ({S.SECOND_SQL}),
k AS ({" UNION ALL ".join(f"SELECT '{l}' AS label, {_kappa_sql(l)} AS kappa FROM lab a JOIN sec b ON a.id = b.id" for l in LAB)})
SELECT label, round(kappa, 6) AS kappa FROM k
UNION ALL SELECT 'mean', round(avg(kappa), 6) FROM k
""")
def cohen_kappa(spark, sf):
    k = L.cohen_kappa(S.labelled(spark, sf), S.second_annotator(spark, sf), "id", LAB)
    return k.select("label", r6(F.col("kappa")).alias("kappa"))


# ---------------------------------------------------------------- elements
def _with_elements(spark, sf):
    return S.labelled(spark, sf).withColumn("elements", S.topic_words(F.col("text")))


_ELEM_SQL = f"""
WITH lab AS ({S.LABELLED_SQL}),
el AS (SELECT id, unnest({S.TOPIC_WORDS_SQL.format(c='text')}) AS element FROM lab),
fr AS (SELECT element, count(*) AS frequency FROM el GROUP BY 1),
ll AS ({S.labels_long_sql('lab')})
"""


@query("element_frequency", _ELEM_SQL + "SELECT element, frequency FROM fr")
def element_frequency(spark, sf):
    return E.frequencies(_with_elements(spark, sf), "elements")


@query("top_percentile_elements", _ELEM_SQL + """
, c AS (SELECT element, frequency,
        sum(frequency) OVER (ORDER BY frequency DESC, element ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
          AS cumulative_frequency, sum(frequency) OVER () AS tot FROM fr)
SELECT element, frequency, CAST(cumulative_frequency AS BIGINT) AS cumulative_frequency,
       round(cumulative_frequency * 100.0 / tot, 6) AS cumulative_pct
FROM c WHERE cumulative_frequency * 100.0 / tot <= 45
""")
def top_percentile_elements(spark, sf):
    fr = E.frequencies(_with_elements(spark, sf), "elements")
    t = E.top_percentile(fr, "element", 45)
    return t.select("element", "frequency", "cumulative_frequency",
                    r6(F.col("cumulative_pct")).alias("cumulative_pct"))


_TFIDF_SQL = _ELEM_SQL + """
, tf AS (SELECT ll.label, el.element, count(*) AS tf FROM el JOIN ll ON el.id = ll.id GROUP BY 1, 2),
nd AS (SELECT count(DISTINCT label) AS nd FROM tf),
dfq AS (SELECT element, count(*) AS dfreq FROM tf GROUP BY 1),
w AS (SELECT tf.label, tf.element, tf.tf * (ln((1 + nd.nd) / (1 + dfq.dfreq)) + 1) AS w
      FROM tf JOIN dfq ON tf.element = dfq.element CROSS JOIN nd),
t AS (SELECT label, element, w / sqrt(sum(w * w) OVER (PARTITION BY label)) AS tfidf FROM w)
"""


@query("tfidf_by_label", _TFIDF_SQL + "SELECT label, element, round(tfidf, 6) AS tfidf FROM t")
def tfidf_by_label(spark, sf):
    d = _with_elements(spark, sf)
    t = E.tfidf_by_label(d, "elements", S.labels_long(d))
    return t.select("label", "element", r6(F.col("tfidf")).alias("tfidf"))


@query("tfidf_extremes", _TFIDF_SQL + f"""
, cand AS (SELECT fr.element, coalesce(t.tfidf, 0.0) AS tfidf FROM fr
           LEFT JOIN t ON t.element = fr.element AND t.label = '{S.NONE_LABEL}' WHERE fr.frequency >= 5),
top AS (SELECT element, tfidf, 'top' AS "end" FROM cand ORDER BY tfidf DESC, element LIMIT 15),
bot AS (SELECT element, tfidf, 'bottom' AS "end" FROM cand ORDER BY tfidf ASC, element LIMIT 15)
SELECT element, round(tfidf, 6) AS tfidf, "end" FROM top UNION ALL SELECT element, round(tfidf, 6), "end" FROM bot
""")
def tfidf_extremes(spark, sf):
    """W11 on A25: the 15 highest and lowest 'none' weights among elements
    seen at least 5 times (absent = 0, as in the dense matrix)."""
    d = _with_elements(spark, sf)
    t = E.tfidf_by_label(d, "elements", S.labels_long(d)).filter(F.col("label") == S.NONE_LABEL)
    fr = E.frequencies(d, "elements").filter(F.col("frequency") >= 5)
    cand = fr.join(t.select("element", "tfidf"), "element", "left").select(
        "element", F.coalesce("tfidf", F.lit(0.0)).alias("tfidf"))
    ex = E.extremes(cand, "tfidf", "element", 15)
    return ex.select("element", r6(F.col("tfidf")).alias("tfidf"), "end")


@query("element_label_matrix", _ELEM_SQL + """
, f5 AS (SELECT * FROM fr WHERE frequency >= 5)
SELECT el.element, ll.label, count(*) AS absolute, round(count(*) / any_value(f5.frequency), 6) AS relative
FROM el JOIN f5 ON el.element = f5.element JOIN ll ON el.id = ll.id GROUP BY 1, 2
""")
def element_label_matrix(spark, sf):
    d = _with_elements(spark, sf)
    m = E.element_label_matrix(d, "elements", S.labels_long(d), 5)
    return m.select("element", "label", "absolute", r6(F.col("relative")).alias("relative"))


_TABLES_SQL = _ELEM_SQL + f"""
, tb AS (SELECT el.element, count(*) AS frequency, {", ".join(f"count(*) FILTER (WHERE lab.{l} = 1) AS abs_{l}" for l in S.LABELS)}
         FROM el JOIN lab USING (id) GROUP BY 1),
tr AS (SELECT element, frequency, {", ".join(f"abs_{l}, round(abs_{l} / frequency, 6) AS rel_{l}" for l in S.LABELS)} FROM tb)"""


@query("share_above", _ELEM_SQL + """
SELECT c.cut, round(100.0 * avg(CAST(frequency > c.cut AS INTEGER)), 6) AS pct_elements,
       round(100.0 * sum(CASE WHEN frequency > c.cut THEN frequency ELSE 0 END) / sum(frequency), 6) AS pct_occurrences
FROM fr, (SELECT unnest([1, 5, 20]) AS cut) c GROUP BY c.cut
""")
def share_above(spark, sf):
    """The share of elements and of their occurrences above three cuts."""
    fr, out = E.frequencies(_with_elements(spark, sf), "elements"), None
    for cut in (1, 5, 20):
        r = E.share_above(fr, cut).select(F.lit(cut).alias("cut"), r6(F.col("pct_elements")).alias("pct_elements"),
                                          r6(F.col("pct_occurrences")).alias("pct_occurrences"))
        out = r if out is None else out.unionByName(r)
    return out


@query("element_label_tables", _TABLES_SQL + "SELECT * FROM tr")
def element_label_tables(spark, sf):
    """Unfiltered absolute and relative tables, zeros included."""
    t = E.element_label_tables(_with_elements(spark, sf), "elements", S.LABELS)
    return t.select("element", "frequency", *["abs_" + l for l in S.LABELS], *[r6(F.col("rel_" + l)).alias("rel_" + l) for l in S.LABELS])


@query("element_label_report", _TABLES_SQL + f"""
, f AS (SELECT *, abs_{S.NONE_LABEL} / frequency AS v FROM tb WHERE frequency >= 5),
k AS (SELECT element, row_number() OVER (ORDER BY v DESC, element) AS top, row_number() OVER (ORDER BY v, element) AS bottom FROM f)
SELECT tr.element, frequency, rel_{S.NONE_LABEL} FROM tr JOIN k USING (element) WHERE top <= 10 OR bottom <= 10
""")
def element_label_report(spark, sf):
    """The ten elements with the largest and with the smallest share of rows without a label."""
    t = E.element_label_tables(_with_elements(spark, sf), "elements", S.LABELS)
    r = E.element_label_report(t, S.NONE_LABEL, 5, 10)
    return r.select("element", "frequency", r6(F.col("rel_" + S.NONE_LABEL)).alias("rel_" + S.NONE_LABEL))


@query("selected_elements", _ELEM_SQL + """
, sel AS (SELECT element FROM fr WHERE frequency > 5)
SELECT lab.id, count(sel.element) AS n_selected
FROM lab LEFT JOIN el ON lab.id = el.id LEFT JOIN sel ON el.element = sel.element GROUP BY lab.id
""")
def selected_elements(spark, sf):
    """A27 + A29: elements seen more than 5 times, and per row how many of
    them it holds (0 for rows without one)."""
    d = _with_elements(spark, sf)
    sel = E.select_by_frequency(E.frequencies(d, "elements"), 5)
    m = E.membership_flags(d, "elements", sel).groupBy("id").agg(F.count(F.lit(1)).alias("n_selected"))
    return d.select("id").join(m, "id", "left").fillna(0, ["n_selected"])


# ---------------------------------------------------------------- features
_WORDS_SQL = "list_filter(regexp_split_to_array(lower({c}), '[^a-z]+'), lambda x: x <> '')"
_LEX_SQL = f"""
lex AS (SELECT word, (length(word) % 10) / 10.0 + ascii(word) / 1000.0 AS valence,
               (ascii(right(word, 1)) - 97) / 26.0 AS arousal, (length(word) % 7) / 7.0 AS dominance
        FROM (SELECT DISTINCT word FROM (SELECT unnest({_WORDS_SQL.format(c='text')}) AS word FROM documents)
              WHERE length(word) >= 3)),
tok AS (SELECT id, unnest({_WORDS_SQL.format(c='text')}) AS word FROM lab)
"""


def _lexicon(spark, sf):
    return FT.word_lexicon(S.table(spark, sf, "documents"), "text")


@query("lexicon_scores", _LABELLED + ", " + _LEX_SQL + """
, m AS (SELECT id, avg(valence) AS v, avg(arousal) AS a, avg(dominance) AS d FROM tok JOIN lex USING (word) GROUP BY id)
SELECT lab.id, round(coalesce(m.v, 0.5), 6) AS valence, round(coalesce(m.a, 0.5), 6) AS arousal,
       round(coalesce(m.d, 0.5), 6) AS dominance
FROM lab LEFT JOIN m ON lab.id = m.id
""")
def lexicon_scores(spark, sf):
    s = FT.lexicon_scores(S.labelled(spark, sf), "id", "text", _lexicon(spark, sf))
    return s.select("id", *[r6(F.col(c)).alias(c) for c in ["valence", "arousal", "dominance"]])


@query("polarity", _LABELLED + ", " + _LEX_SQL + """
, j AS (SELECT tok.id, coalesce(lex.valence * 8 - 4, 0.0) AS p FROM tok LEFT JOIN lex USING (word)),
g AS (SELECT id, sum(greatest(p, 0.0)) AS pos, sum(greatest(-p, 0.0)) AS neg, count(*) FILTER (WHERE p = 0) AS neu,
             sum(p) AS s FROM j GROUP BY id),
r AS (SELECT id, pos + neg + neu AS tot, pos, neg, neu, s FROM g)
SELECT lab.id,
  round(coalesce(CASE WHEN tot > 0 THEN neg / tot ELSE 0.0 END, 0.0), 6) AS neg,
  round(coalesce(CASE WHEN tot > 0 THEN neu / tot ELSE 0.0 END, 0.0), 6) AS neu,
  round(coalesce(CASE WHEN tot > 0 THEN pos / tot ELSE 0.0 END, 0.0), 6) AS pos,
  round(coalesce(s / sqrt(s * s + 15.0), 0.0), 6) AS compound
FROM lab LEFT JOIN r ON lab.id = r.id
""")
def polarity(spark, sf):
    lex = _lexicon(spark, sf)
    p = FT.polarity(S.labelled(spark, sf), "id", "text", lex, F.col("valence") * 8 - 4)
    return p.select("id", *[r6(F.col(c)).alias(c) for c in ["neg", "neu", "pos", "compound"]])


@query("tag_histogram", _LABELLED + f"""
, t AS (SELECT id, unnest(regexp_extract_all(text, '({FT.TOKEN_PATTERN})', 1)) AS tok FROM lab),
tg AS (SELECT id, {FT.tag_sql('tok')} AS tag FROM t)
SELECT lab.id, {", ".join(f"CAST(count(tg.tag) FILTER (WHERE tg.tag = '{t}') AS BIGINT) AS POS_{t}" for t in FT.POS_TAGS)}
FROM lab LEFT JOIN tg ON lab.id = tg.id GROUP BY lab.id
""")
def tag_histogram(spark, sf):
    return FT.pos_histogram(S.labelled(spark, sf), "id", "text")
