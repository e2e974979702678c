"""Registered queries: lexicon features and rule-based polarity.

The lexicon is a file: words of labelled documents with their mean labels,
written tab-separated to the shared folder and read back."""
from __future__ import annotations

from pyspark.sql import functions as F

from convgraph.operators import lexicons as LX
from convgraph.operators.features import words
from convgraph.plans import standins as S
from convgraph.plans.registry import query, r6
from convgraph.session import scratch_path
from convgraph.sources import io as SIO

_WORDS_SQL = "list_filter(regexp_split_to_array(lower({c}), '[^a-z]+'), lambda x: x <> '')"
_LEXICON_SQL = f"""
lex AS (SELECT word, avg(quality) AS valence, avg(toxic) AS arousal, count(*) / (count(*) + 10.0e0) AS dominance
        FROM (SELECT DISTINCT doc_id, unnest({_WORDS_SQL.format(c='text')}) AS word FROM documents) JOIN labels USING (doc_id)
        GROUP BY word)"""


def _lexicon(spark, sf):
    d = S.table(spark, sf, "documents").join(S.table(spark, sf, "labels"), "doc_id")
    w = d.select("doc_id", "quality", "toxic", F.explode(F.array_distinct(words("text"))).alias("word"))
    n = F.count(F.lit(1))
    path = scratch_path(spark, "word-labels")
    w.groupBy("word").agg(F.avg("quality").alias("valence"), F.avg("toxic").alias("arousal"),
                          (n / (n + 10.0)).alias("dominance")).write.option("sep", "\t").csv(path)
    return SIO.read_lexicon(spark, path)


# ---------------------------------------------------------------- A30 + J13
@query("lexicon_means", f"""
WITH {_LEXICON_SQL},
tok AS (SELECT doc_id, unnest({_WORDS_SQL.format(c='text')}) AS word FROM documents),
m AS (SELECT doc_id, avg(valence) AS v, avg(arousal) AS a, avg(dominance) AS d FROM tok JOIN lex USING (word) GROUP BY doc_id)
SELECT doc_id, round(coalesce(v, 0.5), 6) AS valence, round(coalesce(a, 0.5), 6) AS arousal, round(coalesce(d, 0.5), 6) AS dominance
FROM documents LEFT JOIN m USING (doc_id)
""")
def lexicon_means(spark, sf):
    """Mean lexicon scores of every document."""
    dims = ["valence", "arousal", "dominance"]
    m = LX.lexicon_means(S.table(spark, sf, "documents"), "doc_id", words("text"), _lexicon(spark, sf), dims)
    return m.select("doc_id", *[r6(F.col(c)).alias(c) for c in dims])


# ---------------------------------------------------------------- A31
#: What stands before, between the halves of, and after every tenth text.
_BEFORE = ["", "Not ", "VERY ", "hardly ", "isn't so ", "no no ", "", "Absolutely, ", "(Never) a THE ", "rather "]
_AFTER = ["", "!", "!!", "??", "", "?!?!?", " BUT ", " but the but of", "!!!!!!", "?"]


def _dressed(spark, sf):
    d = S.table(spark, sf, "documents")
    k = F.col("doc_id") % 10
    pick = lambda xs: F.element_at(F.lit(xs), (k + 1).cast("int"))
    return d.select("doc_id", F.concat(pick(_BEFORE), F.substring("text", 1, 40), F.when(k > 5, " but ").otherwise(""),
                                       "text", pick(_AFTER)).alias("t"))


def _sql_list(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _before(flag, by, other):
    """Sum or product over the three tokens before, as windows over (row, position)."""
    return by.join(f"(CASE WHEN lag({flag}, {d}) OVER w THEN {other(d)} ELSE {'0.0' if by == ' + ' else '1.0'} END)" for d in (1, 2, 3))


@query("rule_polarity", f"""
WITH {_LEXICON_SQL},
x AS (SELECT doc_id, {_sql_list(_BEFORE)}[doc_id % 10 + 1] || substring(text, 1, 40) || CASE WHEN doc_id % 10 > 5 THEN ' but ' ELSE '' END
             || text || {_sql_list(_AFTER)}[doc_id % 10 + 1] AS t FROM documents),
b AS (SELECT doc_id, t, list_filter(list_transform(regexp_split_to_array(t, '\\s+'),
             lambda w: regexp_replace(w, '^[^\\pL\\pN]+|[^\\pL\\pN]+$', '', 'g')), lambda w: w <> '') AS ws FROM x),
k AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS raw, generate_subscripts(ws, 1) AS i FROM b),
c AS (SELECT *, lower(raw) AS word, regexp_matches(raw, '\\p{{Lu}}') AND raw = upper(raw) AS cap,
             list_contains({_sql_list(LX.BOOSTERS)}, lower(raw)) AS up, list_contains({_sql_list(LX.DAMPENERS)}, lower(raw)) AS down,
             list_contains({_sql_list(LX.NEGATIONS)}, lower(raw)) OR lower(raw) LIKE '%n''t' AS neg FROM k),
s AS (SELECT *, count(*) FILTER (WHERE cap) OVER (PARTITION BY doc_id) BETWEEN 1 AND n - 1 AS mixed,
             coalesce(min(i) FILTER (WHERE word = 'but') OVER (PARTITION BY doc_id), 0) AS but FROM c),
e AS (SELECT *, CASE WHEN mixed AND cap THEN {LX.CAPITALS} ELSE 0.0e0 END AS emph FROM s),
m AS (SELECT doc_id, word, emph
        + {_before("up", " + ", lambda d: f"{LX.DECAY[d - 1]}e0 * ({LX.BOOST} + lag(emph, {d}) OVER w)")}
        - ({_before("down", " + ", lambda d: f"{LX.DECAY[d - 1]}e0 * ({LX.BOOST} + lag(emph, {d}) OVER w)")}) AS adds,
        {_before("neg", " * ", lambda d: f"{LX.NEGATED}e0")}
        * CASE WHEN but = 0 OR i = but THEN 1.0e0 WHEN i < but THEN {LX.BEFORE_BUT}e0 ELSE {LX.AFTER_BUT}e0 END AS times
      FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
v AS (SELECT doc_id, (valence * 8 - 4 + sign(valence * 8 - 4) * adds) * times AS v FROM m JOIN lex USING (word)),
g AS (SELECT doc_id, sum(v) AS s, coalesce(sum(v + 1) FILTER (WHERE v > 0), 0) AS up, coalesce(sum(1 - v) FILTER (WHERE v < 0), 0) AS down,
             count(*) FILTER (WHERE v <> 0) AS scored FROM v GROUP BY doc_id),
q AS (SELECT doc_id, len(ws) AS n, least(length(t) - length(replace(t, '!', '')), {LX.EXCLAMATIONS}) * {LX.EXCLAMATION}e0
             + CASE WHEN length(t) - length(replace(t, '?', '')) <= 1 THEN 0 WHEN length(t) - length(replace(t, '?', '')) <= {LX.QUESTIONS}
                    THEN (length(t) - length(replace(t, '?', ''))) * {LX.QUESTION}e0 ELSE {LX.MANY_QUESTIONS} END AS e FROM b),
r AS (SELECT doc_id, n - coalesce(scored, 0) AS flat, coalesce(up, 0) + CASE WHEN up > down THEN e ELSE 0 END AS up,
             coalesce(down, 0) + CASE WHEN up < down THEN e ELSE 0 END AS down, coalesce(s + sign(s) * e, 0) AS s FROM q LEFT JOIN g USING (doc_id))
SELECT doc_id, round(coalesce(down / nullif(flat + up + down, 0), 0), 6) AS neg, round(coalesce(flat / nullif(flat + up + down, 0), 0), 6) AS neu,
       round(coalesce(up / nullif(flat + up + down, 0), 0), 6) AS pos, round(s / sqrt(s * s + {LX.ALPHA}), 6) AS compound FROM r
""")
def rule_polarity(spark, sf):
    """Polarity of documents with negations, boosters, capitals, a second "but"
    and marks around them; word scores are mean labels spread over -4 to 4."""
    lex = _lexicon(spark, sf).select("word", (F.col("valence") * 8 - 4).alias("score"))
    p = LX.rule_polarity(_dressed(spark, sf), "doc_id", "t", lex)
    return p.select("doc_id", *[r6(F.col(c)).alias(c) for c in ["neg", "neu", "pos", "compound"]])
