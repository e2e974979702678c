"""Lexicon joins with hot words, polarity rules and the emoji grammar."""
import math

import pytest
from pyspark.sql import functions as F

from convgraph.functions import text as X
from convgraph.operators import lexicons as LX

LEXICON = {"good": 2.0, "great": 3.0, "bad": -2.5, "awful": -3.0, "flat": 0.0}


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(list(LEXICON.items()), "word string, score double")


def _polarity(spark, lexicon, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    return [r for r in LX.rule_polarity(df, "id", "t", lexicon, **kw).orderBy("id").collect()]


def _compound(s):
    return s / math.sqrt(s * s + 15)


RULES = [
    ("a good day", 2.0), ("a GOOD day", 2.733), ("GOOD", 2.0), ("A GOOD DAY", 2.0), ("very good", 2.293), ("VERY good", 2.293 + 0.733),
    ("slightly bad", -2.5 + 0.293), ("very x good", 2 + 0.293 * 0.95), ("very x y good", 2 + 0.293 * 0.9), ("very x y z good", 2.0),
    ("not good", -1.48), ("isn't x y good", -1.48), ("not a b c good", 2.0), ("never not good", 2 * 0.74 ** 2),
    ("not very good", -0.74 * 2.293), ("good but bad", 2 * 0.5 - 2.5 * 1.5), ("good but bad but great", 1.0 - 3.75 + 4.5),
    ("(good)!", 2 + 0.292), ("bad!!!!!!", -2.5 - 4 * 0.292), ("good ?", 2.0), ("good ??", 2.36), ("good ????", 2.96), ("flat x", 0.0)]


def test_rules(spark, lexicon):
    got = {t: r.compound for (t, _v), r in zip(RULES, _polarity(spark, lexicon, [t for t, _v in RULES]))}
    assert got == pytest.approx({t: _compound(v) for t, v in RULES}, abs=1e-12)


def test_shares_and_rows_without_words(spark, lexicon):
    a, b, c, d = _polarity(spark, lexicon, ["good bad x y", None, " !? ", "good!"])
    assert (a.pos, a.neg, a.neu) == pytest.approx((3 / 8.5, 3.5 / 8.5, 2 / 8.5))
    assert all((r.pos, r.neg, r.neu, r.compound) == (0, 0, 0, 0) for r in (b, c))
    assert (d.pos, d.neg, d.neu) == (1.0, 0.0, 0.0)


@pytest.mark.parametrize("share", [1, 3, 10 ** 6])
def test_hot_words_do_not_change_the_result(spark, lexicon, share):
    texts = ["good x bad the"] * 20 + ["great awful the"] * 3 + ["", "nothing here"]
    assert _polarity(spark, lexicon, texts, share=share) == _polarity(spark, lexicon, texts)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = [tuple(r) for r in LX.lexicon_means(df, "id", F.split("t", " "), lexicon, ["score"], 0.25, share).orderBy("id").collect()]
    assert got == [(i, -0.25 if i < 20 else 0.0 if i < 23 else 0.25) for i in range(25)]


def test_number_of_hot_words_is_bounded(spark):
    tokens = spark.range(2000).select(F.concat(F.lit("w"), F.sqrt("id").cast("int")).alias("word"))
    counts = {r.word: r["count"] for r in tokens.groupBy("word").count().collect()}
    for share in (1, 5, 40):
        hot = [r.word for r in LX.hot_words(tokens, share=share).collect()]
        assert len(hot) <= share and sorted(hot) == sorted(w for w, n in counts.items() if n * share >= 2000)


def test_a_hot_word_is_not_shuffled_by_itself(spark, lexicon):
    """A word in every row: the join by shuffle gets none of its rows."""
    df = spark.range(1000).select("id", F.lit("good x").alias("t"))
    tokens = df.select("id", F.explode(F.split("t", " ")).alias("word"))
    hot = {r.word for r in LX.hot_words(tokens).collect()}
    assert hot == {"good", "x"} and LX.lookup(tokens, lexicon).count() == 1000


@pytest.mark.parametrize("text,emojis", [
    ("🇫🇷🇩🇪🇫 x", ["🇫🇷", "🇩🇪"]), ("👇🏿🤦🏼♀🤷♀Some emojis 🧀🍷🇫🇷", ["👇🏿", "🤦🏼♀", "🤷♀", "🧀", "🍷", "🇫🇷"]), ("☆✓🂡1#*€", []),
    ("🃏♀🏿™©", ["🃏♀", "🏿", "™", "©"]), ("", []), (None, None)])
def test_emoji_grammar(spark, text, emojis):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.extract_emojis("t")).head()[0] == emojis
    kept = df.select(X.keep_ascii_and_emoji("t")).head()[0]
    assert text is None or kept == "".join(c for c in text if c.isascii() or c not in "☆✓🂡€")


def test_word_ends_in_one_pass(spark):
    texts = ["--a-- b", "a--b ... --", " 'it's' (x)! ,", "", "é«à» \u2028z\u2028", "...", "-1- +2+\n\t¿q?", "a" + "-" * 500 + "b"]
    old = F.filter(F.transform(F.split("t", r"[\s]+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: w != "")
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    assert all(r.a == r.b for r in df.select(LX._tokens(F.col("t")).alias("a"), old.alias("b")).collect())
    plan = df.select(LX._tokens(F.col("t")).alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan  # no expression of its own for every word
