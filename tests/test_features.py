"""Engineered features of the classifiers, on rows built here."""
import re

from pyspark.sql import functions as F

from convgraph.operators import features as FT
from convgraph.plans import q_models as Q
from convgraph.plans import standins as S

TEXTS = ["The cat sat, quickly; running 42 dogs -- ok?", None, "", "de la Vie estK 7e8 \U0001f600!", "of a cat cat The"]


def _texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(0, "cat zebra")], "id long, text string")


def test_lexicon_scores_by_frequency_equal_the_plain_join(spark):
    df = _texts(spark)
    lex = FT.word_lexicon(df, "text", frequency="n")
    want = sorted(map(tuple, FT.lexicon_scores(df, "id", "text", FT.word_lexicon(df, "text")).collect()))
    for head in (0, 1, 3, 1000):  # no word, some and all words in the broadcast part
        got = FT.lexicon_scores(df, "id", "text", lex, frequency="n", min_len=3, head_words=head).collect()
        assert [[round(x, 12) for x in r] for r in sorted(map(tuple, got))] == [[round(x, 12) for x in r] for r in want]


def test_tags_follow_the_rules_in_order(spark):
    rows = FT.pos_histogram(_texts(spark), "id", "text").collect()
    assert len(rows) == len(TEXTS) + 1  # one per row; rows of one id count together

    def tag(tok):
        for t, kind, arg in FT.TAG_RULES:
            by_case = t in ("PROPN", "NOUN", "SYM", "SPACE", "NUM")
            if (tok.lower() in arg) if kind == "in" else re.search(arg, tok if by_case else tok.lower(), re.ASCII):
                return t
        return "X"
    for r in rows:
        text = " ".join(t for i, t in [*enumerate(TEXTS), (0, "cat zebra")] if i == r.id and t)
        tags = [tag(tok) for tok in re.findall(FT.TOKEN_PATTERN, text, re.ASCII)]
        assert {t: r["POS_" + t] for t in FT.POS_TAGS} == {t: tags.count(t) for t in FT.POS_TAGS}


def test_context_features_take_one_pass_and_keep_splits_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "before one"), (2, "alpha Beta"), (2, "alpha gamma 12"), (3, "after three")],
                                 "doc_id long, text string")
    split = (docs.filter("doc_id = 2").withColumnRenamed("doc_id", "id")
                 .withColumn("split", F.when(F.col("text").contains("gamma"), "val").otherwise("train"))
                 .withColumns({l: F.lit(0) for l in Q.LAB}))
    monkeypatch.setattr(S, "table", lambda *a: docs)
    rows = {r.split: r for r in Q._with_features(spark, "", split).collect()}
    assert set(rows) == {"train", "val"}
    assert rows["train"].text_and_context == "before one alpha Beta after three"
    assert rows["val"].text_and_context == "before one alpha gamma 12 after three"
    assert (rows["train"].POS_NUM, rows["val"].POS_NUM) == (0, 1)  # not the tokens of the other split's row
    assert rows["train"].POS_PROPN == 1 and rows["val"].POS_PROPN == 0
    assert rows["train"].valence != rows["val"].valence


def test_lexicon_is_built_once_for_all_splits(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(FT, "word_lexicon", lambda *a, f=FT.word_lexicon, **k: passes.append(a) or f(*a, **k))
    row, = Q.context_classifier(spark, "/root/testdata/sf0.001").collect()
    assert row.is_best and len(passes) == 1
