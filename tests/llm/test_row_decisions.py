"""The first stages of the pipeline decide row by row, also among rows whose id
is null or repeated."""
import random

from convgraph.llm import toxicity_chain as T
from convgraph.llm.exact_dedup import keep_first
from convgraph.llm.minhash_hamming import keep_one
from test_chat_toxicity_html import DOCS, toxic_rows


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, None) for i, t, s in rows], DOCS).repartition(4)


def left(df):
    return sorted((r.source for r in df.collect()))


def test_toxic_rows_go_whatever_their_id(spark):
    docs, labels = toxic_rows()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    clean, bad = "talo ri lodor munvi", "talo scum idiot munvi scum"
    extra = [(None, clean, "null clean"), (None, bad, "null toxic"), (None, bad, "null toxic 2"), (None, None, "null text"),
             (9001, clean, "9001 clean"), (9001, bad, "9001 toxic")]
    d = spark.createDataFrame(docs, DOCS).unionByName(documents(spark, extra))
    out = T.keep_clean(d, lab)
    assert out.columns == d.columns
    got = out.collect()
    assert sorted(r.source for r in got if r.source != "s") == ["9001 clean", "null clean", "null text"]
    assert all(r.text is None for r in got if r.source == "null text")
    kept = {r.doc_id for r in T.score(spark.createDataFrame(docs, DOCS), T.fit(d, lab)).where("kept").collect()}
    assert {r.doc_id for r in got if r.source == "s"} == kept


def test_exact_copies_go_whatever_their_id(spark):
    rows = [(3, "a b", "3"), (8, "a  b", "8 copy"), (8, "other", "8 other"), (8, "other", "8 other again"),
            (None, "a\tb", "null copy of 3"), (None, "alone", "null alone"), (None, "twice", "null twice"),
            (None, "twice ", "null twice with a space"), (None, "twice", "null twice"), (None, "twice", "null twice")]
    out = keep_first(documents(spark, rows))
    assert out.columns == documents(spark, rows).columns
    got = left(out)
    assert [s for s in got if "twice" not in s] == ["3", "8 other", "8 other again", "null alone"]
    assert [s for s in got if "twice" in s] == ["null twice", "null twice with a space"]  # two texts
    assert got == left(keep_first(documents(spark, rows[::-1])))


def test_near_copies_go_whatever_their_id(spark):
    rnd = random.Random(5)

    def words(n=100):
        return [f"w{rnd.randint(0, 5000)}" for _ in range(n)]

    def near(w):
        return " ".join([*w[:-1], "edit"])
    a, b, c, alone = words(), words(), words(), words()
    rows = [(3, " ".join(a), "3"), (8, near(a), "8 near 3"), (8, " ".join(b), "8 b"), (8, " ".join(b), "8 b"),
            (9, near(b), "9 near 8"), (None, near(a), "null near 3"), (None, " ".join(a), "null copy of 3"),
            (None, " ".join(c), "null c"), (None, near(c), "null c"), (None, " ".join(c), "null c"),
            (None, " ".join(alone), "null alone"), (None, "", "no words"), (None, None, "no words"), (4, " ", "no words")]
    out = keep_one(documents(spark, rows))
    assert out.columns == documents(spark, rows).columns
    got = left(out)
    assert got == ["3", "8 b", "8 b", "no words", "no words", "no words", "null alone", "null c"]
    clear = [(i, t, s) for i, (_, t, s) in enumerate(rows)]
    assert left(keep_one(documents(spark, clear))) == [
        "3", "8 b", "no words", "no words", "no words", "null alone", "null c"]


def test_a_sampled_id_counts_once_however_often_it_occurs(spark, monkeypatch):
    docs, labels = toxic_rows(100)
    hot = [(i, f"{t} only{j}", "en", None, None, None) for i, t, *_ in docs[:2] for j in range(200)]
    sizes = []
    fit = T.fit_chain
    monkeypatch.setattr(T, "fit_chain", lambda x, *a: sizes.append(len(x)) or fit(x, *a))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = spark.createDataFrame(docs + hot, DOCS)
    one, other = (T.fit(x, lab, toxic_rows=10, clean_rows=30) for x in (d.repartition(4), d.orderBy("text")))
    assert sizes[0] <= 40 and sizes[0] == sizes[1]
    assert one["features"] == other["features"] and one["threshold"] == other["threshold"]
