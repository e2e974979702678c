"""Sources, sinks and the streaming adapter on hand-made records (the
synthetic tables hold no raw posts)."""
import io
import json
import os
import zipfile

from pyspark.sql import functions as F

from convgraph.sources import io as SIO
from convgraph.sources import posts as P

V1 = [
    {"api": "v1", "lang": "en", "id_str": "1", "text": "RT @bob: hello…", "truncated": False,
     "created_at": "Wed Oct 10 20:19:24 +0000 2018", "topics": ["t1"],
     "retweeted_status": {"id_str": "9", "text": "hello short", "extended_tweet": {"full_text": "hello full"}},
     "in_reply_to_status_id_str": "7",
     "quoted_status": {"id_str": "8", "lang": "en", "text": "quoted", "truncated": False,
                       "created_at": "Wed Oct 10 20:00:00 +0000 2018"},
     "user": {"id": "u1", "screen_name": "alice", "followers_count": 3, "statuses_count": 4},
     "entities": {"hashtags": [{"text": "Tag"}], "symbols": [], "user_mentions": [{"screen_name": "bob"}]},
     "retweet_count": 1, "reply_count": 2, "favorite_count": 3, "quote_count": 4},
    {"api": "v1", "lang": "fr", "id_str": "2", "text": "bonjour", "truncated": False},
]
V2 = [
    {"api": "v2", "lang": "en", "id": "3", "text": "plain v2", "created_at": "2023-10-01T06:00:00.000Z",
     "topics": [], "referenced_tweets": [{"id": "1", "type": "replied_to",
                                          "tweet": {"text": "ctx", "lang": "en", "created_at": "2023-10-01T05:00:00.000Z"}},
                                         {"id": "9", "type": "retweeted", "tweet": {"text": "rt text", "lang": "en"}}],
     "user": {"id": "u2", "username": "carol", "public_metrics": {"followers_count": 5, "tweet_count": 6}},
     "entities": {"hashtags": [{"tag": "x"}], "mentions": [{"username": "dan"}]},
     "public_metrics": {"retweet_count": 7, "reply_count": 8, "like_count": 9, "quote_count": 10}},
]


def _write(dir_, name, recs):
    with open(os.path.join(dir_, name), "w") as f:
        json.dump(recs, f)


def test_normalise_two_generations(spark, tmp_dir):
    _write(tmp_dir, "a.json", V1)
    _write(tmp_dir, "b.json", V2)
    _write(tmp_dir, "statistics.json", [{"api": "v1", "lang": "en", "id_str": "999"}])
    posts = {r["id"]: r for r in P.normalise(P.read_json_dir(spark, tmp_dir)).collect()}
    assert set(posts) == {"1", "3"}
    p1, p3 = posts["1"], posts["3"]
    assert p1["text"] == "hello full" and p1["is_retweet"] and p1["retweet_id"] == "9"
    assert [c["context_type"] for c in p1["context"]] == ["quoted", "replied_to"]
    assert p1["context"][1]["context_text"] is None
    assert p1["hashtags"] == ["Tag"] and p1["cashtags"] == [] and p1["mentions"] == ["bob"]
    assert p1["like_count"] == 3 and p1["origin_file"] == "a.json"
    assert p3["text"] == "rt text" and p3["is_retweet"] and p3["retweet_id"] == "9"
    assert [(c["context_id"], c["context_type"], c["context_text"]) for c in p3["context"]] == [("1", "replied_to", "ctx")]
    assert p3["username"] == "carol" and p3["followers"] == 5 and p3["like_count"] == 9


def test_archives_and_timestamps(spark, tmp_dir):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("data/a.json", json.dumps(V1))
        z.writestr("data/statistics.json", json.dumps({"n": 1}))
    with open(os.path.join(tmp_dir, "x.zip"), "wb") as f:
        f.write(buf.getvalue())
    raw = P.read_json_archives(spark, os.path.join(tmp_dir, "*.zip"))
    assert raw.count() == 2
    ts = spark.createDataFrame([("Wed Oct 10 20:19:24 +0000 2018",), ("2023-10-01T06:00:00.000Z",)], "t string")
    got = [r[0] for r in ts.select(P.parse_mixed_timestamp("t").cast("string")).collect()]
    assert got[0].startswith("2018-10-10 20:19:24") and got[1].startswith("2023-10-01 06:00:00")


def test_tuple_literals_and_jsonl(spark, tmp_dir):
    df = spark.createDataFrame([("('a', 'b')",), ("()",), ("plain",)], "t string")
    assert [r[0] for r in df.select(SIO.parse_tuple_literal("t")).collect()] == [["a", "b"], [], None]
    data = spark.createDataFrame([(1, "x", [1, 0])], "id long, text string, v array<int>")
    path = os.path.join(tmp_dir, "out.jsonl")
    SIO.write_jsonl(data, path)
    back = SIO.read_jsonl(spark, path, "id long, text string, v array<int>").collect()
    assert [tuple(r) for r in back] == [(1, "x", [1, 0])]


def test_graphml_and_pajek(spark, tmp_dir):
    nodes = spark.createDataFrame([(1, "a<b"), (2, "c")], "id long, text string")
    edges = spark.createDataFrame([(1, 2, "quoted")], "src long, dst long, context_type string")
    path = os.path.join(tmp_dir, "g")
    SIO.write_graphml(SIO.graphml_lines(nodes, edges, ["text"], ["context_type"]), path)
    text = "\n".join(r[0] for r in spark.read.text(path).collect())
    assert "a&lt;b" in text and '<edge source="1" target="2">' in text
    pj = [r["value"] for r in SIO.pajek_lines(nodes, edges).orderBy("_part", "_k").collect()]
    assert pj == ["*Vertices 2", '1 "1"', '2 "2"', "*Arcs", "1 2"]


def test_metrics_tree_fallback(spark, tmp_dir):
    from convgraph.operators import runs as RU
    for model, run, rec in [("m_with_context_VADER", "run_1", {"f1": 0.5, "precision": 0.4, "recall": 0.3, "accuracy": 0.2}),
                            ("m_POS", "run_1", {"test_f1": 0.0, "f1": 0.6, "precision": 0.1, "recall": 0.1, "accuracy": 0.1})]:
        os.makedirs(os.path.join(tmp_dir, model, run))
        with open(os.path.join(tmp_dir, model, run, "test_metrics.json"), "w") as f:
            json.dump(rec, f)
    m = RU.read_metrics_tree(spark, tmp_dir).select("model_dir", "run", RU.metric_fallback("test_f1", "f1").alias("f1"),
                                                    *RU.path_flags("model_dir"))
    got = {r["model_dir"]: r for r in m.collect()}
    assert abs(got["m_POS"]["f1"] - 60.0) < 1e-9 and got["m_POS"]["pos"] and not got["m_POS"]["context"]
    assert got["m_with_context_VADER"]["context"] and got["m_with_context_VADER"]["sentiment_scores"]


def test_stream_cleans_new_files(spark, tmp_dir):
    from convgraph.streaming import posts_stream as ST
    inp = os.path.join(tmp_dir, "in")
    os.makedirs(inp)
    _write(inp, "a.json", V1)
    q = ST.start(spark, inp, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(tmp_dir, "out")).collect()
    assert [(r["id"], r["clean_text"]) for r in out] == [("1", "hello full")]


def test_csv_roundtrip_annotations_lexicon_selected(spark, tmp_dir):
    df = spark.createDataFrame([(1, 'say "hi"\nthere', 0), (2, "plain", 1)], "new_id long, text string, lab int")
    for split in ("train", "val", "test"):
        SIO.write_csv(df, os.path.join(tmp_dir, split))
    back = SIO.read_split_csvs(spark, [os.path.join(tmp_dir, s) for s in ("train", "val", "test")],
                               "new_id long, text string, lab int")
    assert back.count() == 6 and back.filter(F.col("text") == 'say "hi"\nthere').count() == 3
    ann = spark.createDataFrame([(7, "2024", 11, '{"choices":["a"]}')], "annotation_id long, created_at string, new_id long, fallacy string")
    SIO.write_csv(ann, os.path.join(tmp_dir, "ann"))
    a = SIO.read_annotations(spark, os.path.join(tmp_dir, "ann"))
    assert a.columns == ["new_id", "fallacy"] and a.first()["new_id"] == "11"
    with open(os.path.join(tmp_dir, "lex.txt"), "w") as f:
        f.write("good\t0.9\t0.1\t0.3\nbad\t0.1\t0.8\t0.2\n")
    assert SIO.read_lexicon(spark, os.path.join(tmp_dir, "lex.txt")).count() == 2
    sel = {"selected_hashtags": spark.createDataFrame([("b",), ("a",)], "element string"),
           "selected_mentions": spark.createDataFrame([("m",)], "element string")}
    SIO.write_selected_elements(spark, sel, os.path.join(tmp_dir, "sel"))
    row = SIO.read_selected_elements(spark, os.path.join(tmp_dir, "sel"), list(sel)).first()
    assert row["selected_hashtags"] == ["a", "b"] and row["selected_mentions"] == ["m"]
    staged = SIO.write_stage(df, os.path.join(tmp_dir, "stage"))
    assert staged.count() == 2
