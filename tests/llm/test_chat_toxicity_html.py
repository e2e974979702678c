"""Chat windows (round trip), toxicity (held-out accuracy), HTML extraction
(gradients, accuracy on composed and given pages) and the pipeline."""
import hashlib
import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from convgraph.llm import chat_windows as C
from convgraph.llm import html_lstm as H
from convgraph.llm import toxicity_chain as T
from convgraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------ chat

CHAT = "conv_id long, turn long, role string, text string, formatted string, segment long"


def conversations(seed=3):
    rnd = random.Random(seed)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|user|>\n", "\\", "<\\/s>", "[\\\\INST]", "<", "[",
            " word", " é", "\n", "|>", "ok "]
    rows = []
    for c in range(30):
        if c % 3 == 0:
            rows.append((c, 0, "system", "be kind " * rnd.randint(1, 60)))
        for t in range(1, rnd.randint(2, 60)):
            rows.append((c, t, ("user", "assistant")[t % 2 == 0], "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40)))))
    rows += [(50, 1, "assistant", "word " * 5000), (50, 2, "user", "after"), (50, 3, "assistant", "end"),
             (51, 1, None, None), (51, None, "assistant", "last"), (51, 1, "tool|>\n", "x"), (51, 1, "tool|>\n", "x"),
             (None, 1, "user", "a"), (None, 2, "assistant", "b")]
    rows += [(60, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(500)]
    return rows


def expected_chat(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((float("inf") if t is None else t, r or "", x or ""))
    out = []
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        out.append((c, len(ts), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest(),
                    len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def chat_frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], CHAT)


@pytest.mark.parametrize("settings", [{}, {"budget": 120, "history_tokens": 60, "segment": 8},
                                      {"budget": 40, "history_turns": 0}, {"budget": 300, "history_turns": 3}])
def test_chat_round_trip(spark, settings):
    rows = conversations()
    windows = C.chat_windows(chat_frame(spark, rows), **settings).cache()
    got = sorted((tuple(r)[:5] for r in C.read_back(windows).collect()), key=repr)
    assert got == expected_chat(rows)
    budget = settings.get("budget", C.BUDGET)
    starts_with_system = {c for c, t, r, _ in rows if t == 0 and r == "system"}
    for w in windows.collect():
        turns = C.parse(w.formatted)
        new = w.n_turns - w.n_repeated
        assert w.n_tokens <= budget or new == 1 or (w.window == 0 and new == 2)  # one turn, or system + one
        assert (turns[0][0] == "system") == (w.conv_id in starts_with_system)
        assert w.n_repeated <= settings.get("history_turns", C.HISTORY_TURNS) + 1
        assert [w.formatted[a:b] for a, b in zip(w.loss_start, w.loss_end)] == \
            [C.escape(x) for r, x in turns[w.n_repeated:] if r == "assistant"]


def test_chat_empty(spark):
    assert C.read_back(C.chat_windows(chat_frame(spark, []))).collect() == []


def test_escape_is_reversible_and_hides_controls():
    rnd = random.Random(1)
    for _ in range(3000):
        t = "".join(rnd.choice(["<", "[", "\\", "/", "s>", "INST]", "SYS>>", "|", "x", "<|", "</s>"]) for _ in range(8))
        e = C.escape(t)
        assert C.unescape(e) == t
        assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", e)


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    got = sorted((tuple(r)[:5] for r in QUERIES["op9_chat_windows"](spark, SF).collect()), key=repr)
    assert got == expected_chat(rows)


# ------------------------------------------------------------ toxicity

def toxic_rows(n=600, seed=2):
    rnd = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ta", "ri", "lo", "mun", "fe") for b in ("sen", "dor", "vi", "gal", "pim", "ro")]
    bad = {"en": ["idiot", "scum"], "fr": ["vequ" + x for x in ("eur", "is", "ta", "mo")]}
    docs, labels = [], []
    for i in range(n):
        lang = rnd.choice(["en", "fr"])
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad[lang]))
        docs.append((i, " ".join(words), lang, "s", len(words), 0.0))
        labels.append((i, 1, int(toxic)))
    return docs, labels


DOCS = "doc_id long, text string, lang string, source string, n_chars long, toxic_probability double"


def test_toxicity_held_out(spark):
    docs, labels = toxic_rows()
    seen = [x for x in labels if x[0] < 400] + [(1, 1, None), (None, 1, 1)]
    d = spark.createDataFrame(docs + [(900, None, None, None, None, None), (901, "", "en", None, 0, None),
                                      (902, "lo " * 100_000 + "scum idiot", "en", None, 0, None), (None, "talk", "fr", None, 0, None)], DOCS)
    lab = spark.createDataFrame(seen, "doc_id long, quality int, toxic int")
    model = T.fit(d, lab)
    assert model["categories"] == ["toxic:en", "toxic:fr", "toxic"] or model["categories"] == ["toxic:fr", "toxic:en", "toxic"]
    out = {r.doc_id: r for r in T.score(d, model).collect()}
    assert len(out) == len(docs) + 4
    truth = {i: t for i, _, t in labels if i >= 400}
    assert all(out[i].kept for i, t in truth.items() if not t)
    caught = [not out[i].kept for i, t in truth.items() if t]
    assert sum(caught) >= 0.95 * len(caught)
    assert out[900].kept and out[901].kept and out[None].kept and not out[902].kept
    assert set(out[0].categories) == set(model["categories"])


def test_toxicity_without_both_classes(spark):
    d = spark.createDataFrame(toxic_rows(20)[0], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = T.fit(d, none)
    assert [r.toxic_probability for r in T.score(d, model).collect()] == [0.0] * 20
    assert T.score(d.limit(0), model).collect() == []


def test_chain_uses_out_of_fold_links():
    rng = np.random.default_rng(0)
    x = (rng.random((300, 6)) < 0.3).astype(float)
    y0 = x[:, 0] * (rng.random(300) < 0.8)
    y1 = np.maximum(y0, x[:, 1])
    models, held = T.fit_chain(x, np.stack([y0, y1], 1), rng.integers(0, 5, 300))
    assert [len(m) for m in models] == [7, 8]  # the second link sees the first one's probability
    assert held.shape == (300, 2) and 0 < held.min() and held.max() < 1
    assert ((held[:, 1] > 0.5) == (y1 > 0)).mean() > 0.85


def test_toxicity_on_given_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op10_toxicity_chain"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    clean, bad = [r for r in out if r.toxic == 0], [r for r in out if r.toxic == 1]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)
    assert sum(not r.kept for r in bad) >= 0.85 * len(bad)


# ------------------------------------------------------------ HTML

def article_text(page):
    """The text of the article element, block by block, by plain splitting."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S).group(1)
    parts = re.split(r"</?(?:p|h1|br|article)>", inner)
    texts = (" ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", "", p)).split()) for p in parts)
    return " ".join(t for t in texts if t)


def test_extract_given_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = QUERIES["op3_html_lstm"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    right = [r.text == article_text(pages[r.page_id].html) for r in got]
    assert sum(right) >= 0.99 * len(right)
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)


def trained(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").limit(60).collect()]
    return H.train(pages, composed=300)


def test_extract_edges_and_composed_pages(spark):
    model = trained(spark)
    rng = np.random.default_rng(77)
    words = [f"w{i}" for i in range(300)]
    texts = [H.compose(rng, words) for _ in range(120)]
    ex = H.Extractor(model)
    kept = right = 0
    for page, labels in texts:
        blocks = H.leaf_blocks(page)
        assert len(blocks) == len(labels)
        got = ex([page])[0]
        want = " ".join(t for (_, t, _), y in zip(blocks, labels) if y)
        kept += sum(labels)
        right += got == want
    assert right >= 0.6 * len(texts)
    schema = "page_id long, url string, html string, text string, n_chars long"
    rows = [(1, "u", None, "x", 1), (2, None, "", "x", 1), (3, "u", "<p", "x", 1), (4, "u", "<!-- never closed <p>a", "x", 1),
            (5, "u", "<article><p>Big &amp; small. " + "word " * 200_000 + "</p></article>", "x", 1), (None, "u", "plain", "x", 1),
            (5, "u", "<script>var t='<p>';", "x", 1)]
    out = H.extract(spark.createDataFrame(rows, schema), model=model)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {(r.page_id, r.n_chars > 1000): r.text for r in out.collect()}
    assert len(out.collect()) == len(rows)
    assert got[(1, False)] == got[(2, False)] == got[(3, False)] == got[(4, False)] == ""
    assert H.extract(spark.createDataFrame([], schema)).collect() == []


def test_blocks_of_broken_markup():
    page = ("<p>a<b>b<br>c<p title='x>y'>d &lt;e&gt;&nbsp; f<script>if(a<b){'</p>'}</script>g"
            "<li>1<li>2<a href=z>k</a></ul>x<!-- <p>no</p> -->y")
    assert [t for _, t, _ in H.leaf_blocks(page)] == ["ab", "c", "d <e> f", "g", "1", "2k", "xy"]
    assert H.leaf_blocks("<li>go <a href=z>kk</a>")[0][2] == 2


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = H.BiLSTM(5, 3, seed=2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = rng.standard_normal((4, 2, 5)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    y = (rng.random((4, 2)) < 0.5).astype(float)

    def loss():
        p = net.predict(x, mask)
        return -(np.where(mask, y * np.log(p) + (1 - y) * np.log(1 - p), 0)).sum() / mask.sum()
    grads = net.gradients(x, mask, y)
    for k in net.p:
        flat = net.p[k].reshape(-1)
        for i in rng.integers(0, flat.size, 4):
            old, eps = flat[i], 1e-3
            flat[i] = old + eps
            up = loss()
            flat[i] = old - eps
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * eps) - grads[k].reshape(-1)[i]) < 5e-4, k


def test_long_pages_are_read_in_chunks(monkeypatch):
    net = H.BiLSTM(H.PATH_DIM + H.WORD_DIM + H.MEASURES, 4, seed=1)
    ex = H.Extractor(net)
    blocks = [(("p",), f"text {i}.", 0) for i in range(57)]
    x, mask = H.padded([ex.features(blocks)])
    whole = net.predict(x, mask)[:, 0]
    monkeypatch.setattr(H, "CHUNK_BLOCKS", 10)
    assert np.allclose(ex.long_page(blocks), whole, atol=1e-5)


# ------------------------------------------------------------ pipeline

def test_pipeline_stages(spark):
    """Each stage against brute force over its own input."""
    import corpus_pipeline as P
    from test_dedup_and_rules import expected_components, expected_substrings
    from test_native_and_tokens import check_packing, norm
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, at = docs.columns, {}
    for name, fn in P.STAGES:
        before = docs.collect()
        docs = P.stored(fn(spark, docs, sf), f"test-{name}")
        at[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns
    before, after = at["toxicity"]
    tox = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert sum(tox.get(i) == 0 for i in gone) <= 0.02 * len(before) and after
    before, after = at["exact_dedup"]
    first = {}
    for r in before:
        first[norm(r.text)] = min(first.get(norm(r.text), r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(first.values())
    before, after = at["near_dedup"]
    want = expected_components([(r.doc_id, r.text) for r in before], 80)
    assert sorted(r.doc_id for r in after) == sorted(r[0] for r in want if r[3])
    before, after = at["substring_dedup"]
    text = {r.doc_id: r.text for r in before}
    want = {i: (k if gone else text[i]) for i, _, gone, k in expected_substrings([(r.doc_id, r.text) for r in before])
            if not gone or k}
    assert {r.doc_id: r.text for r in after} == want
    before, after = at["packing"]
    check_packing(after, [(r.doc_id, r.text) for r in before])
