"""Base rules against plain regular expressions, disclosure against brute force."""
import math
import random
import re
import time

import pytest
from hypothesis import given, settings, strategies as st

from convgraph.llm import disclosure as D

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m.group().split("."))
            elif kind == "card":
                doubled = [sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
                ok = 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
            else:
                ok = kind == "email" or 8 <= len(digits) <= 15
            if ok:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aZ0129.@+- ()%_٣é\n", max_size=60))
def test_base_rules_equal_the_expressions(text):
    assert [x[:3] for x in D.base_spans(text)] == plain(text)


def test_base_rules_on_planted_texts():
    rng = random.Random(2)
    bits = ["4539578763621486", "4539 5787 6362 1486", "4539-5787-6362-1486", "6011000990139424", "1234567890123456", "10.0.0.255",
            "256.1.1.1", "1.2.3.4.5.6.7.8", "a.b+c@x-y.co.uk", "a@b", "@x.y", "a@b@c.d.", "+1 (017) 555-7713", "+49 30 1", "+1(2)",
            "0004539578763621486", "٣.٣.٣.٣", "x", " ", ",", "\n", "+", "...", "00000000000000000000255.1.1.1"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(1, 8)))
        assert [x[:3] for x in D.base_spans(text)] == plain(text), text


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" + " " * 300_000, "+1 " * 100_000,
                                  "1 " * 150_000, "a.b@" + "c-" * 150_000, "x" * 200_000 + "@" + "y" * 100_000, "1.1.1" + "1" * 299_000])
def test_base_rules_are_linear(text):
    begin = time.time()
    D.base_spans(text)
    assert time.time() - begin < 3


def brute(texts, threshold, support, context):
    """{(entity, term): share} by loops over all documents."""
    docs = []
    for text in texts:
        spans = D.base_spans(text)
        words = list(re.finditer(r"[^\x20\x09-\x0D]+", text))

        def overlaps(m, s):
            return m.start() < s[2] and s[1] < m.end()
        free = [not any(overlaps(m, s) for s in spans) for m in words]
        near, entities = {}, set()
        for s in spans:
            entity = f"{s[0]}:{s[3]}"
            entities.add(entity)
            at = [i for i, m in enumerate(words) if overlaps(m, s)]
            window = [i for i in range(max(at[0] - context, 0), min(at[-1] + context + 1, len(words))) if free[i]]
            terms = [t for t in (D.term(words[i].group()) for i in window) if t]
            for t in terms:
                for x in (t, t[:3] + "*"):
                    near.setdefault((entity, x), tuple(terms))
        held = {x for m in words for t in [D.term(m.group())] if t for x in (t, t[:3] + "*")}
        docs.append((entities, near, held))
    out = {}
    for e in {e for d in docs for e in d[0]}:
        n_e = sum(e in d[0] for d in docs)
        if n_e == len(docs):
            continue
        for t in {t for d in docs for x, t in d[1] if x == e}:
            found = [d[1][e, t] for d in docs if (e, t) in d[1]]
            n_t = sum(t in d[2] for d in docs)
            share = 1 - math.log(n_t / len(found)) / math.log(len(docs) / n_e)
            if len(set(found)) >= support and share >= threshold:
                out[e, t] = round(share, 9)
    return out


def corpus():
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "The", "of,", "Jane", "(Doe)", "omega-3", "été"]
    out = [None, "", " "]
    for i in range(120):
        text = " ".join(rng.choice(words[:6]) + str(rng.randrange(4)) for _ in range(rng.randrange(4, 40)))
        if i % 5 == 0:
            text += f" Jane (Doe), zyxo{i % 3}wv: jane.doe@mail.org " + " ".join(rng.choice(words[:5]) for _ in range(4))
        if i % 7 == 0:
            text += " call +49 30 1234567 Kunibert " + rng.choice(words[:4]) + " 10.0.0.1 10.0.0.1"
        if i % 11 == 0:
            text += " of Kunibert"
        out.append(text)
    return out + [out[20]] * 6


@pytest.mark.parametrize("threshold,support,context", [(0.9, 3, 10), (0.5, 2, 3), (1.0, 1, 40), (-9.0, 1, 2)])
def test_disclosure_equals_brute_force(spark, threshold, support, context):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {(r.entity, r.term): round(r.share, 9) for r in D.disclosing_terms(docs, threshold=threshold, support=support, context=context).collect()}
    want = brute([t or "" for t in texts], threshold, support, context)
    assert got == want and want


def test_spans_actions_and_texts(spark):
    texts = corpus()
    ids = [*range(len(texts) - 2), None, 5]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    found = brute([t or "" for t in texts], D.THRESHOLD, D.SUPPORT, D.CONTEXT)
    terms = {t for _, t in found if not t.endswith("*")}
    kinds = {t: "removed" if t[:3] + "*" in {x for _, x in found} else "general" for t in terms}
    assert {"jane", "doe"} <= terms and {kinds["jane"], kinds["doe"]} == {"removed"}

    def spans(text):
        base = D.base_spans(text)
        hits = []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
            if not any(m.start() < s[2] and s[1] < m.end() for s in base) and D.term(m.group()) in kinds:
                inner = re.search(r"\w(.*\w)?", m.group())
                hits.append((kinds[D.term(m.group())], m.start() + inner.start(), m.start() + inner.end()))
        return [x[:3] for x in base], sorted(hits)
    want = sorted((repr(i), *spans(t or "")) for i, t in zip(ids, texts))
    got = sorted((repr(r.doc_id), [tuple(x) for x in r.base], [tuple(x) for x in r.added]) for r in D.private_spans(docs).collect())
    assert got == want
    clean = {r.text for r in D.sanitise(docs).collect()}
    assert not any("Jane" in t or "Doe" in t or "@" in t or "+49" in t or "10.0.0.1" in t for t in clean)
    assert any("<email>" in t for t in clean) and any("<phone>" in t for t in clean)


def test_a_class_that_tells_nothing_generalises(spark):
    texts = [f"w{i} v{i} barbara x{i} a@b.org" for i in range(6)] + [f"barometer barrel bark {i}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in D.sanitise(docs).collect()}
    assert out[3] == "w3 v3 bar* x3 <email>" and out[50] == texts[50]


def test_nulls_empty_and_clashing_columns(spark):
    names = ["rid", "id", "term", "kind", "base", "_salt", "a b", "x.y"]
    docs = spark.createDataFrame([("k", "a@b.org", *["?"] * len(names)), (None, None, *["?"] * len(names))],
                                 "doc_id string, text string" + "".join(f", `{n}` string" for n in names))
    assert sorted((repr(r.doc_id), len(r.base), len(r.added)) for r in D.private_spans(docs).collect()) == [("'k'", 1, 0), ("None", 0, 0)]
    assert D.private_spans(docs.limit(0)).count() == 0
