"""Blocks of elements that are not plain article markup."""
import pytest

from convgraph.llm import html_lstm as H


def texts(page):
    return [t for _, t, _ in H.leaf_blocks(page)]


@pytest.mark.parametrize("tag", ["math", "svg", "object", "noscript", "template", "noembed", "noframes", "xmp"])
def test_contents_reach_the_labeller(tag):
    assert " ".join(texts(f"<article><p>a<{tag}><b>in side</b></{tag}>b</p></article>")) == "a in side b"
    assert " ".join(texts(f"<article><p>a</p><{tag}><p>rest</p><p>end</p></article>")) == "a rest end"


@pytest.mark.parametrize("tag", ["title", "textarea", "iframe"])
def test_skipped_elements_end_at_their_start_tag_if_unclosed(tag):
    assert texts(f"<p>a<{tag}>x<p>y</{tag}>b</p>") == ["a", "b"]
    assert texts(f"<p>a<{tag}>b</p><{tag}><p>c") == ["a", "b", "c"]


@pytest.mark.parametrize("tag", ["script", "style"])
def test_code_is_never_text(tag):
    assert texts(f"<p>a<{tag}>x<p>y</{tag}>b</p>") == ["a", "b"]
    assert texts(f"<p>a<{tag}>x<p>y") == ["a"]


def test_bounds_of_the_sample_are_parameters(monkeypatch):
    seen = []
    monkeypatch.setattr(H, "compose", lambda rng, words, f=H.compose: seen.append(words) or f(rng, words))
    page = "<article>" + "".join(f"<p>a{i} b{i} c{i}</p>" for i in range(10)) + "</article>"
    H.train([page], composed=1, page_blocks=4, block_words=2, sample_words=7)
    H.train([page], composed=1)
    assert seen[0] == ["a0", "b0", "a1", "b1", "a2", "b2", "a3"] and len(seen[1]) == 30
