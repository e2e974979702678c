"""HTML extraction: recurrent block labeller.

A page becomes the sequence of its leaf blocks (runs of text between
block-level tags).  A block is described by its tag path (hashed tags with
their class and id words), its hashed words and a few measures (length, share
of link text, position, punctuation).  A bidirectional LSTM in numpy reads the
whole sequence, so each block is classified with the context of the document;
blocks labelled as main text are joined in page order.

The labeller is trained here, on the driver, with fixed seeds, from a bounded
sample: (a) pages composed by a small grammar (headers, menus, notices,
adverts, sidebars, forms, comments, footers around an article) with words of
the sampled pages, whose labels are known by construction, and (b) the sampled
pages that mark exactly one article or main element, labelled by that mark.
``sample_pages`` bounds the pages of the sample, ``page_blocks`` the first
blocks read of each, ``block_words`` the first words of a block and
``sample_words`` the words in all that the composed pages draw from.

Defined results: a null or empty page gives the empty text; broken markup is
read as far as it goes (an unclosed comment, script or style swallows the
rest, an unclosed title, textarea or iframe ends at its start tag); contents of
scripts, styles, titles, text areas and iframes are no blocks, those of all
other elements (formulas, fall-back texts) are for the labeller to judge;
repeated rows are labelled one by one; equal pages get equal texts; an empty
table gives an empty one.
"""
from __future__ import annotations

import html as _html
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 96, 32, 8, 24
SAMPLE_PAGES, COMPOSED_PAGES = 150, 500
#: Of the sample: blocks of a page, words of a block, and words in all.
PAGE_BLOCKS, BLOCK_WORDS, SAMPLE_WORDS = 400, 200, 20_000
#: Blocks whose features are held at once for one page.
CHUNK_BLOCKS = 20_000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
#: Elements whose content is no markup and no text of the page.
_RAW = frozenset("script style title textarea iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby "
                    "s samp small span strike strong sub sup time tt u var wbr img".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer "
                      "form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


def leaf_blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(tag path, text, characters inside links) of every leaf block."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, str]] = []  # (tag, label of the path)
    parts: list[str] = []
    unclosed: set[str] = set()  # raw elements without an end tag from here on
    linked = links = 0
    at = 0

    def end_block():
        nonlocal linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.append((tuple(label for _, label in stack), text, linked))
            parts.clear()
        linked = 0

    def pop_to(i):
        nonlocal links
        links -= sum(tag == "a" for tag, _ in stack[i:])
        del stack[i:]

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text:
            parts.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        tag = m.group(1)
        if tag is None:
            continue
        tag = tag.lower()
        if page[m.start() + 1] == "/":
            if tag not in _INLINE:
                end_block()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if any(t not in _INLINE for t, _ in stack[i + 1:]) and tag in _INLINE:
                        break  # an inline end tag does not close blocks
                    pop_to(i)
                    break
            continue
        if tag in _RAW:
            end_block()
            if not m.group(2).rstrip().endswith("/") or tag in ("script", "style"):
                if tag not in unclosed:
                    close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                    if close:
                        at = close.end()
                    elif tag in ("script", "style"):
                        at = n
                    else:
                        unclosed.add(tag)
            continue
        if tag not in _INLINE:
            end_block()
            if tag in _CLOSES_P:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        pop_to(i)
                        break
                    if stack[i][0] not in _INLINE:
                        break
            elif tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
                same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in same:
                        pop_to(i)
                        break
                    if stack[i][0] in ("ul", "ol", "table", "dl", "select", "tr"):
                        break
        if tag not in _VOID:
            names = ["".join(x) for x in _ATTR.findall(m.group(2))] if m.group(2) else []
            words = sorted({w for name in names for w in _NAME.findall(name.lower())})
            stack.append((tag, tag + "".join("." + w for w in words)))
            links += tag == "a"
    end_block()
    return out


def _bucket(text: str, size: int) -> int:
    return zlib.crc32(text.encode()) % size


def path_buckets(path: tuple[str, ...]) -> tuple[int, ...]:
    """Buckets of the tags and of the class and id words of a path; the last
    block-level tag counts apart, inline tags do not count."""
    seen, leaf = set(), ""
    for label in path:
        tag, *words = label.split(".")
        if tag in _INLINE:
            continue
        leaf = tag
        seen.add(_bucket("t:" + ("h" if tag in ("h1", "h2", "h3", "h4", "h5", "h6") else tag), PATH_DIM))
        seen.update(_bucket("c:" + w, PATH_DIM) for w in words)
    seen.add(_bucket("leaf:" + leaf, PATH_DIM))
    return tuple(sorted(seen))


class Featurizer:
    def __init__(self):
        self.paths: dict = {}
        self.words: dict = {}

    def __call__(self, blocks, lo: int = 0, total: int | None = None) -> np.ndarray:
        total = total or len(blocks)
        x = np.zeros((len(blocks), PATH_DIM + WORD_DIM + MEASURES), dtype=np.float32)
        if len(self.paths) > 50_000:
            self.paths.clear()
        if len(self.words) > 300_000:
            self.words.clear()
        for i, (path, text, linked) in enumerate(blocks):
            where = self.paths.get(path)
            if where is None:
                where = self.paths[path] = list(path_buckets(path))
            x[i, where] = 1.0
            words = text.split()
            for w in words:
                k = self.words.get(w)
                if k is None:
                    k = _bucket(w.lower(), WORD_DIM)
                    if len(w) < 64:
                        self.words[w] = k
                x[i, PATH_DIM + k] += 1.0
            x[i, PATH_DIM:PATH_DIM + WORD_DIM] /= max(1.0, np.sqrt(len(words)))
            size = len(text)
            place = (lo + i) / max(1, total - 1)
            x[i, PATH_DIM + WORD_DIM:] = (np.log1p(size) / 8, min(1.0, linked / size), place, 1 - place,
                                          text[-1] in ".!?\"'…", text.count(",") / (1 + len(words)),
                                          len(words) < 6, text[:1] in "©&|»")
        return x


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class BiLSTM:
    """Two LSTM layers over the same input, one in each direction, and a
    logistic output on both states."""

    def __init__(self, inputs: int, hidden: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["w" + d] = (rng.standard_normal((inputs, 4 * hidden)) / np.sqrt(inputs)).astype(np.float32)
            self.p["u" + d] = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.p["v" + d] = np.zeros(4 * hidden, np.float32)
            self.p["v" + d][hidden:2 * hidden] = 1.0  # remember by default
        self.p["o"] = (rng.standard_normal(2 * hidden) / np.sqrt(hidden)).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def direction(self, x, mask, d, state=None, keep=False):
        """Hidden states (time, batch, hidden) of one direction; x is in the
        order in which that direction reads."""
        t_len, n, _ = x.shape
        h_dim = self.hidden
        h, c = state if state is not None else (np.zeros((n, h_dim), np.float32), np.zeros((n, h_dim), np.float32))
        pre = x @ self.p["w" + d] + self.p["v" + d]
        out = np.empty((t_len, n, h_dim), np.float32)
        tape = []
        for t in range(t_len):
            z = pre[t] + h @ self.p["u" + d]
            g = sigmoid(z[:, :3 * h_dim])
            i, f, o = g[:, :h_dim], g[:, h_dim:2 * h_dim], g[:, 2 * h_dim:]
            a = np.tanh(z[:, 3 * h_dim:])
            m = mask[t][:, None]
            c_new = np.where(m, f * c + i * a, c)
            tc = np.tanh(c_new)
            h_new = np.where(m, o * tc, h)
            if keep:
                tape.append((h, c, i, f, o, a, tc, m))
            h, c = h_new, c_new
            out[t] = h
        return out, (h, c), tape

    def probabilities(self, hf, hb):
        return sigmoid(np.concatenate([hf, hb], axis=-1) @ self.p["o"] + self.p["c"])

    def predict(self, x, mask):
        hf, _, _ = self.direction(x, mask, "f")
        hb, _, _ = self.direction(x[::-1], mask[::-1], "b")
        return self.probabilities(hf, hb[::-1])

    def gradients(self, x, mask, y):
        hf, _, tf = self.direction(x, mask, "f", keep=True)
        hb, _, tb = self.direction(x[::-1], mask[::-1], "b", keep=True)
        both = np.concatenate([hf, hb[::-1]], axis=-1)
        p = sigmoid(both @ self.p["o"] + self.p["c"])
        err = np.where(mask, p - y, 0.0).astype(np.float32) / mask.sum()
        grads = {"o": np.einsum("tn,tnk->k", err, both), "c": np.array([err.sum()], np.float32)}
        back = err[:, :, None] * self.p["o"]
        h_dim = self.hidden
        for d, tape, xs, dh_out in (("f", tf, x, back[:, :, :h_dim]), ("b", tb, x[::-1], back[::-1, :, h_dim:])):
            du, dz_all = np.zeros_like(self.p["u" + d]), np.empty(xs.shape[:2] + (4 * h_dim,), np.float32)
            dh = dc = np.zeros((xs.shape[1], h_dim), np.float32)
            for t in range(len(tape) - 1, -1, -1):
                h, c, i, f, o, a, tc, m = tape[t]
                dh = dh + dh_out[t]
                live = np.where(m, dh, 0)
                dct = np.where(m, dc + live * o * (1 - tc * tc), 0)
                dz = np.concatenate([dct * a * i * (1 - i), dct * c * f * (1 - f), live * tc * o * (1 - o),
                                     dct * i * (1 - a * a)], axis=1)
                dz_all[t] = dz
                du += h.T @ dz
                dh = np.where(m, dz @ self.p["u" + d].T, dh)
                dc = np.where(m, dct * f, dc)
            grads["u" + d] = du
            grads["w" + d] = np.einsum("tni,tnk->ik", xs, dz_all, optimize=True)
            grads["v" + d] = dz_all.sum(axis=(0, 1))
        return grads

    def fit(self, pages, epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 11):
        """pages: (features, labels) per page; Adam over batches of pages of
        about the same length."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
        groups = [order[i:i + batch] for i in range(0, len(order), batch)]
        step = 0
        for epoch in range(epochs):
            for g in rng.permutation(len(groups)):
                x, mask = padded([pages[i][0] for i in groups[g]])
                y = np.zeros(mask.shape, np.float32)
                for j, i in enumerate(groups[g]):
                    y[:len(pages[i][1]), j] = pages[i][1]
                # some paths and words are hidden, so that neither is needed alone
                drop = rng.random(x.shape[2]) < 0.1
                drop[PATH_DIM + WORD_DIM:] = False
                x[:, :, drop] = 0
                grads = self.gradients(x, mask, y)
                step += 1
                lr = rate * (0.2 if epoch >= epochs - 3 else 1.0)
                norm = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
                for k, gr in grads.items():
                    gr = gr * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * gr
                    s[k] = 0.999 * s[k] + 0.001 * gr * gr
                    self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9 ** step))
                                 / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self


def padded(features: list[np.ndarray]):
    t_len = max(len(f) for f in features)
    x = np.zeros((t_len, len(features), features[0].shape[1]), np.float32)
    mask = np.zeros((t_len, len(features)), bool)
    for j, f in enumerate(features):
        x[:len(f), j] = f
        mask[:len(f), j] = True
    return x, mask


# ------------------------------------------------------------ training pages

_SIDE = {
    "header": (["header", "div.header", "div.masthead", "div#header", "div.site-header", "div.banner", "div.topbar"], "line"),
    "menu": (["nav", "div.nav", "ul.menu", "div.navbar", "div#navigation", "div.breadcrumb", "nav.main-nav", "div.menu",
              "ul.breadcrumbs", "div.toc", "div.pagination"], "links"),
    "notice": (["div.notice", "div.cookie-banner", "div.alert", "div#cookie", "div.consent", "div.gdpr", "aside.notice",
                "div.popup", "div.modal", "div.message", "p.notice", "div.warning"], "prose"),
    "advert": (["div.ad", "div.ads", "div.advert", "aside.ad", "div.sponsored", "div#ad", "section.promo", "ins.adsbygoogle",
                "div.banner-ad", "div.advertisement", "p.ad", "div.promotion"], "prose"),
    "sidebar": (["aside", "div.sidebar", "div#sidebar", "aside.related", "div.widget", "section.related", "div.recommended",
                 "div.share", "div.social", "div.tags", "ul.related", "div.author-box"], "mixed"),
    "form": (["form", "div.newsletter", "form.search", "div.subscribe", "form#login", "form.comment-form", "fieldset"], "form"),
    "comments": (["div.comments", "section.comments", "div#comments", "ol.commentlist", "div.comment", "section#discussion",
                  "div.replies", "div#disqus", "ul.comments"], "comments"),
    "footer": (["footer", "div.footer", "div#footer", "div.site-footer", "div.copyright", "div.legal"], "line"),
}
_BODY = ["article", "main", "article", "div.content", "div#content", "div.post", "section.article", "main>article",
         "div.entry-content", "div.article-body", "div#main", "div.story", "div.post-content", "main>div.text", "body",
         "div#main>article", "article.post", "section", "div.wrap>article", "div.page>div.content"]


def compose(rng, words: list[str]) -> tuple[str, list[int]]:
    """A page and the label of each of its leaf blocks."""
    out, labels = [], []

    def some(lo, hi):
        return " ".join(words[i] for i in rng.integers(0, len(words), int(rng.integers(lo, hi + 1))))

    def sentence(lo=4, hi=40):
        return some(lo, hi).capitalize() + (". " if rng.random() < 0.9 else " ") + (some(3, 30) + "." if rng.random() < .5 else "")

    def opened(spec):
        made, tags = [], []
        for one in spec.split(">"):
            m = re.match(r"([a-z0-9]+)(?:([.#])(.+))?", one)
            attr = "" if not m.group(2) else f' {"class" if m.group(2) == "." else "id"}="{m.group(3)}"'
            made.append(f"<{m.group(1)}{attr}>")
            tags.append(m.group(1))
        return "".join(made), "".join(f"</{t}>" for t in reversed(tags))

    def leaf(markup, label):
        out.append(markup)
        labels.append(label)

    def side(kind, inside=0):
        specs, style = _SIDE[kind]
        start, stop = opened(specs[rng.integers(len(specs))])
        out.append(start)
        list_like = start.startswith(("<ul", "<ol"))
        if style == "links" or (style == "mixed" and rng.random() < .5):
            if not list_like:
                out.append("<ul>")
            for _ in range(rng.integers(1, 8)):
                leaf(f'<li><a href="/x">{some(1, 3)}</a></li>', 0)
            if not list_like:
                out.append("</ul>")
        elif style == "form":
            leaf(f"<label>{some(1, 4)}</label><input name=q>", 0)
            if rng.random() < .6:
                leaf(f"<div><button>{some(1, 2)}</button></div>", 0)
        elif style == "comments":
            for _ in range(rng.integers(1, 5)):
                tag = "li" if list_like else ("div", "p", "article")[rng.integers(3)]
                if rng.random() < .5 and tag != "p":
                    out.append(f"<{tag}>")
                    leaf(f"<b>{some(1, 2)}</b><br>", 0)
                    leaf(f"<p>{sentence()}</p>", 0)
                    out.append(f"</{tag}>")
                else:
                    leaf(f"<{tag}>{sentence()}</{tag}>", 0)
        else:
            prefix = "&copy; " if kind == "footer" and rng.random() < .6 else ""
            if rng.random() < .5 or list_like:
                leaf(f"{prefix}{sentence(2, 25)}" if not list_like else f"<li>{sentence(2, 25)}</li>", 0)
            else:
                for _ in range(rng.integers(1, 3)):
                    tag = ("p", "div", "h3")[rng.integers(3)] if not start.startswith("<p") else "span"
                    if tag == "span":
                        leaf(f"<span>{prefix}{sentence(2, 20)}</span>", 0)
                        break
                    leaf(f"<{tag}>{prefix}{sentence(2, 20)}</{tag}>", 0)
        out.append(stop)

    wrap = ("<div>", "<div class=\"container\">", "<div id=\"page\">", "")[rng.integers(4)]
    out.append(f"<html><head><title>{some(2, 6)}</title></head><body>{wrap}")
    for kind in ("notice", "header", "menu", "advert", "sidebar", "form", "notice"):
        if rng.random() < (.75 if kind == "menu" else .4):
            side(kind)
    start, stop = opened(_BODY[rng.integers(len(_BODY))])
    start, stop = (start, stop) if not start.startswith("<body") else ("", "")
    out.append(start)
    if rng.random() < .85:
        if rng.random() < .2:
            out.append("<header>")
            leaf(f"<h1>{some(2, 8)}</h1>", 1)
            out.append("</header>")
        else:
            leaf(f"<h1>{some(2, 8)}{'.' if rng.random() < .4 else ''}</h1>", 1)
    for k in range(int(rng.integers(0, 12)) if rng.random() < .9 else int(rng.integers(12, 40))):
        kind = rng.random()
        if kind < .62:
            leaf(f"<p>{sentence(1, 60)}</p>", 1)
        elif kind < .72:
            leaf(f"<p><b>{sentence(1, 30)}<br>", 1)
        elif kind < .78:
            leaf(f"<h2>{some(1, 6)}</h2>", 1)
        elif kind < .83:
            out.append("<ul>")
            for _ in range(rng.integers(2, 6)):
                leaf(f"<li>{some(1, 12)}</li>", 1)
            out.append("</ul>")
        elif kind < .87:
            leaf(f"<blockquote>{sentence()}</blockquote>", 1)
        elif kind < .90:
            leaf(f'<p>{some(3, 12)} <a href="/y">{some(1, 4)}</a> {some(2, 9)}.</p>', 1)
        elif kind < .92:
            leaf(f"<pre>{some(4, 12)}</pre>", 1)
        elif kind < .94:
            out.append("<table><tr>")
            leaf(f"<td>{some(1, 4)}</td>", 1)
            leaf(f"<td>{some(1, 4)}</td>", 1)
            out.append("</tr></table>")
        elif k and start:
            side(("advert", "sidebar", "form", "notice")[rng.integers(4)], 1)
    if start and rng.random() < .15:
        side(("comments", "sidebar", "form")[rng.integers(3)], 1)
    out.append(stop)
    for kind in ("sidebar", "advert", "comments", "form", "menu", "footer"):
        if rng.random() < (.75 if kind == "footer" else .35):
            side(kind)
    out.append("</body></html>" if rng.random() < .8 else "")
    return "".join(out), labels


_MARKED = re.compile(r"<(article|main)[\s>]", re.I)
_NOT_MAIN = frozenset("nav aside footer form".split())


def marked_labels(blocks) -> list[int] | None:
    """Labels of a page by its own article or main element."""
    out = []
    for path, _, _ in blocks:
        tags = [p.split(".")[0] for p in path]
        out.append(int(any(t in ("article", "main") for t in tags) and not any(t in _NOT_MAIN for t in tags)))
    return out


def train(pages: list[str], composed: int = COMPOSED_PAGES, seed: int = 5, page_blocks: int = PAGE_BLOCKS,
          block_words: int = BLOCK_WORDS, sample_words: int = SAMPLE_WORDS) -> BiLSTM:
    rng = np.random.default_rng(seed)
    features = Featurizer()
    data, words = [], []
    for page in pages:
        blocks = leaf_blocks(page)[:page_blocks]
        words += [w for _, text, _ in blocks for w in text.split()[:block_words]]
        if len(_MARKED.findall(page)) == 1 and blocks:
            data.append((features(blocks), np.array(marked_labels(blocks), np.float32)))
    words = words[:sample_words] or ["word", "text", "and", "of", "the"]
    words = [_html.escape(w) for w in words]
    for _ in range(composed):
        page, labels = compose(rng, words)
        blocks = leaf_blocks(page)
        if blocks and len(blocks) == len(labels):
            data.append((features(blocks), np.array(labels, np.float32)))
    return BiLSTM(PATH_DIM + WORD_DIM + MEASURES, HIDDEN).fit(data)


class Extractor:
    def __init__(self, model: BiLSTM):
        self.model, self.features = model, Featurizer()

    def long_page(self, blocks) -> np.ndarray:
        """Probabilities of a page's blocks with features held chunk by chunk."""
        cuts = list(range(0, len(blocks), CHUNK_BLOCKS))

        def piece(lo):
            part = self.features(blocks[lo:lo + CHUNK_BLOCKS], lo, len(blocks))[:, None, :]
            return part, np.ones(part.shape[:2], bool)
        state, forward, backward = None, [], {}
        for lo in cuts:
            x, m = piece(lo)
            h, state, _ = self.model.direction(x, m, "f", state)
            forward.append(h)
        state = None
        for lo in reversed(cuts):
            x, m = piece(lo)
            h, state, _ = self.model.direction(x[::-1], m[::-1], "b", state)
            backward[lo] = h[::-1]
        return np.concatenate([self.model.probabilities(f, backward[lo])[:, 0] for f, lo in zip(forward, cuts)])

    def __call__(self, pages: list[str]) -> list[str]:
        out = [""] * len(pages)
        todo = sorted(((leaf_blocks(p), i) for i, p in enumerate(pages) if p), key=lambda b: len(b[0]))
        todo = [t for t in todo if t[0]]
        lo = 0
        while lo < len(todo):
            hi = lo
            while hi < len(todo) and (hi == lo or (hi - lo + 1) * len(todo[hi][0]) <= CHUNK_BLOCKS):
                hi += 1
            group = todo[lo:hi]
            if len(group) == 1 and len(group[0][0]) > CHUNK_BLOCKS:
                found = [self.long_page(group[0][0])]
            else:
                x, mask = padded([self.features(b) for b, _ in group])
                p = self.model.predict(x, mask)
                found = [p[:len(b), j] for j, (b, _) in enumerate(group)]
            for (blocks, i), p in zip(group, found):
                out[i] = " ".join(text for (_, text, _), keep in zip(blocks, p > 0.5) if keep)
            lo = hi
        return out


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",),
            sample_pages: int = SAMPLE_PAGES, model: BiLSTM | None = None, page_blocks: int = PAGE_BLOCKS,
            block_words: int = BLOCK_WORDS, sample_words: int = SAMPLE_WORDS) -> DataFrame:
    """(id, kept columns, text, n_chars) for every page; the bounds hold for
    the training sample only."""
    rows = pages.select(F.col(id_col).alias("_id"), *[F.col(c) for c in keep],
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("_html"))
    if model is None:
        sample = rows.select("_id").orderBy(F.xxhash64("_id"), "_id").limit(sample_pages)
        texts = rows.join(F.broadcast(sample.distinct()), "_id").select("_id", "_html").orderBy("_id").limit(sample_pages)
        model = train([r["_html"] for r in texts.collect()], page_blocks=page_blocks, block_words=block_words,
                      sample_words=sample_words)
    weights, hidden = model.p, model.hidden
    schema = rows.schema

    def run(batches):
        import pyarrow as pa
        made = BiLSTM.__new__(BiLSTM)
        made.p, made.hidden = weights, hidden
        extractor = Extractor(made)
        for batch in batches:
            col = batch.column(batch.num_columns - 1)
            lo = 0
            while lo < batch.num_rows:
                group, size = [], 0
                while lo + len(group) < batch.num_rows and (not group or size < 2_000_000) and len(group) < 256:
                    group.append(col[lo + len(group)].as_py())
                    size += len(group[-1])
                texts = extractor(group)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i)[lo:lo + len(group)] for i in range(batch.num_columns - 1)],
                     pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*batch.schema.names[:-1], "_text", "_n"])
                lo += len(group)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, _text string, _n long") \
        .withColumnsRenamed({"_id": id_col, "_text": "text", "_n": "n_chars"})
