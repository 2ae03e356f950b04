"""Main text of web pages: a recurrent block labeller.

A page becomes its sequence of leaf blocks (the text between two block tags), each with its path of open tags. A
bidirectional LSTM in numpy reads, per block, the summed vectors of its hashed path words (tags, class and id words,
whether the text is a link, its length) and the mean vector of its hashed text words, and labels every block from the
whole document in both directions. Blocks labelled as main text are joined in page order.

Training needs no hand labels: on a bounded sample of pages, blocks under an ``article`` or ``main`` element are main
text and blocks elsewhere are not. The texts of these blocks are also set into other page layouts whose labels are
known by construction (``layout``), so that the labeller learns containers, sidebars, notices, forms, adverts and
comments that the sample itself does not use.

Defined cases: a null or empty html gives the empty text; a page without main text too; tags left open are closed by
the next block of their kind; repeated rows are read each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashlens.llm.common import hashed_sample

PATHS, WORDS, PATH_DIM, WORD_DIM, HIDDEN = 4096, 2048, 16, 4, 12
#: Blocks of a chain that is fitted at once.
CHAIN = 120

# ---------------------------------------------------------------- blocks

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-zA-Z][\w:-]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<[!?/a-zA-Z][^>]*>""",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Za-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub "
    "sup time tt u var wbr img br label".split()
)
#: A new element of these kinds ends an open one of the same group.
CLOSES = {"p": "p", "li": "li", "dt": "dd", "dd": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option"}


def blocks(page: str) -> list[tuple[tuple[str, ...], str]]:
    """(path words, text) of each leaf block in page order. Texts have references decoded and single spaces."""
    out: list[tuple[tuple[str, ...], str]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    path: tuple[str, ...] = ()

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((path, text))
            parts.clear()

    def add(text: str) -> None:
        nonlocal path
        if not parts:
            if text.isspace():
                return
            path = tuple(w for _, words in stack for w in words)
        parts.append(text)

    at = 0
    for found in TAG.finditer(page):
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        name = found[3]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "br":
                add(" ") if parts else None
                continue
        else:
            end_block()
        if found[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name not in INLINE:
            group = CLOSES.get(name)
            for i in range(len(stack) - 1, -1, -1):
                open_ = stack[i][0]
                if open_ in INLINE or open_ == "p" or (group and CLOSES.get(open_) == group):
                    if open_ not in INLINE:
                        del stack[i:]
                        break
                    continue
                break
        if name in VOID:
            continue
        words = [name]
        if found[4]:
            for a, b, c in NAMES.findall(found[4]):
                words += [f".{w}" for w in WORD.findall((a or b or c).lower())]
        stack.append((name, tuple(words)))
    if at < len(page):
        add(page[at:])
    end_block()
    return out


def numbers(sequence: list[tuple[tuple[str, ...], str]]) -> tuple[list[list[int]], list[list[int]]]:
    """Hashed path words and text words of each block."""
    paths, words = [], []
    code = zlib.crc32
    for path, text in sequence:
        tokens = text.split()
        own = {*path, f"<{path[-1] if path else ''}", f"#{min(len(tokens), 63).bit_length()}", "" if path else "^"}
        paths.append(sorted(code(w.encode()) % PATHS for w in own))
        words.append([code(w.encode()) % WORDS for w in tokens])
    return paths, words


# ---------------------------------------------------------------- the network


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Vectors of path words and text words, an LSTM in each direction, and a logistic output per block."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d, h = PATH_DIM + WORD_DIM, HIDDEN
        self.p = {
            "path": np.zeros((PATHS, PATH_DIM)),
            "word": np.zeros((WORDS, WORD_DIM)),
            "out": rng.normal(0, 0.3, 2 * h),
            "bias": np.zeros(1),
        }
        self.p["path"] += rng.normal(0, 0.01, self.p["path"].shape)
        for side in "fb":
            self.p[f"w{side}"] = rng.normal(0, 1 / np.sqrt(d + h), (d + h, 4 * h))
            self.p[f"c{side}"] = np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]

    def inputs(self, docs):
        """(T, B, d) inputs of a batch of documents, left-aligned, with what the gradient needs."""
        size = [len(paths) for paths, _ in docs]
        where = np.array([(t, b) for b, n in enumerate(size) for t in range(n)])
        flat_p = np.array([i for paths, _ in docs for x in paths for i in x])
        own_p = np.repeat(np.arange(len(where)), [len(x) for paths, _ in docs for x in paths])
        flat_w = np.array([i for _, words in docs for x in words for i in x])
        count = np.array([len(x) for _, words in docs for x in words])
        own_w = np.repeat(np.arange(len(where)), count)
        x = np.empty((len(where), PATH_DIM + WORD_DIM))
        x[:, :PATH_DIM] = np.add.reduceat(self.p["path"][flat_p], np.searchsorted(own_p, np.arange(len(where))))
        x[:, PATH_DIM:] = np.add.reduceat(self.p["word"][flat_w], np.searchsorted(own_w, np.arange(len(where)))) / count[:, None]
        full = np.zeros((max(size), len(docs), x.shape[1]))
        full[where[:, 0], where[:, 1]] = x
        return full, np.array(size), where, (flat_p, own_p, flat_w, own_w, count)

    def scan(self, x, side):
        h = HIDDEN
        w, c = self.p[f"w{side}"], self.p[f"c{side}"]
        into = x @ w[: -h] + c
        hidden, cell = np.zeros((x.shape[1], h)), np.zeros((x.shape[1], h))
        out = np.empty((*x.shape[:2], h))
        kept = []
        for t in range(len(x)):
            z = into[t] + hidden @ w[-h:]
            gates = sigmoid(z[:, : 3 * h])
            new = np.tanh(z[:, 3 * h :])
            previous, before = cell, hidden
            cell = gates[:, h : 2 * h] * cell + gates[:, :h] * new
            squashed = np.tanh(cell)
            hidden = gates[:, 2 * h :] * squashed
            out[t] = hidden
            kept.append((gates, new, previous, before, squashed))
        return out, kept

    def back(self, x, kept, d_out, side, grad):
        h = HIDDEN
        w = self.p[f"w{side}"]
        dz = np.empty((*x.shape[:2], 4 * h))
        dh, dc = np.zeros((x.shape[1], h)), np.zeros((x.shape[1], h))
        for t in range(len(x) - 1, -1, -1):
            gates, new, previous, before, squashed = kept[t]
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - squashed**2)
            dz[t] = np.concatenate([dc * new * i * (1 - i), dc * previous * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)], 1)
            dc = dc * f
            dh = dz[t] @ w[-h:].T
        befores = np.stack([k[3] for k in kept])
        flat = dz.reshape(-1, 4 * h)
        grad[f"w{side}"] = np.concatenate([x.reshape(-1, x.shape[2]).T @ flat, befores.reshape(-1, h).T @ flat])
        grad[f"c{side}"] = flat.sum(0)
        return dz @ w[:-h].T

    @staticmethod
    def turned(x, size):
        """Each document of a left-aligned batch in reverse order."""
        t = np.arange(len(x))[:, None]
        index = np.where(t < size, size - 1 - t, t)
        return x[index, np.arange(x.shape[1])]

    def probabilities(self, docs, train=None):
        """P(main text) of every block; with ``train`` (labels per block) also the gradients."""
        x, size, where, flats = self.inputs(docs)
        ahead, kept_f = self.scan(x, "f")
        turned = self.turned(x, size)
        behind, kept_b = self.scan(turned, "b")
        both = np.concatenate([ahead, self.turned(behind, size)], 2)
        p = sigmoid(both @ self.p["out"] + self.p["bias"])
        found = p[where[:, 0], where[:, 1]]
        if train is None:
            return found, size
        error = np.zeros(p.shape)
        error[where[:, 0], where[:, 1]] = (found - train) / len(train)
        grad = {"out": (both * error[:, :, None]).sum((0, 1)), "bias": error.sum(keepdims=True).ravel()}
        d_both = error[:, :, None] * self.p["out"]
        dx = self.back(x, kept_f, d_both[:, :, :HIDDEN], "f", grad)
        dx += self.turned(self.back(turned, kept_b, self.turned(d_both[:, :, HIDDEN:], size), "b", grad), size)
        dx = dx[where[:, 0], where[:, 1]]
        flat_p, own_p, flat_w, own_w, count = flats
        grad["path"], grad["word"] = np.zeros_like(self.p["path"]), np.zeros_like(self.p["word"])
        np.add.at(grad["path"], flat_p, dx[own_p, :PATH_DIM])
        np.add.at(grad["word"], flat_w, (dx[:, PATH_DIM:] / count[:, None])[own_w])
        return found, grad

    def fit(self, docs, labels, epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 11):
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for first in range(0, len(docs), batch):
                chosen = order[first : first + batch]
                _, grad = self.probabilities([docs[i] for i in chosen], np.concatenate([labels[i] for i in chosen]))
                step += 1
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)


# ---------------------------------------------------------------- training pages

# Words that web pages use for containers, as class and id words.
MAIN_NAMES = "content article post entry story body text main maincontent postbody articlebody prose page".split()
NOISE_NAMES = "wrap wrapper container row col inner outer box left right top section block module clearfix grid x1 md 8".split()
SIDE_PARTS = {
    "nav": "nav menu navbar navigation topnav links breadcrumb breadcrumbs pagination pager toc",
    "header": "header masthead topbar sitehead branding logo banner hero",
    "footer": "footer foot copyright colophon legal bottom imprint siteinfo",
    "aside": "sidebar aside widget related recommended popular trending more promo teaser side",
    "ad": "ad ads advert advertisement sponsored sponsor banner promo adbox adslot commercial",
    "notice": "notice cookie cookies consent alert gdpr message popup modal overlay warning newsletter subscribe privacy",
    "form": "form search login signup subscribe newsletter contact comment",
    "comments": "comments comment reply replies disqus discussion respond commentlist thread reader readers",
    "share": "share social sharing follow tags meta byline author rating tools",
}
SIDE_TAGS = {
    "nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"],
    "ad": ["div", "aside", "section", "ins"], "notice": ["div", "section", "aside", "dialog"], "form": ["form"],
    "comments": ["div", "section", "ol", "aside"], "share": ["div", "ul", "section"],
}


def named(tag: str, names: list[str], rng) -> tuple[str, ...]:
    extra = [str(rng.choice(NOISE_NAMES))] if rng.random() < 0.3 else []
    return (tag, *(f".{n}" for n in [*names, *extra]))


def layout(main: list[str], other: list[str], rng) -> tuple[list[tuple[tuple[str, ...], str]], np.ndarray]:
    """A page of another layout: blocks and labels. Side parts stand before, after and inside the main container."""
    body: tuple[str, ...] = ("html", "body")
    for _ in range(rng.integers(0, 3)):
        body += named("div", [], rng)
    sequence: list[tuple[tuple[str, ...], str]] = []
    labels: list[int] = []
    pool = other + main

    def text(most: int = 60) -> str:
        words = str(pool[rng.integers(len(pool))]).split()
        first = rng.integers(max(1, len(words) - 3))
        return " ".join(words[first : first + int(rng.integers(1, most))]) or "x"

    def side(kind: str, above: tuple[str, ...]) -> None:
        tag = str(rng.choice(SIDE_TAGS[kind]))
        plain = tag in ("nav", "header", "footer", "aside", "form")
        names = [] if plain and rng.random() < 0.5 else [str(rng.choice(SIDE_PARTS[kind].split()))]
        path = above + named(tag, names, rng)
        for _ in range(rng.integers(0, 2)):
            path += named("div", [], rng)
        many = kind in ("nav", "comments", "share", "aside", "form")
        for _ in range(rng.integers(1, 7) if many else rng.integers(1, 3)):
            if kind in ("nav", "share") or (kind in ("aside", "footer") and rng.random() < 0.5):
                tail, most = [("ul", "li", "a"), ("a",), ("li", "a"), ("span", "a")][rng.integers(4)], 6
            elif kind == "form":
                tail, most = [("label",), ("button",), ("p",), ("div", "label"), ("option",), ("legend",), ("textarea",)][rng.integers(7)], 8
            else:
                tail, most = [("p",), (), ("div",), ("span",), ("h3",), ("h2",), ("li",), ("div", "p"), ("p", "b")][rng.integers(9)], 60
            sequence.append((path + tail, text(most)))
            labels.append(0)

    def title() -> None:
        sequence.append((("html", "head", "title"), main[0] if main else text(8)))
        labels.append(0)

    if rng.random() < 0.8:
        title()
    before = [k for k in ("notice", "header", "nav", "ad", "share", "form", "aside") if rng.random() < 0.4]
    for kind in before:
        side(kind, body)
    container = body
    if rng.random() < 0.4:
        container += named("main", [], rng)
    tag = str(rng.choice(["article", "article", "main", "div", "section", "div", "td"]))
    names = [] if tag in ("article", "main") and rng.random() < 0.6 else [str(x) for x in rng.choice(MAIN_NAMES, rng.integers(1, 3))]
    container += named(tag, names, rng)
    inner = container
    for _ in range(rng.integers(0, 2)):
        inner += named("div", [str(rng.choice(MAIN_NAMES))] if rng.random() < 0.5 else [], rng)
    leaves = [("p",)] * 8 + [("p", "b"), ("h2",), ("h3",), ("blockquote",), ("ul", "li"), ("ol", "li"), ("pre",), ("blockquote", "p"), ("table", "tr", "td"), ("div",), ("p", "a"), ("figure", "figcaption")]
    for k, block in enumerate(main):
        leaf = (("h1",), ("header", "h1"), ("p",), ("h2",))[rng.choice(4, p=[0.7, 0.1, 0.1, 0.1])] if k == 0 else leaves[rng.integers(len(leaves))]
        sequence.append((inner + leaf, block))
        labels.append(1)
        if rng.random() < 0.06:
            side(str(rng.choice(["ad", "notice", "aside", "share", "form"])), inner)
    for kind in ("share", "comments", "ad", "aside", "form"):
        if rng.random() < 0.25:
            side(kind, container)
    for kind in ("comments", "aside", "ad", "notice", "form", "nav", "footer", "share"):
        if rng.random() < 0.35:
            side(kind, body)
    return sequence, np.array(labels, float)


def weak_labels(sequence: list[tuple[tuple[str, ...], str]]) -> np.ndarray:
    """Main text stands under ``article`` or ``main``, outside of elements that never hold any."""
    never = {"nav", "footer", "aside", "form", "header"}
    return np.array([float(("article" in p or "main" in p) and not never & set(p)) for p, _ in sequence])


def train(pages: DataFrame, max_pages: int = 150, layouts: int = 900) -> Labeller:
    """Fit on the ``max_pages`` pages with the smallest hash of their id (a bounded sample, on the driver).

    Whole pages are fitted; a longer one than ``CHAIN`` blocks as several chains, one behind the other.
    """
    rows = hashed_sample(pages, "page_id", "html", max_pages).orderBy(F.xxhash64("page_id"), "page_id").collect()
    rng = np.random.default_rng(5)
    real = [x for x in (blocks(r["html"]) for r in rows) if x]
    known = [(x, weak_labels(x)) for x in real]
    mains = [[t for (_, t), y in zip(x, ys, strict=True) if y] for x, ys in known]
    mains = [m for m in mains if m] or [["a b c d", "one two three four five six", "some more words stand here"]]
    others = [t for x, ys in known for (_, t), y in zip(x, ys, strict=True) if not y] or ["a b", "c d e"]
    known = [(x, y) for x, y in known if y.any()]
    for _ in range(layouts):
        known.append(layout(mains[rng.integers(len(mains))], others, rng))
    chains = [(x[i : i + CHAIN], y[i : i + CHAIN]) for x, y in known for i in range(0, len(x), CHAIN)]
    model = Labeller()
    model.fit([numbers(x) for x, _ in chains], [y for _, y in chains])
    return model


# ---------------------------------------------------------------- extraction


def main_texts(pages: list[str | None], model: Labeller) -> list[str]:
    """Main text of each page; pages of like length are labelled together."""
    found = [blocks(p) if p else [] for p in pages]
    texts = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if found[i]), key=lambda i: len(found[i]))
    first = 0
    while first < len(order):
        size = max(1, min(64, 20_000 // len(found[order[min(first + 63, len(order) - 1)]])))
        chosen = order[first : first + size]
        first += size
        p, sizes = model.probabilities([numbers(found[i]) for i in chosen])
        at = 0
        for i, n in zip(chosen, sizes.tolist(), strict=True):
            texts[i] = "\n".join(t for (_, t), q in zip(found[i], p[at : at + n], strict=True) if q >= 0.5)
            at += n
    return texts


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url and text of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 128):
                part = batch.slice(first, 128)
                texts = main_texts(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string")
