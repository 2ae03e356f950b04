"""Toxicity, quality and main text: held-out accuracy, the exact recursions, and edge cases."""

from __future__ import annotations

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cashlens.llm import html_text, quality, toxicity
from cashlens.llm.common import held_out, text_slices, word_spans


def prose(seed, n=40):
    rng = random.Random(seed)
    return " ".join(rng.choice("the of stone river walks under old green houses and light falls on water".split()) for _ in range(n))


# ---------------------------------------------------------------- toxicity


def brute_marginals(field, buckets):
    n = len(buckets)
    emit = field.emission[buckets].sum(1)
    total, toxic = 0.0, np.zeros(n)
    for code in range(2**n):
        y = [(code >> k) & 1 for k in range(n)]
        s = field.start[0, y[0]] + sum(emit[k] for k in range(n) if y[k])
        s += sum(field.steps[y[k - 1], y[k]] for k in range(1, n))
        total += np.exp(s)
        toxic += np.exp(s) * np.array(y)
    return toxic / total


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(1)
    field = toxicity.Field(rng.normal(size=toxicity.BUCKETS), rng.normal(size=(2, 2)), np.tile(rng.normal(size=2), (2, 1)), np.zeros(4))
    one, two = rng.integers(0, 99, (9, 3)), rng.integers(0, 99, (7, 3))
    p = toxicity.marginals(field, np.r_[np.zeros(9, int), np.ones(7, int)], np.concatenate([one, two]))
    assert np.allclose(p[:9], brute_marginals(field, one))
    assert np.allclose(p[9:], brute_marginals(field, two))


def test_long_chains_cross_blocks():
    rng = np.random.default_rng(2)
    field = toxicity.Field(rng.normal(size=toxicity.BUCKETS), rng.normal(size=(2, 2)), np.zeros((2, 2)), np.zeros(4))
    buckets = rng.integers(0, 999, (500, 2))
    steps = toxicity.matrices(field, np.zeros(500, int), buckets)
    v, expected = np.array([0.5, 0.5]), []
    for m in steps:
        v = v @ m
        v = v / v.sum()
        expected.append(v)
    assert np.allclose(toxicity.forward_backward(steps)[0], expected)


@pytest.fixture(scope="module")
def field(documents, labels):
    texts, rows = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = prose(i).split()
        if toxic:
            words[i % 30] = random.Random(i).choice(["GRUMPFL!!", "snarkel", "snarkelig"])
        texts.append(" ".join(words))
        rows.append((i, int(toxic)))
    docs = documents(texts)
    return docs, toxicity.train(docs, labels([*rows, rows[0], (None, 1), (3, None)]))


def test_toxicity_held_out(field):
    docs, model = field
    got = toxicity.score(docs, model).where(held_out(F.col("doc_id"))).collect()
    assert len(got) > 50
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in got)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got)


def test_toxicity_spans_and_edges(field, documents):
    _, model = field
    texts = [None, "", "!!! ---", "é walks snarkel and river", "river " * 9000 + "grumpfl", "é walks snarkel and river"]
    got = toxicity.score(documents([(None, "grumpfl"), *enumerate(texts)]), model).collect()
    rows = {r["doc_id"]: r for r in got}
    assert len(got) == 7
    assert all(0 <= r["score"] <= 1 for r in got)
    assert [rows[k]["toxic_spans"] for k in (0, 1, 2)] == [[], [], []]
    assert [(s["start"], s["end"]) for s in rows[3]["toxic_spans"]] == [(8, 15)]
    assert [(s["start"], s["end"]) for s in rows[4]["toxic_spans"]] == [(54000, 54007)]
    assert rows[3]["score"] == rows[5]["score"] and rows[None]["toxic_spans"]


def test_labelled_words_beside_the_words():
    """Choosing the labelled words takes little memory beside the words, and gives the words of several toxic texts."""
    rng = np.random.default_rng(5)
    rows = np.repeat(np.arange(600, dtype=np.int32), 500)
    buckets = rng.integers(1000, toxicity.BUCKETS, (len(rows), 6), dtype=np.int32)
    toxic = np.arange(601) % 4 == 0  # the last text has no words
    buckets[np.arange(len(rows)) % 500 == 7, 0] = np.where(toxic[:600], 77, 78)
    tracemalloc.start()
    chosen = toxicity.label_words(rows, buckets, toxic)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert chosen.tolist() == [77] and peak < 4 * buckets.nbytes


def test_toxicity_without_labels_or_rows(documents, labels):
    model = toxicity.train(documents(["a b"]), labels([]))
    assert toxicity.score(documents(["snarkel " * 9]), model).first()["score"] < 0.5
    assert toxicity.score(documents([]), model).count() == 0


# ---------------------------------------------------------------- quality


def graded(i):
    """Grade 0: marks behind each word; 1: some; 2: prose."""
    grade = i % 3
    words = prose(i).split()
    return grade, " ".join(w + "***" if grade == 0 or (grade == 1 and k % 3 == 0) else w for k, w in enumerate(words))


def test_quality_three_grades(documents, labels):
    rows = [graded(i) for i in range(300)]
    docs = documents([t for _, t in rows])
    model = quality.train(docs, labels([(i, g) for i, (g, _) in enumerate(rows)], "quality"))
    assert model.grades == [0.0, 1.0, 2.0] and model.thresholds[0] < model.thresholds[1]
    got = quality.grade(docs, model).where(held_out(F.col("doc_id"))).collect()
    assert all(abs(r["expected_grade"] - r["doc_id"] % 3) < 0.6 for r in got)
    assert all(r["keep"] == (r["doc_id"] % 3 > 0) for r in got)
    assert all(r["tail_probabilities"][0] >= r["tail_probabilities"][1] for r in got)


def test_quality_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(3)
    row, bucket = np.repeat(np.arange(60), 3), rng.integers(0, 5, 180)
    rating = rng.integers(0, 3, 60)
    value = np.ones(180)

    def loss(model):
        x = np.bincount(row, weights=model.weights[bucket] * value, minlength=60)
        ends = np.r_[-np.inf, model.thresholds, np.inf]
        p = quality.sigmoid(np.clip(ends[rating + 1] - x, -40, 40)) - quality.sigmoid(np.clip(ends[rating] - x, -40, 40))
        return -np.log(np.maximum(p, 1e-12)).mean()

    fitted = quality.fit(row, bucket, value, rating, rounds=400, ridge=0.0)
    best = loss(fitted)
    for k in range(5):
        for step in (-0.05, 0.05):
            moved = fitted.weights.copy()
            moved[k] += step
            assert loss(quality.Ordinal(fitted.grades, moved, fitted.thresholds)) >= best - 1e-4


def test_quality_edges(documents, labels):
    one = quality.train(documents(["a b", "c"]), labels([(0, 1), (1, 1)], "quality"))
    got = quality.grade(documents([None, "", "x " * 50000, (None, "x")]), one).collect()
    assert len(got) == 4 and all(r["expected_grade"] == 1.0 and r["keep"] for r in got)
    none = quality.train(documents([]), labels([], "quality"))
    assert quality.grade(documents(["a"]), none).count() == 1
    assert quality.grade(documents([]), none).count() == 0


# ---------------------------------------------------------------- words


def test_word_spans_stop_at_rows():
    for first, end, raw, at in text_slices(pa.array(["ab", None, "", "cd e", "f"]), limit=3):
        rows, starts, ends = word_spans(raw, at, np.array([c != 32 for c in range(256)]))
        assert all(at[r] <= s < e <= at[r + 1] for r, s, e in zip(rows, starts, ends, strict=True))
        assert end > first


# ---------------------------------------------------------------- main text

HEAD = "<html><head><title>T</title><script>var a='<p>no</p>';</script><style>p{}</style></head><body>"


def page(seed, wrap="article"):
    paragraphs = [prose(seed * 10 + k, 12 + k) for k in range(5)]
    main = "".join(f"<p>{p}</p>" for p in paragraphs)
    side = "<nav><ul><li><a href='/a'>one</a></li><li><a href='/b'>two</a></li></ul></nav><div class='ad'>buy it now</div>"
    return f"{HEAD}{side}<{wrap}><h1>Title &amp; more</h1>{main}</{wrap.split()[0]}><footer>&copy; site words</footer></body></html>", "\n".join(["Title & more", *paragraphs])


@pytest.fixture(scope="module")
def labeller(spark):
    pages = spark.createDataFrame([(i, f"u{i}", page(i)[0]) for i in range(60)], "page_id bigint, url string, html string")
    return html_text.train(pages, max_pages=40, layouts=500)


def test_main_text_of_the_sample_layout(labeller):
    assert html_text.main_texts([page(900 + i)[0] for i in range(20)], labeller) == [page(900 + i)[1] for i in range(20)]


def test_main_text_of_other_layouts(labeller):
    body = "".join(f"<p>{prose(k, 20)}</p>" for k in range(6))
    want = "\n".join(prose(k, 20) for k in range(6))
    html_ = (
        f"{HEAD}<header class='site'><a href='/'>Home</a></header><div class='cookie-notice'><p>We use cookies</p><button>OK</button></div>"
        f"<div id='content' class='post'>{body}</div><aside class='sidebar'><h3>Popular</h3><ul><li><a href='x'>other</a></li></ul></aside>"
        "<form><label>Mail</label><button>Send</button></form>"
        "<section class='comments'><div class='comment'><p>I read this</p></div></section><footer>Imprint</footer></body>"
    )
    assert html_text.main_texts([html_], labeller) == [want]


def test_gradient_of_the_network():
    model = html_text.Labeller()
    docs = [html_text.numbers([(("body", "p"), "a b c"), (("body", "nav"), "d")]), html_text.numbers([(("div",), "e f")])]
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        p, _ = model.probabilities(docs)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    _, grad = model.probabilities(docs, y)
    for name in ("wf", "wb", "cf", "out", "path", "word"):
        flat = np.abs(grad[name]).ravel()
        k = np.unravel_index(flat.argmax(), grad[name].shape)
        before = model.p[name][k]
        model.p[name][k] = before + 1e-5
        up = loss()
        model.p[name][k] = before - 1e-5
        down = loss()
        model.p[name][k] = before
        assert abs((up - down) / 2e-5 - grad[name][k]) < 1e-6


def test_main_text_edges(labeller, spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain < words & more"), (None, "u", page(7)[0]), (4, "u", "<p>" * 3000), (4, "u", "<p>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = html_text.extract(pages, labeller).collect()
    assert len(got) == 6
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[1] == texts[2] == texts[4] == "" and texts[None] == page(7)[1]
    assert html_text.extract(pages.limit(0), labeller).count() == 0


def test_blocks():
    got = html_text.blocks("<p><b>One<br>two &lt;x&gt;<p>three <i>f</i>our<!-- no --></p>five<ul><li>six<li>seven</ul>")
    assert [t for _, t in got] == ["One two <x>", "three four", "five", "six", "seven"]
