"""Jaccard join, fingerprints, components and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cashlens.llm import fingerprints, jaccard_join
from cashlens.llm.common import carried, replace_spans, restored, scratch_dir
from cashlens.llm.components import components

WORDS = [f"w{i}" for i in range(400)]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def shingle_set(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x, (i, s) in enumerate(sets):
        for j, t in sets[:x]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t) and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i, _ in sets}


def check_groups(documents, rows):
    got = jaccard_join.groups(documents(rows)).collect()
    assert len(got) == len(rows)
    want = brute_groups(rows)
    by_row = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None)
    assert by_row == sorted((i, len(shingle_set(t)), want[i]) for i, t in rows if i is not None)
    return got


def test_groups_of_copies_and_chains(documents):
    rng = random.Random(1)
    rows = []
    for _ in range(30):  # families around the threshold, copies, and a shared passage
        base = text_of(rng, rng.choice([30, 60, 120]))
        rows += [base, base.upper(), edited(rng, base, 1), edited(rng, base, 2), edited(rng, base, 4)]
    passage = text_of(rng, 55)
    rows += [f"{text_of(rng, 25)} {passage} {text_of(rng, 25)}" for _ in range(60)]
    rows += [None, "", " \n\t ", "a b", "A  b", "b a", "one two three four", "one two three four", "one two three four five", "x " * 5000, "x " * 5001]
    rng.shuffle(rows)
    check_groups(documents, list(enumerate(rows, 100)))


def test_one_large_family_that_stays_open(documents):
    """Members at all distances from each other: levels above the first, pivots, Voronoi regions and windows."""
    rng = random.Random(2)
    base = text_of(rng, 80)
    rows = [edited(rng, base, rng.randrange(0, 9)) for _ in range(220)]
    check_groups(documents, list(enumerate(rows)))


def test_join_edges(documents):
    rng = random.Random(3)
    one = text_of(rng, 40)
    got = check_groups(documents, [(None, one), (5, one), (5, one), (7, edited(rng, one, 1)), (None, "alone it is"), (9, None), (-3, one)])
    lone = sorted((r["component_id"] is None, r["component_id"] or 0) for r in got if r["doc_id"] is None)
    assert lone == [(False, -3), (True, 0)]
    assert jaccard_join.groups(documents([])).count() == 0


def test_components(spark, tmp_path):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 180)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    parent = {x: x for pair in links for x in pair}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(df, str(tmp_path)).collect()}
    assert got == {x: root(x) for pair in links if pair[0] != pair[1] for x in pair}


# ---------------------------------------------------------------- fingerprints

PIECES = re.compile(r"\n+|(?<=[.!?|*])\x20+")


def units(text):
    return {p for p in PIECES.split(text or "") if p}


def test_fingerprints(documents):
    rng = random.Random(5)
    rows = [". ".join(text_of(rng, 6) for _ in range(rng.choice([1, 3, 12, 40]))) for _ in range(30)]
    rows += [rows[0], "é😀" * 9, "", None, "a", "\n".join(text_of(rng, 3) for _ in range(900))]
    ids = [3 * i * i for i in range(len(rows))]
    pairs = list(zip(ids, rows, strict=True))
    rng.shuffle(pairs)
    got = {r["doc_id"]: r for r in fingerprints.compare(documents(pairs)).collect()}
    assert len(got) == len(rows)
    for k, i in enumerate(ids):
        text, following = rows[k] or "", rows[(k + 1) % len(rows)] or ""
        m = len(text) // 4
        new = text[: len(text) - m] + following[:m]
        r = got[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        for other, near in ((new, r["near_edited"]), (following, r["near_next"])):
            a, b = units(text), units(other)
            assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert got[ids[0]]["fingerprint"] == got[ids[30]]["fingerprint"]
    assert len({r["fingerprint"] for r in got.values()}) == len({frozenset(units(t)) for t in rows})


def test_larger_sketches_are_tried(spark):
    """A base sketch can not hold 300 differing digests, nor a block ten times its load."""
    left = "\n".join(f"left {i}" for i in range(150))
    right = "\n".join(f"right {i}" for i in range(150))
    df = spark.createDataFrame([(left, right)], "a string, b string")
    df = df.select(fingerprints.paragraphs("a").alias("x"), fingerprints.paragraphs("b").alias("y"))
    df = df.select("x", "y", F.expr(fingerprints.peel(fingerprints.subtract(fingerprints.cells("x", 12), fingerprints.cells("y", 12)), 12)).alias("p"))
    row = df.select("p.ok", F.expr(fingerprints.in_blocks("x", "y", 1)).alias("d"), fingerprints.differing("p", "x", "y").alias("e")).first()
    assert not row["ok"] and row["d"] in (None, 300) and row["e"] == 300


def test_a_block_that_does_not_peel_is_sketched_again_alone(spark):
    """Of hundreds of blocks some hold two digests with the same three cells; the others need no second sketch."""
    left = "\n".join(f"left {i}" for i in range(1500))
    right = "\n".join(f"right {i}" for i in range(1500))
    df = spark.createDataFrame([(left, right)], "a string, b string")
    df = df.select(fingerprints.paragraphs("a").alias("x"), fingerprints.paragraphs("b").alias("y"))
    assert df.select(F.expr(fingerprints.in_blocks("x", "y", 1)).alias("d")).first()["d"] == 3000


def test_fingerprint_edges(documents):
    assert fingerprints.compare(documents([])).count() == 0
    one = fingerprints.compare(documents([(4, "only one. here")])).first()
    assert one["near_next"] == 1.0
    got = fingerprints.compare(documents([(None, "x. y"), (1, "a"), (1, "b"), (2, None)])).collect()
    assert len(got) == 4


SENTENCES = re.compile(r"\n+|(?<=[.!?|*])\x20+")


@pytest.mark.parametrize("starts", ["Then", "w", "Жук", "字"])
def test_every_sentence_end_cuts(documents, starts):
    """Sentences in one line, whatever they start with: the three quarters that an edit leaves stay common."""
    rows = [" ".join(f"{starts} {j} of {i} is so." for j in range(60)) for i in range(2)]
    for i, r in enumerate(sorted(fingerprints.compare(documents(rows)).collect(), key=lambda r: r["doc_id"])):
        text, m = rows[i], len(rows[i]) // 4
        new = text[: len(text) - m] + rows[1 - i][:m]
        a, b = set(SENTENCES.split(text)), set(SENTENCES.split(new))
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b)) and r["near_edited"] > 0.5


@pytest.mark.parametrize("blank", [" ", ""])
def test_long_runs_are_cut_by_content(spark, documents, blank):
    """No line or sentence ends at all: the cuts follow the content, also behind an insertion, and lose nothing."""
    rng = random.Random(7)
    parts = [rng.choice(WORDS) if blank else chr(rng.choice([*range(0x4E00, 0x4F00), 0x1F600])) for _ in range(4000)]
    text = blank.join(parts)
    df = spark.createDataFrame([(text, "new " + text)], "a string, b string")
    one, two = df.select(fingerprints.pieces("a"), fingerprints.pieces("b")).first()
    assert "".join(one) == text and "".join(two) == "new " + text
    assert len(one) > 100 and len(set(one) & set(two)) >= len(set(one)) - 4
    assert fingerprints.compare(documents([text, "other"])).where("doc_id = 0").first()["near_edited"] > 0.5


def test_next_ids(spark):
    rng = random.Random(6)
    ids = sorted({rng.randrange(-(10**6), 10**8) for _ in range(400)} | {0, 1, 4095, 4096})
    got = {r["id"]: r["next"] for r in fingerprints.next_ids(spark.createDataFrame([(i,) for i in ids], "id bigint")).collect()}
    assert got == dict(zip(ids, [*ids[1:], None], strict=True))


def plan_nodes(plan):
    yield plan
    inner = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in plan.nodeName() else []
    children = plan.children()
    for child in inner + [children.apply(i) for i in range(children.size())]:
        yield from plan_nodes(child)


def test_next_of_sparse_ids(spark):
    """Ids spread over 64 bits: a single task reads a row per partition, not a row per id."""
    rng = random.Random(8)
    ids = sorted({rng.randrange(-(2**63), 2**63) for _ in range(2000)})
    df = fingerprints.next_ids(spark.createDataFrame([(i,) for i in ids], "id bigint"))
    rows = df.collect()
    assert {r["id"]: r["next"] for r in rows} == dict(zip(ids, [*ids[1:], None], strict=True))
    single = [p for p in plan_nodes(df._jdf.queryExecution().executedPlan()) if p.nodeName() == "Exchange" and p.outputPartitioning().numPartitions() == 1]
    assert single and max(p.metrics().apply("shuffleRecordsWritten").value() for p in single) <= 4


# ---------------------------------------------------------------- helpers


def test_spans_and_carried_columns(spark, documents):
    docs = documents(["0123456789", None])
    df = carried(docs).withColumn("s", F.expr("array(named_struct('start', 1L, 'end', 3L), named_struct('start', 2L, 'end', 5L), named_struct('start', 9L, 'end', 10L))"))
    got = restored(df, docs, replace_spans("text", "s", "_")).collect()
    assert [(r["text"], r["n_chars"], r["score"], r["spans"]) for r in got] == [("0_5678_", 7, "kept", 7), (None, None, "kept", 7)]
    assert restored(carried(docs), docs).columns == docs.columns


def test_local_scratch(spark):
    assert scratch_dir(spark).startswith("/tmp/") and scratch_dir(spark) != scratch_dir(spark)


def test_small_shingle_regions_end_in_their_pairs(spark):
    """Only larger regions go on as spokes; of a small one its pairs that fit, wherever Arrow batches cut the rows."""
    many = jaccard_join.SMALL + 4
    rows = [(1, 10, 20, 0, 5), (1, 11, 20, 1, 4), (1, 12, 20, 2, 3), (1, 13, 90, 0, 2), (2, 30, 20, 0, 1)] + [(3, 100 + k, 20, 0, 50 - k) for k in range(many)]
    table = spark.createDataFrame(rows, "region bigint, doc bigint, n int, place int, central int")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for size in ("1", "3", "10000"):
        spark.conf.set(key, size)
        try:
            got = jaccard_join.meetings(table.coalesce(1), 0.25).distinct().collect()
        finally:
            spark.conf.set(key, before)
        pairs = {(r["kind"], r["region"], r["doc"]) for r in got}
        small = {(jaccard_join.FIRST, 10, 11), (jaccard_join.FIRST, 10, 12), (jaccard_join.REST, 11, 12)}
        spokes = {(jaccard_join.SPOKE, 100, 100 + k) for k in range(1, many)}
        assert small | spokes <= pairs
        assert {p for p in pairs if p[0] == jaccard_join.SPOKE} == spokes
        assert not any(13 in p[1:] or 30 in p[1:] for p in pairs)


def test_rare_shingles_are_told_from_shared_ones(spark, documents):
    """A million shingles leave most buckets to one: those of a single document count 1, those of a phrase as often as it stands."""
    rng = random.Random(9)
    phrase = " ".join(f"p{k}" for k in range(24))
    rows = [" ".join(f"{rng.randrange(10**6)}" for _ in range(500)) for _ in range(2000)]
    rows[::100] = [f"{r} {phrase}" for r in rows[::100]]
    counts = jaccard_join.bucket_counts(documents(rows).repartition(3))

    def codes(text):
        (_, tokens), = jaccard_join.sets_of(pa.array([text]))
        return counts[(tokens >> jaccard_join.BUCKET_SHIFT).astype(int)]

    once = codes(rows[1])
    assert (once == 0).mean() > 0.9
    shared = round(jaccard_join.COARSE * math.log2(20))
    assert codes(phrase).min() == shared and (codes(phrase) == shared).mean() > 0.7


def test_counts_of_one_bucket_add_up(documents):
    """Counts of several tasks and texts are summed; an empty table has none."""
    counts = jaccard_join.bucket_counts(documents(["a b c", "A b  c", "d e f g h i", None, "", "a b c"]).repartition(4))
    assert sorted(counts[counts > 0].tolist()) == [round(jaccard_join.COARSE * math.log2(3))]
    assert not jaccard_join.bucket_counts(documents([])).any()
