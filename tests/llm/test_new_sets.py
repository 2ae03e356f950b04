"""Centroid clustering, substring dedup and vector codes against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from cashlens.llm import centroids, substring_dedup, vector_codes
from cashlens.llm.vectors import magnitude, whole

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        # names that the operators use themselves
        T.StructField("cluster", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("_salt", T.IntegerType()),
    ]
)


@pytest.fixture(scope="module")
def vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, label, "x", "y", 1) for i, v, label in rows], VECTORS)

    return make


def as_float(v):
    return [float(np.float32(x)) for x in v]


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def lloyd(points, book, rounds):
    def near(p):
        return min(range(len(book)), key=lambda k: (sum((a - b) ** 2 for a, b in zip(p, book[k], strict=True)), k))

    for _ in range(rounds):
        members = {}
        for p in points:
            members.setdefault(near(p), []).append(p)
        book = [[sum(c) // len(members[k]) for c in zip(*members[k], strict=True)] if k in members else b for k, b in enumerate(book)]
    return book, [near(p) for p in points]


def squared(p, q):
    return sum((a - b) ** 2 for a, b in zip(p, q, strict=True))


# ---------------------------------------------------------------- clustering


def brute_clusters(rows, k=16, rounds=3, dims=64):
    kept = [(i, as_float(v)) for i, v, _ in rows if v is not None and len(v) == dims and finite(v)]
    points = [[math.floor(64 * x) for x in v] for _, v in kept]
    key = lambda n: ("1" if kept[n][0] is None else "0" + hashlib.sha256(f"1:{kept[n][0]}".encode()).hexdigest(), kept[n][1])
    book, entry = lloyd(points, [points[n] for n in sorted(range(len(kept)), key=key)[:k]], rounds)
    distance = [squared(p, book[e]) for p, e in zip(points, entry, strict=True)]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in book]
    own = {e: sum(d for d, f in zip(distance, entry, strict=True) if f == e) for e in set(entry)}
    return sorted(((i if i is not None else -1, e, d, own[e], sum(distance), digests[e]) for (i, _), e, d in zip(kept, entry, distance, strict=True)))


def check_clusters(vectors, rows, **settings):
    got = [tuple(r) for r in centroids.cluster(vectors(rows), **settings).collect()]
    assert sorted((i if i is not None else -1, *rest) for i, *rest in got) == brute_clusters(rows, **settings)


def test_clusters(vectors):
    rng = random.Random(1)
    around = [[rng.gauss(0, 0.3) for _ in range(64)] for _ in range(9)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(around)], i % 3) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(150)]  # one vector on a third of all rows
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 63, 1), (2003, [0.0] * 65, 1), (2004, [0.0] * 63 + [None], 1), (2005, [0.0] * 63 + [math.nan], 1), (2006, [-math.inf] + [0.0] * 63, 1)]
    rows += [(5, rows[7][1], None), (5, rows[5][1], None), (None, rows[9][1], 2), (None, rows[10][1], 2)]
    rng.shuffle(rows)
    check_clusters(vectors, rows)


def test_cluster_edges(vectors):
    assert centroids.cluster(vectors([])).collect() == []
    assert centroids.cluster(vectors([(1, None, 1)])).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    check_clusters(vectors, [(1, [0.5] * 64, 1)])
    check_clusters(vectors, [(i, [float(i % 2)] * 64, 1) for i in range(20)])  # equal centroids, ties, empty clusters
    huge = [(i, [(-1.0) ** i * 3e38] * 64, 1) for i in range(4)]
    got = centroids.cluster(vectors(huge)).collect()
    assert len(got) == 4 and all(0 <= r["distance"] < 2**63 for r in got)


def test_orchard_is_exact():
    rng = np.random.default_rng(2)
    for k in (1, 2, 5, 16):
        book = rng.integers(-6, 7, (k, 4))
        x = rng.integers(-8, 9, (500, 4))
        all_ = ((x[:, None] - book[None]) ** 2).sum(-1)
        best, distance = centroids.Orchard(book).nearest(x)
        assert (best == all_.argmin(1)).all() and (distance == all_.min(1)).all()


def test_orchard_skips_far_centroids(monkeypatch):
    """Two groups far apart: a vector of one group measures no centroid of the other."""
    book = np.array([[0, 0], [1, 0], [0, 1], [1000, 0], [1001, 0], [1000, 1]])
    measured = []
    plain = centroids.Orchard.distances
    monkeypatch.setattr(centroids.Orchard, "distances", lambda self, x, which: (measured.append(len(which)), plain(self, x, which))[1])
    centroids.Orchard(book).nearest(np.array([[1, 0]] * 10))
    assert sum(measured) == 20


def test_whole_stays_in_a_long():
    x = whole(np.array([[3e38, -3e38], [1.999, -0.001]]), 64)
    assert x.tolist() == [[magnitude(2), -magnitude(2)], [127, -1]]
    assert int(((x[0] - x[0][::-1]) ** 2).sum()) > 0


# ---------------------------------------------------------------- vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, as_float(v), label) for i, v, label in rows if finite(v) and v and len(v) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts if kept else 0
    points = [[math.floor(4096 * x) for x in v] for _, v, _ in kept]
    codes, errors, numbers = [""] * len(kept), [0] * len(kept), []
    for p in range(parts):
        own = [v[p * width : (p + 1) * width] for v in points]
        book, entry = lloyd(own, own[:entries], rounds)
        numbers += [x for e in book for x in e]
        codes = [c + f"{e:02x}" for c, e in zip(codes, entry, strict=True)]
        errors = [d + squared(v, book[e]) for d, v, e in zip(errors, own, entry, strict=True)]
    digest = hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()
    of = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        of[label] = of.get(label, 0) + e
    return sorted((str(i), c, e, of[label], digest) for (i, _, label), c, e in zip(kept, codes, errors, strict=True))


def check_codes(vectors, rows, **settings):
    got = [tuple(r) for r in vector_codes.compress(vectors(rows), **settings).collect()]
    shape = {k: v for k, v in settings.items() if k in ("parts", "entries", "rounds")}
    assert sorted((str(r[0]), *r[1:]) for r in got) == brute_codes(rows, **shape)


def test_codes(vectors):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(32)], rng.choice([None, 1, 2])) for i in range(160)]
    rows += [(500 + i, rows[3][1], 7) for i in range(80)]  # one vector on a third of all rows
    rows += [(900, None, 1), (901, [], 1), (902, [0.1] * 31 + [None], 1), (903, [math.nan] * 32, 1), (904, [math.inf] * 32, 1), (905, [0.1] * 31, 1), (906, [0.1] * 40, 1)]
    rows += [(4, rows[8][1], 1), (4, rows[2][1], 1), (None, rows[5][1], None)]
    rng.shuffle(rows)
    check_codes(vectors, rows)
    check_codes(vectors, rows, few_labels=0, members=10)  # salted label sums, many salts


def test_code_edges(vectors):
    assert vector_codes.compress(vectors([])).collect() == []
    check_codes(vectors, [(1, [0.5] * 8, 1)])
    check_codes(vectors, [(i, [float(i % 2)] * 16, None) for i in range(40)])  # equal entries, ties, unused entries
    check_codes(vectors, [(i, [i / 7] * 8, i) for i in range(30)], parts=2, entries=3, rounds=2)
    with pytest.raises(ValueError):
        vector_codes.compress(vectors([]), entries=257)


def test_only_leavers_are_written_again(spark, vectors, monkeypatch):
    """Each part is written once for its first owner; later generations hold the parts that change their entry then."""
    written = []
    plain = vector_codes.written
    monkeypatch.setattr(vector_codes, "written", lambda df, folder, name: (written.append((name, plain(df, folder, name))), written[-1][1])[1])
    rng = random.Random(4)
    rows = [(i, as_float(rng.gauss(0, 0.2) for _ in range(16)), 1) for i in range(200)]
    vector_codes.train(vectors(rows), parts=2, entries=4, rounds=5)
    counts = [df.selectExpr("coalesce(sum(length(part) div 32), 0L)").first()[0] for name, df in written if name.startswith("generation")]  # parts of 8 numbers
    points = [[math.floor(4096 * x) for x in v] for _, v, _ in rows]
    moved = [0] * 4
    for p in range(2):
        own = [v[p * 8 : p * 8 + 8] for v in points]
        entries = [lloyd(own, own[:4], r)[1] for r in range(5)]
        moved = [m + sum(a != b for a, b in zip(entries[r], entries[r + 1], strict=True)) for r, m in enumerate(moved)]
    assert counts == [400, *moved]


# ---------------------------------------------------------------- substring dedup


def brute_dedup(rows, window=13):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - window + 1 if i is not None else 0):
            g = tuple(w[k : k + window])
            least[g] = min(least.get(g, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {q for k in range(len(w) - window + 1) if i is not None and least[tuple(w[k : k + window])] < i for q in range(k, k + window)}
        out.append((str(i), len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone), sorted(gone)))
    return sorted(out)


def check_dedup(documents, rows, **settings):
    kept = substring_dedup.dedup(documents(rows), carry=("score", "spans"), **settings).collect()
    got = sorted((str(r[0]), r["n_words"], r["n_removed"], r["text"], [q for s in r[6] for q in range(s["start"], s["end"])]) for r in kept)
    assert got == brute_dedup(rows)
    assert all(r["score"] == "kept" and r[2] == 7 for r in kept)
    for r in kept:
        assert all(a["end"] < b["start"] for a, b in zip(r[6], r[6][1:], strict=False))


def corpus(rng):
    names = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(names) for _ in range(n))
    passage, line, short = text(60), text(11), text(12)
    rows = [text(rng.randrange(0, 60)) for _ in range(40)]
    rows += [f"{text(20)} {passage} {text(20)}" for _ in range(40)]  # on a third of all texts
    rows += [f"{text(9)}\n{line}\t{text(9)}" for _ in range(30)]  # common, but shorter than a window
    rows += [f"{line} {text(rng.randrange(0, 4))} {line}" for _ in range(30)]
    rows += [" ".join(passage.split()[a : a + 25]) for a in (0, 10, 20, 35)]
    base = text(50)
    rows += [base, base, base.upper(), base.replace(" ", "  "), base[:-1], short, short, f"{short} x", f"{short} x", f"{passage} {passage}"]
    rows += ["a " * 600, "a " * 13, "a " * 12, "a b " * 400, f"{text(3)} {'a ' * 40}", None, "", " \n\t ", "é " * 20 + "字 " * 20, "字 " * 15]
    rng.shuffle(rows)
    pairs = [(3 * i - 50, t) for i, t in enumerate(rows)]
    pairs += [(10, text(20)), (10, passage), (10, passage), (None, passage), (None, base), (0, f"{passage} y")]
    rng.shuffle(pairs)
    return pairs


@pytest.mark.parametrize("settings", [{}, {"shard_words": 50}, {"crowd": 5}, {"crowd": 0}, {"shard_words": 1, "crowd": 30}])
def test_dedup(documents, settings):
    check_dedup(documents, corpus(random.Random(5)), **settings)


def test_dedup_chains(documents):
    """Texts that overlap in ever other stretches: matches that break off and begin again inside one segment."""
    rng = random.Random(6)
    base = [f"v{rng.randrange(40)}" for _ in range(400)]
    rows = []
    for i in range(120):
        a, n = rng.randrange(380), rng.randrange(5, 60)
        cut = base[a : a + n]
        if rng.random() < 0.5 and cut:
            cut[rng.randrange(len(cut))] = "z"
        rows.append((rng.randrange(1000), " ".join(cut)))
    check_dedup(documents, rows)
    check_dedup(documents, rows, shard_words=20)


def test_dedup_edges(documents):
    assert substring_dedup.dedup(documents([])).count() == 0
    long = " ".join(f"n{i}" for i in range(30_000))
    check_dedup(documents, [(1, long), (2, "front " + long), (3, "only")])
    with pytest.raises(ValueError):
        substring_dedup.dedup(documents([]), window=3)


def test_texts_are_dealt_once(spark, documents):
    """Both joins of the texts read one exchange."""
    df = substring_dedup.dedup(documents(corpus(random.Random(7))))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    exchange = r"Exchange hashpartitioning\(doc#\d+L?, key#\d+, \d+\), REPARTITION_BY_COL, \[plan_id=(\d+)\]"
    read = re.findall(rf"\n[ :+-]*{exchange}", final)
    again = re.findall(rf"ReusedExchange .*{exchange}", final)
    assert len(read) == 1 and again == read


def test_index_counts():
    """Backward search finds as many rows as the sequences hold the words, and the least owner among them."""
    rng = np.random.default_rng(8)
    sequences = [rng.integers(1, 5, rng.integers(1, 30)) for _ in range(60)]
    owners = rng.permutation(60)
    starts = np.cumsum([0, *map(len, sequences)])[:-1]
    index = substring_dedup.CompressedIndex(np.concatenate(sequences), starts, owners)
    for _ in range(300):
        word = rng.integers(1, 5, rng.integers(1, 6))
        low, high = np.array([0]), np.array([index.n])
        for symbol in word[::-1]:
            low, high = index.step(np.array([symbol]), low, high)
        places = [(owners[i], k) for i, s in enumerate(sequences) for k in range(len(s) - len(word) + 1) if (s[k : k + len(word)] == word).all()]
        assert high[0] - low[0] == len(places)
        if places:
            assert index.least_owner(low, high)[0] == min(places)[0]
