"""Hot-key-safe building blocks against brute force."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from cashlens.operators.scale import earliest_by, exact_median, lag_in_buckets, latest_by, running_in_buckets


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(900):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(20)}"
        out.append((key, i // 3, i, rng.choice([None, -1.5, 0.0, 2.25, rng.uniform(-1e6, 1e6)])))
    rng.shuffle(out)
    return out


SCHEMA = "k string, t int, seq int, v double"


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


def test_exact_median(spark, rows):
    got = {r.k: r.m for r in exact_median(spark.createDataFrame(rows, SCHEMA), ["k"], "v", "m").collect()}
    for k, g in by_key(rows).items():
        values = [r[3] for r in g if r[3] is not None]
        assert got.get(k) == pytest.approx(statistics.median(values)) if values else k not in got


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [0.0, 0.0, -3.0], [-1e-9, 1e-9, 7.0, 7.0], [1e300, -1e300, 4.0]])
def test_exact_median_small(spark, values):
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    assert exact_median(df, ["k"], "v", "m").first().m == pytest.approx(statistics.median(values))


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_lag_in_buckets(spark, rows, width):
    df = spark.createDataFrame(rows, SCHEMA)
    out = lag_in_buckets(df, ["k"], ["t", "seq"], F.floor(F.col("t") / width), "v", "before").collect()
    got = {r.seq: r.before for r in out}
    assert len(out) == len(rows)
    for g in by_key(rows).values():
        for i, r in enumerate(g):
            assert got[r[2]] == (g[i - 1][3] if i else None)


def test_running_in_buckets(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = running_in_buckets(
        df, ["k"], ["t", "seq"], F.floor(F.col("t") / 25), {"s": ("sum", F.col("seq")), "m": ("max", F.col("v"))}
    ).collect()
    got = {r.seq: (r.s, r.m) for r in out}
    for g in by_key(rows).values():
        total, best = 0, None
        for r in g:
            total += r[2]
            best = r[3] if best is None else best if r[3] is None else max(best, r[3])
            assert got[r[2]] == (total, best)


def test_latest_and_earliest(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    late = {r.k: r.seq for r in latest_by(df, ["k"], [F.col("t"), F.col("seq")]).collect()}
    early = {r.k: r.seq for r in earliest_by(df, ["k"], [F.col("t"), F.col("seq")]).collect()}
    for k, g in by_key(rows).items():
        assert (late[k], early[k]) == (g[-1][2], g[0][2])


def test_null_keys_keep_their_carry(spark):
    from cashlens.operators.scale import exact_median, lag_in_buckets, running_in_buckets

    rows = [(1, None, 1, 1.0), (1, None, 150, 3.0), (1, None, 250, 4.0), (1, "A", 5, 9.0)]
    df = spark.createDataFrame(rows, "company_id int, security_id string, seq int, v double")
    keys, bucket = ["company_id", "security_id"], F.floor(F.col("seq") / 100)
    lagged = lag_in_buckets(df, keys, ["seq"], bucket, "v", "before").where("security_id is null").orderBy("seq").collect()
    assert [r.before for r in lagged] == [None, 1.0, 3.0]
    total = running_in_buckets(df, keys, ["seq"], bucket, {"n": ("sum", F.lit(1))}).where("security_id is null").orderBy("seq").collect()
    assert [r.n for r in total] == [1, 2, 3]
    median = {r.security_id: r.m for r in exact_median(df, ["security_id"], "v", "m").collect()}
    assert median == {None: 3.0, "A": 9.0}
