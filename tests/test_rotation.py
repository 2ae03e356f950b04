"""Windows, covering members, grids, dated scores, containment and public forms against brute force."""

from __future__ import annotations

import json
import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cashlens.functions import redaction as R
from cashlens.operators import containment, rotation, validity

DAY = date(2024, 1, 1)


def nodes(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_window_sums(spark):
    rng = random.Random(1)
    rows = [(k, DAY + timedelta(days=n), Decimal(rng.randrange(-900, 900))) for k in "ab" for n in sorted(rng.sample(range(150), 60))]
    got = rotation.window_sums(spark.createDataFrame(rows, "k string, day date, v decimal(12,2)"), ["k"], "day", ["v"], (1, 5, 60)).collect()
    assert len(got) == len(rows)
    for r in got:
        for n in (1, 5, 60):
            assert r[f"v_{n}"] == sum(v for k, d, v in rows if k == r["k"] and r["day"] - timedelta(days=n - 1) <= d <= r["day"])


@pytest.mark.parametrize("shape", [{}, {"cover": 0.3, "least": 2, "most": 7}, {"least": 1, "most": 1000}])
def test_covering_members(spark, shape):
    rng = random.Random(2)
    rows = [("huge", i, Decimal(rng.randrange(1, 1000))) for i in range(700)] + [(f"k{i % 9}", i, Decimal(rng.randrange(1, 50))) for i in range(80)]
    rows += [("flat", i, Decimal(1)) for i in range(40)] + [("one", 1, Decimal(5)), ("none", 1, None)]
    df = spark.createDataFrame(rows, "k string, m int, v decimal(12,2)").repartition(8)
    got = {}
    for r in rotation.covering_members(df, ["k"], "m", "v", **shape).collect():
        got.setdefault(r["k"], {})[r["rank"]] = (r["m"], r["running"])
    cover, least, most = Decimal(str(shape.get("cover", 0.8))), shape.get("least", 5), shape.get("most", 20)
    want = {}
    for key in {r[0] for r in rows} - {"none"}:
        own = sorted(((-v, m) for k, m, v in rows if k == key))
        total, running = -sum(v for v, _ in own), Decimal(0)
        for rank, (v, m) in enumerate(own, 1):
            if rank > most or (rank > least and running >= cover * total):
                break
            running -= v
            want.setdefault(key, {})[rank] = (m, running)
    assert got == want


def test_heat_grid(spark):
    rng = random.Random(3)
    last = date(2024, 7, 1)
    rows = [(k, last - timedelta(days=7 * w), Decimal(rng.randrange(-50, 50))) for k in "abc" for w in range(-2, 30) if rng.random() < 0.8]
    rows += [("d", last, Decimal(4))]
    got = rotation.heat_grid(spark.createDataFrame(rows, "k string, week date, v decimal(12,2)"), ["k"], "week", "v", F.lit(last)).collect()
    assert {r["k"] for r in got} == set("abcd")
    for r in got:
        cell = {(k, (last - w).days // 7): v for k, w, v in rows}
        now = [cell.get((r["k"], 12 - n)) for n in range(1, 13)]
        assert [r[f"w{n:02d}"] for n in range(1, 13)] == now
        before = [v for n in range(12, 24) if (v := cell.get((r["k"], n))) is not None]
        assert r["total"] == sum(v for v in now if v is not None)
        assert r["change"] == (pytest.approx(float(r["total"]) / float(sum(before)) - 1) if before and sum(before) else None)


def test_value_at(spark):
    rng = random.Random(4)
    intervals = []
    for _ in range(300):
        lo = DAY + timedelta(days=rng.randrange(700))
        intervals.append((rng.choice([1, 2, 3, None]), rng.choice(["MANUAL", "REVIEWED", "OTHER"]), lo, lo + timedelta(days=rng.randrange(-3, 400)), float(rng.randrange(-5, 110)), rng.choice(["s", "s", "s", " "]), rng.choice(["r", "r", "r", None])))
    rows = [(i, rng.choice([1, 2, 3, 4, None]), rng.choice([DAY + timedelta(days=rng.randrange(800)), None]) if rng.random() < 0.2 else DAY + timedelta(days=rng.randrange(800))) for i in range(300)]
    given = spark.createDataFrame(intervals, "k int, kind string, as_of_date date, expires_at date, value double, source string, reason string")
    df = validity.value_at(spark.createDataFrame(rows, "id int, k int, day date"), validity.valid_intervals(given), "id", ["k"], "day")
    got = {r["id"]: (r["score"], r["score_kind"]) for r in df.collect()}
    for i, k, d in rows:
        held = [x for x in intervals if d and k is not None and x[0] == k and x[1] != "OTHER" and x[5].strip() and x[6] and 0 <= x[4] <= 100 and 0 <= (x[3] - x[2]).days <= 365 and x[2] <= d <= x[3]]
        best = min(held, key=lambda x: (x[1], -x[2].toordinal(), -x[3].toordinal(), -x[4])) if held else (None,) * 5
        assert got[i] == (best[4], best[1])
    plan = "".join(nodes(df))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_containment(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab业x") for _ in range(n))
    names = ["", "a", "ab", None] + [word(rng.randrange(1, 12)) for _ in range(120)]
    texts = ["", None, "a"] + [word(rng.randrange(1, 30)) for _ in range(200)]
    df = containment.contained_in(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in texts], "text string"), gram=4)
    want = {(n, t) for n in names if n for t in texts if t and n in t}
    got = [tuple(r) for r in df.collect()]
    assert set(got) == want and len(got) == len(want)
    plan = "".join(nodes(df))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_targets(spark):
    master = spark.createDataFrame([(1, "海天-S"), (2, "长江电力"), (3, "X-W"), (4, None), (5, "")], "id int, name string")
    archives = spark.createDataFrame([("01_长江电力_年报",), ("2016海天味业",), (None,)], "archive_name string")
    wanted = spark.createDataFrame([(2,), (3,), (9,)], "id int")
    targets, outside = containment.target_companies(master, archives, wanted)
    assert [r["id"] for r in targets.collect()] == [3] and sorted(r["id"] for r in outside.collect()) == [2, 9]
    assert sorted(r["id"] for r in containment.target_companies(master, archives)[0].collect()) == [3, 4, 5]


def plain(value, depth=0):
    if depth > 5:
        return R.TOO_DEEP
    if isinstance(value, dict):
        return {k: plain(v, depth + 1) for k, v in list(value.items())[:100] if not R.is_hidden(k)}
    if isinstance(value, list):
        return [plain(v, depth + 1) for v in value[:100]]
    if isinstance(value, str):
        return R.LOCAL_PATH if value.startswith(("/", "~/")) or "/home/" in value or "/var/lib/" in value else value[:2000]
    return value


def test_typed_values(spark):
    schema = "v struct<name:string,Api_Token:string,list:array<struct<path:string,my_secret:int,n:int>>,map:map<string,string>,only:struct<token:int>,n:bigint>"
    value = {
        "name": "x" * 3000, "Api_Token": "t", "list": [{"path": "/etc", "my_secret": 1, "n": 2}, {"path": None, "my_secret": None, "n": None}] * 80,
        "map": {f"k{i:03d}": "in /home/me" if i % 3 else "ok" for i in range(130)} | {"stderr_log": "x"}, "only": {"token": 1}, "n": 5,
    }
    df = spark.createDataFrame([(value,), (None,)], schema)
    got = [r["v"] for r in R.redacted_columns(df, ["v"]).select(F.to_json("v", {"ignoreNullFields": "false"}).alias("v")).collect()]
    assert got[1] is None
    shown, want = json.loads(got[0]), plain(value)
    assert {k: shown[k] for k in ("name", "list", "only", "n")} == {k: want[k] for k in ("name", "list", "only", "n")} and "Api_Token" not in shown
    # a map keeps the order in which Spark holds it
    assert len(shown["map"]) <= 100 and all(v in ("ok", R.LOCAL_PATH) for v in shown["map"].values()) and "stderr_log" not in shown["map"]


def test_json_values(spark):
    docs = [
        {"a": {"b": {"c": {"d": {"e": {"f": {"g": 1}}}}}}}, {"a": {"b": {"c": {"d": {"e": {"f": 2}}}}}}, {"list": [[["/x", "y"]], []], "secret_list": [1]},
        {"mixed": "/etc/x"}, {"mixed": {"password": "p", "token": "t"}}, {"mixed": 7}, {}, {"n": 1.5, "t": True, "z": None},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(docs)] + [(90, None), (91, "{broken")], "id int, doc string")
    got = {r["id"]: r["p"] for r in R.redacted_json(df, "doc", "p").collect()}
    assert got[90] is None and got[91] is None
    for i in (2, 6):
        assert json.loads(got[i]) == plain(docs[i])
    assert json.loads(got[1]) == plain(docs[1]) and "1" not in got[0]
    assert json.loads(got[3]) == {"mixed": R.LOCAL_PATH} and json.loads(got[4]) == {"mixed": R.TOO_MIXED} and json.loads(got[5]) == {"mixed": "7"}
    flat = spark.createDataFrame([('"~/x"',), ('"y"',)], "doc string")
    assert [r["p"] for r in R.redacted_json(flat, "doc", "p").collect()] == [R.LOCAL_PATH, "y"]
