"""Streams against their batch forms, restarts, injected sources and publication."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cashlens.operators import ledger
from cashlens.operators.events import revisions
from cashlens.sources import injected, publish
from cashlens.streaming import feed, refresh_stream, restatement_stream
from cashlens.streaming.change_capture import run_available

START = datetime(2024, 1, 1)
ROWS = "company_id bigint, at timestamp, success boolean, in_zone boolean, days int"


def day(n):
    return START + timedelta(days=n)


def pages_of(spark, rows, schema, path, n):
    """One file per page."""
    size = -(-len(rows) // n)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.mode("append").parquet(path)


def refreshes(spark, pages, target, delay, idle=None):
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(pages)
    run_available(refresh_stream.refresh_stream(stream, delay, idle), target)
    return sorted(tuple(r) for r in spark.read.schema("company_id bigint, due_at timestamp, refresh_days int, success_at timestamp").parquet(f"{target}/data").collect())


def test_due_without_input(spark, tmp_path):
    """Company 1 is silent after its success; the rows of company 2 move the watermark past its due time."""
    rows = [(1, day(0), False, True, 30), (1, day(1), True, False, 0), (2, day(40), False, False, 90)]
    pages_of(spark, rows, ROWS, str(tmp_path / "pages"), 3)
    got = refreshes(spark, str(tmp_path / "pages"), str(tmp_path / "out"), "1 day")
    assert got == [(1, day(31), 30, day(1))]


def test_state_after_restart(spark, tmp_path):
    pages, target = str(tmp_path / "pages"), str(tmp_path / "out")
    pages_of(spark, [(1, day(0), False, True, 30), (1, day(1), True, False, 0), (2, day(20), False, False, 90)], ROWS, pages, 1)
    assert refreshes(spark, pages, target, "1 day") == []
    pages_of(spark, [(2, day(35), False, False, 90)], ROWS, pages, 1)
    assert refreshes(spark, pages, target, "1 day") == [(1, day(31), 30, day(1))]
    pages_of(spark, [(1, day(40), True, False, 0), (2, day(80), False, False, 90)], ROWS, pages, 1)
    assert refreshes(spark, pages, target, "1 day") == [(1, day(31), 30, day(1)), (1, day(70), 30, day(40))]


@pytest.mark.parametrize("seed", [1, 2])
def test_refreshes_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = []
    for company in range(8):
        at = 0.0
        for _ in range(60):
            at += rng.choice([0.3, 1, 4, 9])
            moment = START + timedelta(days=at, microseconds=rng.randrange(10**6))
            rows.append((company, moment, True, False, 0) if rng.random() < 0.15 else (company, moment, False, rng.random() < 0.5, rng.choice([30, 90])))
    rows.sort(key=lambda r: r[1] + timedelta(days=rng.uniform(0, 3)))  # up to three days late
    last = max(r[1] for r in rows)
    until = last.replace(microsecond=last.microsecond // 1000 * 1000) - timedelta(days=4)
    batch = refresh_stream.due_refreshes(spark.createDataFrame(rows, ROWS), F.lit(until))
    want = sorted(tuple(r) for r in batch.collect())
    pages_of(spark, rows, ROWS, str(tmp_path / "pages"), 6)
    assert refreshes(spark, str(tmp_path / "pages"), str(tmp_path / "out"), "4 days") == want and want


def test_idle_state_goes(spark, tmp_path):
    """A company without rows for ten days is forgotten, and with it its success."""
    pages, target = str(tmp_path / "pages"), str(tmp_path / "out")
    pages_of(spark, [(1, day(0), False, True, 30), (1, day(1), True, False, 0)], ROWS, pages, 1)
    pages_of(spark, [(2, day(20), False, False, 90)], ROWS, pages, 1)
    pages_of(spark, [(2, day(60), False, False, 90)], ROWS, pages, 1)
    assert refreshes(spark, pages, target, "1 day", idle=10) == []


# ---------------------------------------------------------------- restatements

POINTS = "company_id bigint, field_id string, security_id string, fiscal_period string, source_document string, source_fetch_time timestamp, ingest_seq bigint, value double"


def points(rng, n):
    rows = []
    for i in range(n):
        rows.append((rng.randrange(9), rng.choice("ab"), rng.choice([None, "s"]), "FY", "doc", START + timedelta(hours=rng.randrange(200)), i, float(i)))
    return rows


def newest(df):
    return sorted(map(str, ledger.latest_restatements(df).collect()))


def test_restatements_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    rows = points(rng, 400)
    rng.shuffle(rows)
    pages_of(spark, rows, POINTS, str(tmp_path / "pages"), 8)
    stream = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pages"))
    query = run_available(restatement_stream.newest_rows(stream, "10 days"), str(tmp_path / "out"))
    emitted = spark.read.parquet(str(tmp_path / "out/data"))
    assert newest(emitted) == newest(spark.createDataFrame(rows, POINTS)) and restatement_stream.late_rows(query) == 0
    assert emitted.count() < len(rows)


def test_late_rows_are_counted_apart(spark, tmp_path):
    old = (1, "a", None, "FY", "doc", day(0), 1, 1.0)
    new = (1, "a", None, "FY", "doc", day(30), 2, 2.0)
    other = (2, "a", None, "FY", "doc", day(40), 3, 3.0)
    pages_of(spark, [new, other, old, (3, "a", None, "FY", "doc", day(39), 4, 4.0)], POINTS, str(tmp_path / "pages"), 4)
    stream = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pages"))
    query = run_available(restatement_stream.newest_rows(stream, "2 days"), str(tmp_path / "out"))
    got = sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "out/data")).collect())
    assert got == [2.0, 3.0, 4.0] and restatement_stream.late_rows(query) == 1


class Handle:
    """A group's state value and timers, with the calls counted."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        self.calls += 1
        return iter(sorted(self.timers))

    def deleteTimer(self, at):
        self.timers.discard(at)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_state_calls_do_not_grow_with_identities():
    """A thousand identities of one group cost as many state calls as one; a passed place leaves the state."""
    handle, processor = Handle(), restatement_stream.NewestRow(["v"])
    processor.init(handle)

    def handed(watermark, *batches):
        frames = [pd.DataFrame(rows, columns=["high", "low", "fetch_us", "ingest_no", "v"]) for rows in batches]
        return sorted(v for out in processor.handleInputRows((1,), iter(frames), Watermark(watermark)) for v in out["v"])

    many = [(n, -n, 5_000, n, n) for n in range(1000)]
    assert handed(0, many, [(3, -3, 6_000, 9, 5000), (3, -3, 4_000, 9, 5001)]) == sorted([5000, *(n for n in range(1000) if n != 3)])
    assert handle.calls == 4 and handle.timers == {7}
    # older and equal rows stay behind, on equal time the smaller ingest number is newer, other halves of a hash are others
    assert handed(0, [(4, -4, 4_999, 0, 1), (5, -5, 5_000, 5, 2), (6, -6, 5_000, 5, 3), (7, -8, 1, 1, 4)]) == [3, 4]
    assert handed(6, [(8, -8, 9_000, 1, 5)]) == [5] and len(handle.value[0]) == 2 * restatement_stream.PLACE.itemsize
    assert handle.timers == {10}


# ---------------------------------------------------------------- the feed

OBSERVED = "event_key string, payload_hash string, observed_at timestamp, batch_seq bigint"


def test_feed_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"k{rng.randrange(12)}", f"h{rng.randrange(4)}", START + timedelta(minutes=i), i) for i in range(300)]
    pages, root = str(tmp_path / "pages"), str(tmp_path / "feed")
    as_is = lambda df: df
    pages_of(spark, rows[:180], OBSERVED, pages, 5)
    feed.read_feed(spark, pages, OBSERVED, root, as_is, pages_per_batch=2)  # bootstrap, two pages a batch
    pages_of(spark, rows[150:240], OBSERVED, pages, 1)  # the newest page repeats what is known
    feed.read_feed(spark, pages, OBSERVED, root, as_is)
    feed.read_feed(spark, pages, OBSERVED, root, as_is)  # nothing new
    pages_of(spark, rows[230:], OBSERVED, pages, 1)
    feed.read_feed(spark, pages, OBSERVED, root, as_is)
    got = sorted(tuple(r) for r in feed.revision_log(spark, root).collect())
    assert got == sorted(tuple(r) for r in revisions(spark.createDataFrame(rows, OBSERVED)).collect())
    feed.revise(f"{root}/log")(spark.createDataFrame(rows[:50], OBSERVED), 0)  # a batch that is run again
    assert feed.revision_log(spark, root).count() == len(got)


def test_feed_with_a_lower_bound(spark, tmp_path):
    rows = [("a", "x", day(0), 1), ("a", "y", day(5), 2), ("b", "x", day(6), 3)]
    pages_of(spark, rows, OBSERVED, str(tmp_path / "pages"), 1)
    feed.read_feed(spark, str(tmp_path / "pages"), OBSERVED, str(tmp_path / "feed"), lambda df: df, lower=F.lit(day(5)))
    got = sorted((r["event_key"], r["change_kind"]) for r in feed.revision_log(spark, str(tmp_path / "feed")).collect())
    assert got == [("a", "new"), ("b", "new")]


# ---------------------------------------------------------------- injected sources


def test_injected_reader(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def fetch(codes, bounds):
        (log / f"{min(codes)}-{max(codes)}-{len(codes)}-{len(bounds)}").touch()
        rows = [(x, float(k), k) for x in codes for k in range(5)]
        for name, operator, value in bounds:
            assert (name, operator) == ("seq", ">=")
            rows = [r for r in rows if r[2] >= value]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["code", "price", "seq"])

    source = injected.Injected(fetch, [f"c{i:02d}" for i in range(30)] + ["c01"], "code string, price double, seq bigint", pushed=("seq",), batch_size=8)
    df = spark.read.format(injected.register(spark, "given_quotes", source)).load()
    assert df.count() == 150 and len(list(log.iterdir())) == 4  # 30 codes in calls of 8
    for f in log.iterdir():
        f.unlink()
    got = df.where("code in ('c03', 'c04', 'zz') and seq >= 3 and price <> 4.0").collect()
    assert sorted((r["code"], r["seq"]) for r in got) == [("c03", 3), ("c04", 3)]
    assert [f.name for f in log.iterdir()] == ["c03-c04-2-1"]
    assert df.where("code = 'none'").collect() == []


def test_injected_stream(spark, tmp_path):
    end = tmp_path / "end"
    end.write_text("9")

    def fetch(codes, bounds):
        low = next(v for _, o, v in bounds if o == ">=")
        high = next(v for _, o, v in bounds if o == "<")
        rows = [(x, k) for x in codes for k in range(low, high)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["code", "seq"])

    source = injected.Injected(fetch, ["a", "b", "c"], "code string, seq bigint", sequence="seq", latest=lambda: int(end.read_text()), batch_size=2)
    name = injected.register(spark, "given_stream", source)

    def take():
        rows = spark.readStream.format(name).option("step", "4").load()
        query = rows.writeStream.format("parquet").option("path", f"{tmp_path}/data").option("checkpointLocation", f"{tmp_path}/checkpoint").start()
        query.processAllAvailable()
        query.stop()
        return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/data").collect())

    assert take() == [(x, k) for x in "abc" for k in range(10)]
    end.write_text("12")  # a restart goes on behind the last batch
    assert take() == [(x, k) for x in "abc" for k in range(13)]


# ---------------------------------------------------------------- publication


def table(spark, rows):
    return spark.createDataFrame(rows, "id bigint, v double")


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_publication(spark, tmp_path):
    root = str(tmp_path / "p")
    one, two = [(1, 1.0), (2, 2.0)], [(2, 5.0), (1, 4.0)]
    assert publish.current(spark, root) is None
    first = publish.publish(table(spark, one), root, 1, ["id"])
    assert first["status"] == "PUBLISHED" and values(publish.current(spark, root)) == one
    again = publish.publish(table(spark, two), root, 1, ["id"])  # a repeated batch id changes nothing
    assert again == first and values(publish.current(spark, root)) == one
    assert publish.publish(table(spark, two[:1]), root, 2, ["id"])["status"] == "REJECTED"
    assert publish.publish(table(spark, [*two, (1, 9.0)]), root, 3, ["id"])["status"] == "REJECTED"  # a repeated key is another universe
    assert publish.publish(table(spark, []), root, 4, ["id"])["status"] == "EMPTY"
    assert publish.publish(table(spark, two), root, 5, ["id"], violations=lambda df: df.where("v > 4"))["status"] == "REJECTED"
    assert values(publish.current(spark, root)) == one
    done = publish.publish(table(spark, two), root, 6, ["id"])
    assert done["signature"] == first["signature"] and values(publish.current(spark, root)) == sorted(two)


def test_stopped_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "p")
    publish.publish(table(spark, [(1, 1.0)]), root, 1, ["id"])

    def stop(*_, **__):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(publish, "_pointed", stop)
        with pytest.raises(RuntimeError):
            publish.publish(table(spark, [(1, 2.0)]), root, 2, ["id"])
    assert values(publish.current(spark, root)) == [(1, 1.0)]
    publish.publish(table(spark, [(1, 3.0)]), root, 2, ["id"])
    assert values(publish.current(spark, root)) == [(1, 3.0)]


def test_history_takes_a_batch_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "h")
    schema = "id bigint, h string"
    batches = {1: [(1, "a"), (2, "b")], 2: [(1, "a"), (2, "c"), (3, "d")], 3: [(1, "x"), (3, "d")]}
    write = lambda k: publish.append_changed_once(spark.createDataFrame(batches[k], schema), root, k, ["id"], "h")
    write(1)
    plain = publish.publish
    with monkeypatch.context() as m:  # stopped between the log and the latest table
        m.setattr(publish, "publish", lambda df, path, *a, **b: plain(df, path, *a, **b) if path.endswith("history") else (_ for _ in ()).throw(RuntimeError()))
        with pytest.raises(RuntimeError):
            write(2)
    for k in (2, 2, 3, 1):
        write(k)
    assert values(publish.current(spark, f"{root}/latest")) == batches[3]
    assert values(publish.logged(spark, f"{root}/history")) == [(1, "a"), (1, "x"), (2, "b"), (2, "c"), (3, "d")]


def test_signature(spark):
    sign = lambda rows: publish.signature(spark.createDataFrame(rows, "a string, b bigint"), ["a", "b"]).first()
    rows = [("x", 1), ("y", None), (None, 1), ("x", 1)]
    assert sign(rows)["signature"] == sign(rows[::-1])["signature"] and len(sign(rows)["signature"]) == 64
    assert sign(rows)["signature"] != sign(rows[:3])["signature"] != sign([("x1", None)])["signature"]
    empty = sign([])
    assert (empty["signature"], empty["records"]) == ("0" * 64, 0)
