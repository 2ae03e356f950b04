"""A source whose rows come from an injected fetch function, as a Python data source for batch reads and streams.

``fetch(codes, bounds)`` yields Arrow record batches of the given codes; ``bounds`` are (column, operator, value) tests that
every row has to pass. Codes are cut into calls of ``batch_size``, one partition each, so calls run on the executors side
by side. Filters on the code narrow the list of codes, and comparisons of a pushed column reach the fetch as bounds.
As a stream the source is read by a sequence column: a batch is a range of it, so a batch that is run again reads the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

Bound = tuple[str, str, object]
Fetch = Callable[[list, list[Bound]], Iterable[pa.RecordBatch]]
OPERATORS = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


@dataclass
class Call(InputPartition):
    """One call of the fetch function."""

    codes: list
    bounds: list


@dataclass
class Injected:
    """What is injected: the fetch, its codes and schema, and for streams the largest sequence number so far."""

    fetch: Fetch
    codes: list
    schema: str
    code: str = "code"
    pushed: Sequence[str] = ()
    sequence: str | None = None
    latest: Callable[[], int] | None = None
    batch_size: int = 20


def calls(codes: list, bounds: list[Bound], size: int) -> list[Call]:
    return [Call(codes[i : i + size], bounds) for i in range(0, len(codes), size)]


class InjectedReader(DataSourceReader):
    def __init__(self, injected: Injected):
        self.injected = injected
        self.codes, self.bounds = sorted(set(injected.codes)), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrows the codes and takes the bounds; filters that the fetch cannot test are given back to Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name == self.injected.code and isinstance(f, EqualTo):
                self.codes = [x for x in self.codes if x == f.value]
            elif name == self.injected.code and isinstance(f, In):
                self.codes = [x for x in self.codes if x in f.value]
            elif name in self.injected.pushed and type(f) in OPERATORS:
                self.bounds.append((name, OPERATORS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        # no codes are no call: one empty partition keeps the schema
        return calls(self.codes, self.bounds, self.injected.batch_size) or [Call([], [])]

    def read(self, partition: Call) -> Iterator[pa.RecordBatch]:
        if partition.codes:
            yield from self.injected.fetch(partition.codes, partition.bounds)


class InjectedStream(DataSourceStreamReader):
    """Offsets are sequence numbers: a batch has the rows from its start (included) to its end (excluded)."""

    def __init__(self, injected: Injected, step: int | None):
        self.injected, self.step = injected, step
        self.at = None

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        end = self.injected.latest() + 1
        if self.step is not None:
            end = min(end, (self.at or 0) + self.step)
        self.at = max(self.at or 0, end)
        return {"next": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at or 0, end["next"])
        if start["next"] >= end["next"]:
            return [Call([], [])]
        name = self.injected.sequence
        bounds = [(name, ">=", start["next"]), (name, "<", end["next"])]
        return calls(sorted(set(self.injected.codes)), bounds, self.injected.batch_size) or [Call([], [])]

    def read(self, partition: Call) -> Iterator[pa.RecordBatch]:
        if partition.codes:
            yield from self.injected.fetch(partition.codes, partition.bounds)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def register(spark: SparkSession, name: str, injected: Injected) -> str:
    """Make the injected source known as a format of the session; option ``step`` bounds a batch of a stream."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return injected.schema

        def reader(self, schema) -> DataSourceReader:
            return InjectedReader(injected)

        def streamReader(self, schema) -> DataSourceStreamReader:
            step = self.options.get("step")
            return InjectedStream(injected, None if step is None else int(step))

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Source)
    return name


def parquet_fetch(path: str, columns: dict[str, str], code: str) -> Fetch:
    """A fetch that serves the rows of a table: ``columns`` maps the source's columns to the table's."""

    def fetch(codes: list, bounds: list[Bound]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        test = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}
        wanted = ds.field(columns[code]).isin(codes)
        for name, operator, value in bounds:
            wanted &= getattr(ds.field(columns[name]), test[operator])(value)
        found = ds.dataset(path).scanner(columns={k: ds.field(v) for k, v in columns.items()}, filter=wanted)
        for batch in found.to_batches():
            if len(batch):
                yield batch

    return fetch


def parquet_latest(path: str, column: str) -> Callable[[], int]:
    """The largest value of a column, from the statistics in the files' footers."""

    def latest() -> int:
        import pyarrow.dataset as ds

        best = -1
        for fragment in ds.dataset(path).get_fragments():
            meta = fragment.metadata
            at = meta.schema.names.index(column)
            best = max([best, *[int(meta.row_group(g).column(at).statistics.max) for g in range(meta.num_row_groups)]])
        return best

    return latest
