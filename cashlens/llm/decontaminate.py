"""Benchmark decontamination: an FM-index over each shard of the training text, searched for benchmark windows.

Words are lower-cased (A-Z) runs of digits, letters a-z and characters beyond ASCII. A window is ``window``
consecutive words of an item; a shorter item with words is one window. Every document word inside an occurrence
of a window is hit.

How a shard works: its words become numbers (0: in no benchmark item). Only runs of known words as long as the
shortest window can hold an occurrence, so the index keeps those runs, each closed by a mark of its own. The
Burrows-Wheeler column of that text sits in a wavelet tree; all windows walk backwards through its ranks at once,
and occurrences are located from sampled suffix positions. Whole documents stay in one shard and a shard closes
at ``shard_words`` words, so memory is bounded by that and by the longest document. Nothing is shuffled.

The benchmark is the stated query set: it is cut into blocks of at most ``block_windows`` distinct windows, and
each block is one broadcast of bounded size and one pass over the documents.

Defined cases: null or word-free texts have 0 words and no hits; null item texts are left out, and null item ids unless
``unnamed`` is set (the query and the pipeline set it: all such items stand as one null, last in the items); an empty benchmark hits nothing; repeated documents and repeated items count each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashlens.llm.common import LETTERS, LOWER, code_points, replace_spans, span_hashes, text_slices, word_spans

# ---------------------------------------------------------------- the index


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by doubling the compared length. All-different marks bound the work."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, step = len(text), 1
    while True:
        tail = np.zeros(n, np.int64)
        tail[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + tail
        order = np.argsort(key)
        new = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2
        if step >= n:
            return order


class WaveletTree:
    """Ranks over a sequence of numbers below 2**bits: one bit vector with running counts per level."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.ones, self.zeros = [], []
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int64))
            self.zeros.append(len(sequence) - int(self.ones[-1][-1]))
            sequence = np.r_[sequence[bit == 0], sequence[bit == 1]]
        self.bits = bits

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low = np.zeros(len(at), np.int64)
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((symbol >> (self.bits - 1 - i)) & 1).astype(bool)
            low = np.where(bit, zeros + ones[low], low - ones[low])
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return symbol


class FMIndex:
    """Backward search over runs of word numbers (1 and up). Runs never join: each is closed by its own mark."""

    def __init__(self, words: np.ndarray, run_starts: np.ndarray, sample: int = 16):
        marks = len(run_starts)
        n = len(words) + marks
        place = np.arange(len(words)) + np.searchsorted(run_starts, np.arange(len(words)), side="right") - 1
        text = np.empty(n, np.int64)
        ends = np.ones(n, bool)
        ends[place] = False
        text[place] = words + marks  # marks sort first, each with its own number
        text[ends] = np.arange(1, marks + 1)
        order = suffix_order(text)
        plain = np.zeros(n, np.int64)
        plain[place] = words
        before = plain[order - 1]  # 0 before a run's first word: the walk ends there
        self.n, self.word_at = n, np.cumsum(~ends) - 1
        self.tree = WaveletTree(before, max(1, int(words.max()).bit_length()))
        self.first = np.cumsum(np.r_[0, np.bincount(plain, minlength=int(words.max()) + 1)])
        sampled = (order % sample == 0) | (before == 0)
        self.sampled_before = np.r_[0, np.cumsum(sampled)]
        self.positions = order[sampled]

    def search(self, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each pattern; all patterns (rows of one length) walk together."""
        low, high = np.zeros(len(pattern), np.int64), np.full(len(pattern), self.n, np.int64)
        known = len(self.first) - 1
        alive = np.flatnonzero((pattern > 0).all(1) & (pattern < known).all(1))
        dead = np.ones(len(pattern), bool)
        dead[alive] = False
        high[dead] = 0
        for column in range(pattern.shape[1] - 1, -1, -1):
            symbol = pattern[alive, column]
            low[alive] = self.first[symbol] + self.tree.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.tree.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The word number at which each row's suffix begins."""
        found, rows, steps = np.empty(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            done = self.sampled_before[at + 1] > self.sampled_before[at]
            hit = open_[done]
            found[hit] = self.positions[self.sampled_before[rows[hit]]] + steps[hit]
            open_ = open_[~done]
            at = rows[open_]
            symbol = self.tree.access(at)
            rows[open_] = self.first[symbol] + self.tree.rank(symbol, at)
            steps[open_] += 1
        return self.word_at[found]


# ---------------------------------------------------------------- windows and shards


class Windows:
    """The distinct windows of a block of benchmark items, by length, as numbers of known words."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.ids: list[str] = []
        owners: dict[tuple[int, ...], set[int]] = {}
        column = pa.array([text for _, text in items], pa.string())
        hashes: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(items)
        for first, end, raw, at in text_slices(column):
            raw = LOWER[raw]
            rows, starts, ends = word_spans(raw, at, LETTERS)
            values = span_hashes(raw, starts, ends)
            for k in range(first, end):
                hashes[k] = values[rows == k - first]
        self.known = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
        for (item_id, _), words in zip(items, hashes, strict=True):
            if len(words):
                self.ids.append(item_id)
                numbers = np.searchsorted(self.known, words) + 1
                size = min(window, len(words))
                for i in range(len(words) - size + 1):
                    owners.setdefault(tuple(numbers[i : i + size].tolist()), set()).add(len(self.ids) - 1)
        self.by_length: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for size in sorted({len(x) for x in owners}):
            own = [x for x in owners if len(x) == size]
            self.by_length[size] = np.array(own, np.int64), [sorted(owners[x]) for x in own]
        self.shortest = min(self.by_length, default=0)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, 0)


def shard_hits(numbers: np.ndarray, rows: np.ndarray, windows: Windows) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which words of a shard are hit, and (row, item) pairs; ``rows`` has the document of each word, ascending."""
    hit = np.zeros(len(numbers), bool)
    if not windows.by_length or not len(numbers):
        return hit, []
    known = numbers > 0
    edge = np.r_[True, (rows[1:] != rows[:-1]) | (known[1:] != known[:-1])]
    run = np.cumsum(edge) - 1
    long_enough = np.bincount(run)[run] >= windows.shortest
    kept = np.flatnonzero(known & long_enough)
    if not len(kept):
        return hit, []
    run_starts = np.flatnonzero(np.r_[True, run[kept][1:] != run[kept][:-1]])
    index = FMIndex(numbers[kept], run_starts)
    pairs: set[tuple[int, int]] = set()
    cover = np.zeros(len(numbers) + 1, np.int64)
    for size, (patterns, owners) in windows.by_length.items():
        low, high = index.search(patterns)
        found = high - low
        which = np.repeat(np.arange(len(patterns)), found)
        at = np.arange(len(which)) - np.repeat(np.cumsum(found) - found, found) + low[which]
        at = kept[index.locate(at)]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + size, -1)
        seen = np.unique(np.stack([rows[at], which], 1), axis=0)
        pairs.update((row, item) for row, k in seen.tolist() for item in owners[k])
    return np.cumsum(cover)[:-1] > 0, sorted(pairs)


def spans_of(hit: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Neighbouring hit words of one document merge into one span, from the first word's start to the last's end."""
    at = np.flatnonzero(hit)
    out: dict[int, list[tuple[int, int]]] = {}
    if len(at):
        new = np.r_[True, (np.diff(at) > 1) | (np.diff(rows[at]) > 0)]
        first, last = at[new], at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]]
        for row, a, b in zip(rows[first].tolist(), starts[first].tolist(), ends[last].tolist(), strict=True):
            out.setdefault(row, []).append((a, b))
    return out


def benchmark_blocks(benchmark: DataFrame, window: int, block_windows: int, unnamed: bool = False) -> Iterator[list[tuple[str | None, str]]]:
    """The query set in blocks; the driver holds one block at a time."""
    block, size = [], 0
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"))
    for row in items.where("t is not null" if unnamed else "i is not null and t is not null").toLocalIterator():
        count = len(row.t) // 2 + 1  # no text has more words, so none has more windows
        if block and size + count > block_windows:
            yield block
            block, size = [], 0
        block.append((row.i, row.t))
        size += count
    yield block


def find_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    shard_words: int = 1_000_000,
    block_windows: int = 1_000_000,
    carry: tuple[str, ...] = (),
    unnamed: bool = False,
) -> DataFrame:
    """doc_id, text, ``carry``, n_words, items (ids of items with occurring windows), hits (hit words) and spans (hit
    characters) per row. With more than one block ``merge_blocks`` unites what the blocks found.
    """
    documents = documents.select("doc_id", "text", *carry)
    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType(list(documents.schema.fields))
    schema = schema.add("n_words", T.LongType()).add("items", T.ArrayType(T.StringType())).add("hits", spans_type).add("spans", spans_type)
    frames = []
    for items in benchmark_blocks(benchmark, window, block_windows, unnamed):
        shared = documents.sparkSession.sparkContext.broadcast(Windows(items, window))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            windows: Windows = shared.value
            held: list[tuple] = []
            for batch in batches:
                for first, end, raw, at in text_slices(batch.column(1)):
                    low = LOWER[raw]
                    rows, starts, ends = word_spans(low, at, LETTERS)
                    numbers = windows.number(span_hashes(low, starts, ends))
                    held.append((batch.slice(first, end - first), raw, at, rows, starts, ends, numbers))
                    if sum(len(x[-1]) for x in held) >= shard_words:
                        yield from close(held, windows)
                        held = []
            if held:
                yield from close(held, windows)

        frames.append(documents.mapInArrow(search, schema))
    if len(frames) == 1:
        return frames[0]
    return merge_blocks(frames, ["doc_id", "text", *carry])


def close(held: list[tuple], windows: Windows) -> Iterator[pa.RecordBatch]:
    """Index and search one shard, and return its documents with what was found."""
    counts = [len(x[0]) for x in held]
    base = np.r_[0, np.cumsum(counts)]
    rows = np.concatenate([x[3] + b for x, b in zip(held, base, strict=False)])
    hit, pairs = shard_hits(np.concatenate([x[6] for x in held]), rows, windows)
    items: dict[int, set[str | None]] = {}
    for row, item in pairs:
        items.setdefault(row, set()).add(windows.ids[item])
    word = 0
    pair_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for (batch, raw, at, own, starts, ends, numbers), b in zip(held, base, strict=False):
        here = hit[word : word + len(numbers)]
        word += len(numbers)
        n_words = np.bincount(own, minlength=len(batch))
        spans: dict[int, list[tuple[int, int]]] = {}
        hits: dict[int, list[tuple[int, int]]] = {}
        if here.any():
            chars = code_points(raw, at)
            head = chars[at[:-1]]
            spans = spans_of(here, own, chars[starts] - head[own], chars[ends] - head[own])
            number = np.arange(len(own)) - np.searchsorted(own, np.arange(len(batch)))[own]
            hits = spans_of(here, own, number, number + 1)
        as_pairs = lambda found: pa.array([[{"start": p, "end": q} for p, q in found.get(k, ())] for k in range(len(batch))], pair_type)
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns,
                pa.array(n_words, pa.int64()),
                pa.array([sorted(items.get(k + int(b), ()), key=lambda x: (x is None, x)) for k in range(len(batch))], pa.list_(pa.string())),
                as_pairs(hits),
                as_pairs(spans),
            ],
            names=[*batch.schema.names, "n_words", "items", "hits", "spans"],
        )


def merge_blocks(frames: list[DataFrame], row: list[str]) -> DataFrame:
    """Unite what several blocks of the benchmark found. Equal rows are the same document."""
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame)
    grouped = union.groupBy(*row).agg(
        F.max("n_words").alias("n_words"),
        F.count("*").alias("_rows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("hits")).alias("hits"),
        F.flatten(F.collect_list("spans")).alias("spans"),
    )
    copies = F.explode(F.expr(f"sequence(1, cast(_rows / {len(frames)} as int))"))
    merged = grouped.withColumn("_copy", copies).drop("_copy", "_rows")
    return merged.withColumns({"hits": united("hits"), "spans": united("spans")})


def united(name: str) -> Column:
    """Overlapping or touching spans become one."""
    return F.expr(f"""
        aggregate(array_sort({name}), cast(array() as array<struct<start:bigint,end:bigint>>), (a, x) ->
          if(size(a) > 0 and a[size(a) - 1].end >= x.start,
             concat(slice(a, 1, size(a) - 1),
                    array(named_struct('start', a[size(a) - 1].start, 'end', greatest(a[size(a) - 1].end, x.end)))),
             concat(a, array(x))))""")


def cut(text: str, spans: str) -> Column:
    """The text without its hit spans."""
    return replace_spans(text, spans, "")


def hit_words(hits: str = "hits") -> Column:
    return F.expr(f"aggregate({hits}, 0L, (a, x) -> a + x.end - x.start)")
