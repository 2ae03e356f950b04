"""Substring dedup: words under a window of ``window`` words that also starts in a document with a smaller id go.

Matching statistics from a compressed FM-index per shard: the Burrows-Wheeler column of a shard's word sequences lies in
a wavelet tree of packed bits, and streamed sequences walk backwards through its ranks. The walk from a word goes left as
long as the matched words stand in a document of smaller id (a range minimum over the suffix rows tells), so it ends with
the longest earlier match that ends there, the statistic of that word. Matches of at least ``window`` words are the intervals to remove.

Shards are not runs of documents, which would ask every document of every shard. Each window is sent by its anchor, the
least hash among its ``GRAM``-word sequences: equal windows have equal anchors and meet in one shard. Neighbouring windows
with one anchor travel as one segment, and only segments whose anchor stands in several documents travel at all. Texts
are dealt by id once, compressed; both joins of texts use that exchange.

An anchor in more than ``crowd`` documents, as of a line that a third of all texts hold, would be one crowded shard. Its
windows are compared one by one, by 128-bit hashes: the smallest id per window is found with partial sums on the mappers
and joined back, which Spark may split. Both ways are exact; hashes of words have 64 bits in anchors and 40 in segments
(two windows with one anchor differ in a word of equal hash with 10**-12).

Defined cases: null texts have no words; words are kept as they are, white space between kept words becomes one space;
texts of fewer words than a window keep all; rows without id lose nothing and take nothing from others; rows with one
id are one document, so nothing is removed for what only they share; an empty table gives no rows; extra columns are
carried where ``carry`` names them, else ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashlens.llm.common import NOT_SPACE, U64, mix, span_hashes, text_slices, word_spans

WINDOW, GRAM = 13, 4
#: Bytes of a word's hash in a segment; words that close a shard; documents of an anchor beyond which windows go singly.
WORD_BYTES, SHARD_WORDS, CROWD = 5, 500_000, 5_000
#: Windows of a segment; longer runs with one anchor (repeated text) travel as several.
RUN = 32
FACTOR = U64(0xD1342543DE82EF95)

# ---------------------------------------------------------------- the index


class PackedBits:
    """A bit vector in 64-bit blocks with a running count per block."""

    def __init__(self, bits: np.ndarray):
        blocks = -(-len(bits) // 64) + 1
        padded = np.zeros(blocks * 64, np.uint8)
        padded[: len(bits)] = bits
        self.blocks = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(blocks, np.int32)
        np.cumsum(np.bitwise_count(self.blocks[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        low = self.blocks[block] & ((U64(1) << (at & 63).astype(U64)) - U64(1))
        return self.before[block] + np.bitwise_count(low)


class CompressedIndex:
    """Backward search over many word sequences, each closed by a mark of its own.

    ``words`` are numbers from 1 up, ``starts`` where each sequence begins in them, ``owners`` the document of each.
    """

    def __init__(self, words: np.ndarray, starts: np.ndarray, owners: np.ndarray):
        marks = len(starts)
        lengths = np.diff(np.r_[starts, len(words)])
        n = len(words) + marks
        sequence = np.repeat(np.arange(marks), lengths)
        place = np.arange(len(words)) + sequence
        text = np.zeros(n, np.int64)
        text[place] = words
        ranked = text + marks
        ranked[text == 0] = np.arange(marks)  # marks sort first, by their sequence
        order = suffixes(ranked, int(lengths.max()) + 1)
        owner = np.empty(n, np.int64)
        owner[place] = owners[sequence]
        owner[text == 0] = owners
        self.n = n
        self.first = np.cumsum(np.r_[0, np.bincount(text, minlength=int(words.max()) + 1)])
        column = text[order - 1]
        self.bits, self.zeros = [], []
        for level in range(max(1, int(words.max()).bit_length()) - 1, -1, -1):
            bit = ((column >> level) & 1).astype(np.uint8)
            self.bits.append(PackedBits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            column = np.r_[column[bit == 0], column[bit == 1]]
        # from the place where a symbol's leaf begins to where its suffixes begin
        symbols = np.arange(len(self.first) - 1)
        self.shift = self.first[:-1] - self.descend(symbols, np.zeros(len(symbols), np.int64))
        ids, owner = np.unique(owner[order], return_inverse=True)
        self.ids = ids
        levels = n.bit_length()
        self.least = np.empty((levels, n), np.int32)  # least owner of every run of 1, 2, 4, ... rows
        self.least[0] = owner
        for k in range(1, levels):
            half = 1 << (k - 1)
            np.minimum(self.least[k - 1, : n - half], self.least[k - 1, half:], out=self.least[k, : n - half])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Each place taken down to its symbol's leaf of the tree."""
        top = len(self.bits) - 1
        for level, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            ones = bits.ones(at)
            at = np.where((symbol >> (top - level)) & 1, zeros + ones, at - ones)
        return at

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that put ``symbol`` in front of those in [low, high)."""
        both = self.descend(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        start = self.shift[symbol]
        return start + both[: len(low)], start + both[len(low) :]

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest document of the rows [low, high), which are not empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        return self.ids[np.minimum(self.least[level, low], self.least[level, high - (1 << level.astype(np.int64))])]


def suffixes(text: np.ndarray, longest: int) -> np.ndarray:
    """Starts of all suffixes in order, by doubling the compared length up to the longest sequence and its mark."""
    n, length = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while length < longest:
        tail = np.zeros(n, np.int64)
        tail[: n - length] = rank[length:] + 1
        key = rank * (n + 1) + tail
        order = np.argsort(key)
        sorted_ = key[order]
        new = np.cumsum(np.r_[0, sorted_[1:] != sorted_[:-1]])
        rank[order] = new
        if new[-1] == n - 1:
            break
        length *= 2
    return order


def longest_earlier(index: CompressedIndex, words: np.ndarray, first: np.ndarray, end: np.ndarray, owners: np.ndarray, most: int) -> np.ndarray:
    """Where the longest match that ends at each ``end`` and stands in a document below the owner begins.

    A walk goes left as far as ``first``, and ``most`` words at most; all walk together.
    """
    at = end.copy()
    going, low, high = np.arange(len(end)), np.zeros(len(end), np.int64), np.full(len(end), index.n, np.int64)
    for _ in range(most):
        more = at[going] > first[going]
        going, low, high = going[more], low[more], high[more]
        if not len(going):
            break
        low, high = index.step(words[at[going] - 1], low, high)
        held = np.flatnonzero(low < high)
        held = held[index.least_owner(low[held], high[held]) < owners[going[held]]]
        going, low, high = going[held], low[held], high[held]
        at[going] -= 1
    return at


def earlier_matches(index: CompressedIndex, words: np.ndarray, starts: np.ndarray, owners: np.ndarray, window: int) -> list[tuple[np.ndarray, ...]]:
    """(sequence, start, end): intervals of at least ``window`` words that a document below the sequence's own holds.

    First every sequence is walked from its end. Where the walk reaches the start, whatever ends further left is matched
    as well. Where it breaks off, all other ends are asked, each for the words of a window.
    """
    ends = np.r_[starts[1:], len(words)]
    every = np.arange(len(starts))
    at = longest_earlier(index, words, starts, ends, owners, int((ends - starts).max()))
    long = ends - at >= window
    found = [(every[long], (at - starts)[long], (ends - starts)[long])]
    broken = np.flatnonzero((at > starts) & (ends - 1 - starts >= window))
    counts = (ends - starts - window)[broken]
    sequence = np.repeat(broken, counts)
    end = starts[sequence] + window + np.arange(len(sequence)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = longest_earlier(index, words, end - window, end, owners[sequence], window)
    full = end - at == window
    sequence, end = sequence[full], end[full] - starts[sequence[full]]
    found.append((sequence, end - window, end))
    return found


def shard_matches(sequences: list[bytes], docs: np.ndarray, keys: np.ndarray, places: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(doc, key, start, end) of the intervals to remove, of all segments of a shard.

    Equal segments are one sequence of the index, owned by its smallest document; the others hold a copy from end to end.
    """
    numbers: dict[bytes, int] = {}
    which = np.fromiter((numbers.setdefault(s, len(numbers)) for s in sequences), np.int64, len(sequences))
    distinct = list(numbers)
    owners = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(owners, which, docs)
    sizes = np.array([len(s) for s in distinct]) // WORD_BYTES
    starts = np.cumsum(sizes) - sizes
    raw = np.zeros((int(sizes.sum()), 8), np.uint8)
    raw[:, :WORD_BYTES] = np.frombuffer(b"".join(distinct), np.uint8).reshape(-1, WORD_BYTES)
    words = np.unique(raw.view("<u8").ravel(), return_inverse=True)[1] + 1
    copies = np.flatnonzero(docs > owners[which])
    out = [(docs[copies], keys[copies], places[copies], places[copies] + sizes[which[copies]])]
    if len(distinct) > 1:
        index = CompressedIndex(words, starts, owners)
        # the rows of the smallest document ask for what its segments share with still smaller ones
        firsts = np.flatnonzero(docs == owners[which])
        by_sequence = firsts[np.argsort(which[firsts], kind="stable")]
        head = np.searchsorted(which[by_sequence], np.arange(len(distinct) + 1))
        for sequence, start, end in earlier_matches(index, words, starts, owners, window):
            counts = head[sequence + 1] - head[sequence]
            row = by_sequence[np.repeat(head[sequence], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
            out.append((docs[row], keys[row], places[row] + np.repeat(start, counts), places[row] + np.repeat(end, counts)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# ---------------------------------------------------------------- passes over the texts


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(0, len(words) - size + 1), U64)
    for k in range(size if len(out) else 0):
        out = out * FACTOR + words[k : len(out) + k]
    return mix(out)


def anchored(words: np.ndarray, rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and anchor of every window; ``rows`` has the document of each word, ascending."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = rolled(words, GRAM)
    least = grams[:n].copy()
    for k in range(1, window - GRAM + 1):
        np.minimum(least, grams[k : n + k], out=least)
    at = np.flatnonzero(rows[:n] == rows[window - 1 :])
    # 48 bits are enough: an anchor only says where windows meet
    return at, (least[at] >> U64(16)).view(np.int64)


def sliced(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows of a batch with document, first and end byte of their words."""
    for first, end, raw, at in text_slices(batch.column(text)):
        rows, starts, ends = word_spans(raw, at, NOT_SPACE)
        yield batch.slice(first, end - first), raw, rows, starts, ends


def packed(texts: DataFrame) -> DataFrame:
    """``texts`` with each text compressed, for the one shuffle that carries them."""
    schema = T.StructType([T.StructField("body", T.BinaryType()) if f.name == "text" else f for f in texts.schema.fields])
    place = texts.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, len(batch), 1000)):
                texts = [(t or "").encode() for t in part.column(place).to_pylist()]
                bodies = [len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in texts]
                columns = [pa.array(bodies, pa.binary()) if i == place else x for i, x in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return texts.mapInArrow(run, schema)


def unpacked(batch: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with their texts again, of about 4 MB of texts each."""
    codec = pa.Codec("zstd")
    held, size, first = [], 0, 0
    bodies = batch.column(place).to_pylist()
    for i, body in enumerate(bodies):
        n = int.from_bytes(body[:8], "little")
        held.append(codec.decompress(body[8:], n, asbytes=True) if n else b"")
        size += n
        if size >= 4 << 20 or i == len(bodies) - 1:
            texts = pa.array(held, pa.large_binary()).cast(pa.large_string())
            part = batch.slice(first, len(held))
            yield part.set_column(place, "text", texts)
            held, size, first = [], 0, i + 1


def anchors(documents: DataFrame, window: int) -> DataFrame:
    """(anchor, doc, key): the distinct anchors of every row with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part, raw, rows, starts, ends in sliced(batch, 1):
                    at, anchor = anchored(span_hashes(raw, starts, ends), rows, window)
                    order = np.lexsort((anchor, rows[at]))
                    pairs = rows[at][order], anchor[order]
                    new = np.r_[True, (np.diff(pairs[0]) > 0) | (pairs[1][1:] != pairs[1][:-1])] if len(at) else np.zeros(0, bool)
                    row = pa.array(pairs[0][new])
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[1][new]), part.column(0).take(row), part.column(2).take(row)], names=["anchor", "doc", "key"])

    return documents.select("doc", "text", "key").mapInArrow(run, "anchor bigint, doc bigint, key int")


def list_union(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.unique(flat).astype(np.int64)


SEGMENT = "anchor bigint, low bigint, doc bigint, key int, start int, words binary"


def segments(documents: DataFrame, window: int) -> DataFrame:
    """Segments of shared anchors (low null), and single windows of crowded ones (128-bit hash in anchor and low)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                asked = batch.filter(pc.and_(batch.column(3), pc.is_valid(batch.column(4))))
                for part, raw, rows, starts, ends in (x for texts in unpacked(asked, 1) for x in sliced(texts, 1)):
                    words = span_hashes(raw, starts, ends)
                    at, anchor = anchored(words, rows, window)
                    if not len(at):
                        continue
                    number = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(part)))[rows]
                    shared = np.flatnonzero(np.isin(anchor, list_union(part.column(4))))
                    yield from pack(part, words, rows, number, at[shared], anchor[shared])
                    crowded = at[np.isin(anchor, list_union(part.column(5)))]
                    if len(crowded):
                        high, low = rolled(words, window), rolled(words ^ U64(0x2545F4914F6CDD1D), window)
                        row = pa.array(rows[crowded])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(high[crowded].view(np.int64)), pa.array(low[crowded].view(np.int64)), part.column(0).take(row), part.column(2).take(row), pa.array(number[crowded].astype(np.int32)), pa.nulls(len(crowded), pa.binary())],
                            names=["anchor", "low", "doc", "key", "start", "words"],
                        )

    def pack(part, words, rows, number, at, anchor) -> Iterator[pa.RecordBatch]:
        if not len(at):
            return
        new = np.r_[True, (np.diff(at) > 1) | (anchor[1:] != anchor[:-1]) | (rows[at][1:] != rows[at][:-1])]
        runs = np.flatnonzero(new)
        new |= (np.arange(len(at)) - runs[np.cumsum(new) - 1]) % RUN == 0
        first = at[new]
        last = at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]] + window
        sizes = last - first
        ends = np.cumsum(sizes)
        picked = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(first, sizes)
        body = np.ascontiguousarray(words[picked].view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]).tobytes()
        offsets = np.r_[0, ends * WORD_BYTES].astype(np.int32)
        bodies = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body)])
        row = pa.array(rows[first])
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor[new]), pa.nulls(len(first), pa.int64()), part.column(0).take(row), part.column(2).take(row), pa.array(number[first].astype(np.int32)), bodies],
            names=["anchor", "low", "doc", "key", "start", "words"],
        )

    # all columns of the exchange, so that none is pruned from it and both joins can share it
    return documents.select("doc", "body", "key", "known", "shared", "crowded", "_row").mapInArrow(run, SEGMENT)


def matches(rows: DataFrame, window: int, shard_words: int) -> DataFrame:
    """(doc, key, start, end): what the shards' indexes report. A shard closes between two anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            anchor = batch.column(0).to_numpy()
            # an anchor's rows may go on in the next batch: cut before the last anchor only
            cut = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0
            if held and len(anchor) and anchor[0] != held[-1].column(0)[-1].as_py() and size >= shard_words:
                yield close(held)
                held, size = [], 0
            while cut and size + batch.column(4).slice(0, cut).nbytes // WORD_BYTES >= shard_words:
                step = shard_cut(batch, anchor, cut, shard_words - size)
                yield close([*held, batch.slice(0, step)])
                held, size = [], 0
                batch, anchor, cut = batch.slice(step), anchor[step:], cut - step
            if len(batch):
                held.append(batch)
                size += batch.column(4).nbytes // WORD_BYTES
        if held:
            yield close(held)

    def shard_cut(batch, anchor, cut, room) -> int:
        """The end of the anchor at which the shard is full, at most ``cut``."""
        sizes = pc.binary_length(batch.column(4)).to_numpy().astype(np.int64) // WORD_BYTES
        full = int(np.searchsorted(np.cumsum(sizes), max(1, room)))
        return min(cut, int(np.searchsorted(anchor, anchor[min(full, len(anchor) - 1)], side="right")))

    def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        doc, key, start = (table.column(k).to_numpy() for k in range(1, 4))
        found = shard_matches(table.column(4).to_pylist(), doc, key, start, window)
        kinds = (np.int64, np.int32, np.int32, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(found, kinds, strict=True)], names=["doc", "key", "start", "end"])

    dealt = rows.select("anchor", "doc", "key", "start", "words").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "doc bigint, key int, start int, end int")


def kept_words(documents: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows with n_words, n_removed, the kept words joined by single spaces, and the removed spans (in words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, rows, starts, ends in (x for texts in unpacked(batch, 1) for x in sliced(texts, 1)):
                n_words = np.bincount(rows, minlength=len(part))
                head = np.cumsum(n_words) - n_words
                lists = part.column(len(part.schema.names) - 1)
                counts = pc.list_value_length(lists).to_numpy().astype(np.int64)
                flat = lists.flatten()
                base = np.repeat(head, counts)
                cover = np.zeros(len(rows) + 1, np.int64)
                np.add.at(cover, base + flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), 1)
                np.add.at(cover, base + flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64), -1)
                kept = np.cumsum(cover)[:-1] == 0
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[2:-1], pa.array(n_words), pa.array(n_words - np.bincount(rows[kept], minlength=len(part))), joined(raw, rows[kept], starts[kept], ends[kept], len(part)), removed(rows, ~kept, head, len(part))],
                    names=schema.names,
                )

    return documents.mapInArrow(run, schema)


def joined(raw: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> pa.Array:
    """Per row its words with one space between them."""
    sizes = ends - starts + 1
    after = np.cumsum(sizes)
    body = np.full(int(after[-1]) if len(after) else 0, 0x20, np.uint8)
    take = np.arange(len(body)) - np.repeat(after - sizes, sizes)
    inside = take < np.repeat(sizes - 1, sizes)
    body[inside] = raw[(take + np.repeat(starts, sizes))[inside]]
    last = np.zeros(len(body), bool)  # the space behind a row's last word
    if len(rows):
        last[after[np.r_[rows[1:] != rows[:-1], True]] - 1] = True
    total = np.bincount(rows, weights=sizes, minlength=n).astype(np.int64)
    offsets = np.r_[0, np.cumsum(np.maximum(total - 1, 0))]
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(body[~last].tobytes())]).cast(pa.string())


def removed(rows: np.ndarray, gone: np.ndarray, head: np.ndarray, n: int) -> pa.Array:
    """Per row the spans of removed words (start, end), in order and apart."""
    at = np.flatnonzero(gone)
    new = np.r_[True, (np.diff(at) > 1) | (np.diff(rows[at]) > 0)] if len(at) else np.zeros(0, bool)
    first = at[new]
    last = at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]] + 1 if len(at) else at
    values = pa.StructArray.from_arrays([pa.array(first - head[rows[first]]), pa.array(last - head[rows[first]])], ["start", "end"])
    offsets = np.r_[0, np.cumsum(np.bincount(rows[first], minlength=n))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


# ---------------------------------------------------------------- the operator


def dedup(documents: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, crowd: int = CROWD, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``carry``, n_words, n_removed, text (the kept words) and spans (removed words) of every row."""
    if window < GRAM:
        raise ValueError(f"a window has at least {GRAM} words")
    row = F.struct("doc_id", *carry).alias("_row")
    known = F.col("doc_id").isNotNull()
    # no key of a join below is null, so Spark puts no filter under one of them and both read one exchange of the texts
    texts = documents.select(F.when(known, F.col("doc_id").cast("bigint")).otherwise(0).alias("doc"), "text", F.hash("text").alias("key"), known.alias("known"), row)
    dealt = packed(texts).repartition("doc", "key")
    pairs = anchors(texts.where("known"), window)
    common = pairs.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n")).where("low < high")
    shared = pairs.join(common.select("anchor", "n"), "anchor")
    is_crowd = F.col("n") > crowd
    lists = shared.groupBy("doc", "key").agg(
        F.collect_list(F.when(~is_crowd, F.col("anchor"))).alias("shared"), F.collect_list(F.when(is_crowd, F.col("anchor"))).alias("crowded")
    )
    sent = segments(dealt.join(lists, ["doc", "key"], "left"), window)
    found = matches(sent.where("low is null"), window, shard_words)
    single = sent.where("low is not null").select("anchor", "low", "doc", "key", "start")
    first = single.groupBy("anchor", "low").agg(F.min("doc").alias("first"))
    later = single.join(first, ["anchor", "low"]).where("first < doc")
    found = found.unionByName(later.select("doc", "key", "start", (F.col("start") + window).alias("end")))
    spans = found.groupBy("doc", "key").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    full = dealt.join(spans, ["doc", "key"], "left")
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    full = full.select("doc", "body", "_row", F.when(F.col("known") & F.col("found").isNotNull(), F.col("found")).otherwise(none).alias("found"))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("_row", full.schema["_row"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType()), T.StructField("spans", span)])
    return kept_words(full, schema).select("_row.*", "n_words", "n_removed", "text", "spans")
