"""N-gram Jaccard join: an exact similarity join in the metric space of shingle sets with Jaccard distance.

Level 0. Whole documents are useless as first pivots: nearly all pairs of a corpus are at distance 1, so their Voronoi
regions do not part anything. The first pivots are therefore the shingles themselves, as sets of one element: such a
pivot is near exactly to the sets that hold it, and a global order (rare shingles first) breaks ties. A set at distance
at most r from x has its first common shingle among the first |x| - ceil((1 - r)|x|) + 1 pivots of x; into these
regions x is replicated, which is the window that the radius asks for. Hence every pair within r meets in a region.

Most regions are small. One of at most SMALL members ends as its pairs, of which sizes and places in the order part most:
if a shingle is the first that two sets share, what stands before it is common to no part of them. Pairs with the most
central member are measured first, the others only if no link has tied them by then.

In a larger region the most central document is the pivot, and its exact distance to all members is taken: a star, linear
in the region. All stars of one pivot document then are one region: whatever met somewhere has that pivot in common.
Members within r of the pivot are linked. A region whose members hang together is done. The others go on:

Level 1 and up. Members of different components remain open. A small region compares those of its pairs that pass the
triangle inequality over the pivot, |d(x,p) - d(y,p)| <= r. A larger one takes several new document pivots, measures
them against all members, deals each member to its nearest pivot's Voronoi region and replicates it into every region
with d(x,p') <= d(x,p) + 2r, and recurs; its pivots are done with. Where these windows hold most members of most
pivots, as with documents that share a passage and little else, shingles are its pivots once more, ordered by their
counts in the region alone: what only the passage held together falls apart. A region of that second kind, or of at most
BIG members, that document pivots do not part stays whole and takes STEP times as many at the next level, measured only
against members of other components that neither the triangle inequality nor their places in the order part. The join is exact and ends, for
every level takes its pivots out and a level has more of them.

Pivots are chosen for being central, with the most common shingles: in a family of near copies that is the document the
others came from, which links most of them at once.

Before texts are fetched, a pair is bounded by its class counts (a projection that no distance outgrows): most pairs of
unrelated documents that share one phrase end there, with a lower bound in place of the distance.

The rarity order uses counts of shingles over all documents in hashed buckets; their number is fixed, a byte each, so they
may be broadcast. The order decides the work only, never the result: with few shingles a bucket, those of one document come
first, and unrelated documents that share a phrase seldom meet. Texts are hashed to 64-bit shingles (a collision is a
matter of 10**-9 per pair); exact copies share a 128-bit set digest, meet once per task, and are tied by that digest.

Defined cases: null, empty and word-free texts have 0 shingles and link to nothing; a text of one to four words is one
shingle; repeated rows with one id are one node and carry both texts' links; a row without id is linked to nothing and
has the smallest id with the same shingles, or none, as component; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashlens.llm.common import LOWER, NOT_SPACE, U64, mix, scratch_dir, span_hashes, text_slices, word_spans, written
from cashlens.llm.components import components

SIZE = 5
#: Shingles are counted in this many buckets: too few, and at 500 shingles a bucket all look equally rare, so that any
#: phrase of some dozen documents makes regions. A byte per bucket is broadcast, in steps of log2 / COARSE.
BUCKETS, COARSE = 1 << 24, 12
#: A shingle's bucket is its highest bits; counts are summed in ranges of this many buckets.
BUCKET_SHIFT, RANGE = U64(64 - 24), 1 << 16
#: Regions of at most this many documents compare pairs directly; larger ones take new pivots.
SMALL, PIVOTS = 16, 8
#: Each level takes this many times the pivots of the one before: a level costs many small jobs, whatever its rows.
STEP = 16
#: Who meets in a region of shingles: a pivot and a member of a small region, two other members, the spoke of a large one.
FIRST, REST, SPOKE = 0, 1, 2
#: Regions beyond this that document pivots do not part are dealt out by shingles again; smaller ones take more pivots.
BIG = 256


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text, given the hashes of its words."""
    n = len(words)
    if not n:
        return words
    if n < SIZE:
        total = U64(n)
        for w in words.tolist():
            total = mix(np.array([total * U64(0xD1342543DE82EF95) + U64(w)], U64))[0]
        return np.array([total], U64)
    out = np.zeros(n - SIZE + 1, U64)
    for k in range(SIZE):
        out = out * U64(0xD1342543DE82EF95) + words[k : n - SIZE + 1 + k]
    return np.unique(mix(out))


def sets_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingles) of every text of a column."""
    with np.errstate(over="ignore"):
        for first, end, raw, at in text_slices(column):
            raw = LOWER[raw]
            rows, starts, ends = word_spans(raw, at, NOT_SPACE)
            words = span_hashes(raw, starts, ends)
            cut = np.searchsorted(rows, np.arange(end - first + 1))
            for k in range(end - first):
                yield first + k, shingles(words[cut[k] : cut[k + 1]])


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone."""
    low = np.add.reduce(mix(tokens ^ U64(0x2545F4914F6CDD1D)))
    return int(np.add.reduce(tokens).astype(np.int64)), int(low.astype(np.int64))


def class_counts(tokens: np.ndarray) -> bytes:
    """How many shingles fall into each hashed class, about four per class, at most 255 counted."""
    size = 1 << max(3, (len(tokens) // 4).bit_length())
    counts = np.bincount((tokens & U64(size - 1)).astype(np.int64), minlength=size)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def distance_bound(x: bytes, n_x: int, y: bytes, n_y: int) -> float:
    """No two sets with these class counts are nearer: each class differs in as many shingles as its counts differ."""
    p, q = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    size = min(len(p), len(q))
    if len(p) != len(q):
        if max(p.max(), q.max()) == 255:
            return 1 - min(n_x, n_y) / max(n_x, n_y)
        p, q = p.reshape(-1, size).sum(0), q.reshape(-1, size).sum(0)
    both = (n_x + n_y - int(np.abs(p - q).sum())) / 2
    both = min(both, n_x, n_y)
    return 1 - both / (n_x + n_y - both)


def need(n: int) -> int:
    """The least intersection with any linked set, of a set of n shingles."""
    return -(-3 * n // 4)


# ---------------------------------------------------------------- passes over the texts


def set_digests(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, high, low = (np.zeros(len(batch), np.int64) for _ in range(3))
            classes = [b""] * len(batch)
            for row, tokens in sets_of(batch.column(1)):
                n[row] = len(tokens)
                high[row], low[row] = digest(tokens)
                classes[row] = class_counts(tokens)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(high), pa.array(low), pa.array(classes, pa.binary())],
                names=["doc_id", "n_shingles", "high", "low", "classes"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, high bigint, low bigint, classes binary")


def with_digests(documents: DataFrame) -> DataFrame:
    """All columns of ``documents`` and the 128-bit digest of the row's shingle set (_high, _low; 0 for no shingles)."""
    at = documents.columns.index("text")
    schema = T.StructType([*documents.schema.fields, T.StructField("_high", T.LongType()), T.StructField("_low", T.LongType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for row, tokens in sets_of(batch.column(at)):
                high[row], low[row] = digest(tokens)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(high), pa.array(low)], names=names)

    return documents.mapInArrow(run, schema)


def bucket_counts(documents: DataFrame) -> np.ndarray:
    """How many distinct shingles of documents fall into each bucket, over all documents: in steps of log2 / COARSE.

    A task sends, of each range of buckets, what it has counted as packed bytes; a range is summed by one task, which holds
    a few kB per four million shingles. The result is a byte per bucket, whatever the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, tokens in sets_of(batch.column(0)):
                held.append((tokens >> BUCKET_SHIFT).astype(np.int32))
                size += len(tokens)
                if size > 1 << 22:
                    yield pack(held)
                    held, size = [], 0
        if size:
            yield pack(held)

    def pack(held: list[np.ndarray]) -> pa.RecordBatch:
        buckets = np.sort(np.concatenate(held))
        starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
        counts = np.minimum(np.diff(np.r_[starts, len(buckets)]), 0xFFFF).astype("<u2")
        buckets = buckets[starts]
        cut = np.searchsorted(buckets, np.arange(0, BUCKETS + 1, RANGE))
        ranges = np.flatnonzero(cut[1:] > cut[:-1])
        bodies = []
        for k in ranges.tolist():
            steps = np.diff(buckets[cut[k] : cut[k + 1]], prepend=k * RANGE).astype("<u2")
            bodies.append(zlib.compress(steps.tobytes() + counts[cut[k] : cut[k + 1]].tobytes(), 1))
        return pa.RecordBatch.from_arrays([pa.array(ranges.astype(np.int32)), pa.array(bodies, pa.binary())], names=["range", "body"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(RANGE, np.int64)
        for body in group.column("body"):
            steps, counts = np.frombuffer(zlib.decompress(body.as_py()), "<u2").reshape(2, -1)
            total[np.cumsum(steps, dtype=np.int64)] += counts
        codes = np.minimum(np.rint(COARSE * np.log2(np.maximum(total, 1))), 255).astype(np.uint8)
        return pa.table([group.column("range").slice(0, 1), pa.array([codes.tobytes()], pa.binary())], names=["range", "body"])

    schema = "range int, body binary"
    rows = documents.select("text").mapInArrow(run, schema).groupBy("range").applyInArrow(add, schema).toArrow()
    codes = np.zeros((BUCKETS // RANGE, RANGE), np.uint8)
    for k, body in zip(rows.column("range").to_pylist(), rows.column("body"), strict=True):
        codes[k] = np.frombuffer(body.as_py(), np.uint8)
    return codes.reshape(-1)


def region_rows(documents: DataFrame, counts: np.ndarray) -> DataFrame:
    """(region, doc, n, place, central): each document in the regions of its first shingles. Of copies in a task, one goes on.

    n is the size of its set, place the number of its shingles before this one in the order, central how common its shingles are on average: in a family of near copies the one that the
    others were made from has the most common ones, for each edit brings shingles of its own.
    """
    shared = documents.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            regions, docs, sizes, places, centrals, held = [], [], [], [], [], 0
            for row, tokens in sets_of(batch.column(1)):
                n = len(tokens)
                if not n or not known[row]:
                    continue
                key = digest(tokens)
                if key in seen:
                    continue
                seen.add(key)
                take = n - need(n) + 1
                rarity = counts[(tokens >> BUCKET_SHIFT).astype(np.int64)]
                rank = (rarity.astype(U64) << U64(56)) | (tokens >> U64(8))
                order = np.argpartition(rank, take - 1)[:take]
                order = order[np.argsort(rank[order])]
                regions.append(tokens[order].astype(np.int64))
                docs.append(np.full(take, ids[row], np.int64))
                sizes.append(np.full(take, n, np.int32))
                places.append(np.arange(take, dtype=np.int32))
                centrals.append(np.full(take, int(100 * rarity.mean() / COARSE), np.int32))
                held += take
                if held > 1 << 17:
                    yield pack(regions, docs, sizes, places, centrals)
                    regions, docs, sizes, places, centrals, held = [], [], [], [], [], 0
            if held:
                yield pack(regions, docs, sizes, places, centrals)

    def pack(*columns):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names=["region", "doc", "n", "place", "central"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "region bigint, doc bigint, n int, place int, central int")


def meetings(rows: DataFrame, radius: float) -> DataFrame:
    """(kind, region, n_pivot, doc, n, central): who meets in the shingle regions; region is the pivot document.

    Kind SPOKE is the spoke of a region of more than SMALL members, which goes on. A smaller region ends here, in its pairs
    that sizes and places do not part: kind FIRST with its pivot, kind REST of other members, a pair as its lesser and
    greater document. The rows of a region come one after the other; no more than SMALL of them are held together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the rows of the last region so far: all of a small one, the pivot of a larger one
        held, beyond = np.zeros((0, 5), np.int64), False
        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)], 1)])
            if not len(rows):
                continue
            starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
            sizes = np.diff(np.r_[starts, len(rows)])
            large = sizes > SMALL
            large[0] |= beyond
            first = starts[-1]
            beyond = bool(large[-1])
            held = rows[first : first + 1] if beyond else rows[first:]
            yield pack(rows, starts, sizes, large, first)
        if len(held) > 1:
            yield pack(held, np.array([0]), np.array([len(held)]), np.array([False]), len(held))

    def pack(rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, large: np.ndarray, first: int) -> pa.RecordBatch:
        at, size, far = np.repeat(starts, sizes), np.repeat(sizes, sizes), np.repeat(large, sizes)
        spoke = np.flatnonzero(far & (at < np.arange(len(rows))))
        found = [np.stack([np.full(len(spoke), SPOKE), rows[at[spoke], 1], rows[at[spoke], 2], *rows[spoke][:, [1, 2, 4]].T], 1)]
        # pairs of whole small regions only: a region that the batch cuts comes again
        here = np.flatnonzero(~far & (size > 1) & (np.arange(len(rows)) < first))
        for k in range(1, SMALL):
            here = here[here + k < at[here] + size[here]]
            x, y = rows[here], rows[here + k]
            ok = (x[:, 1] != y[:, 1]) & sizes_and_places_fit(x[:, 2], x[:, 3], y[:, 2], y[:, 3], radius)
            kind = np.where(at[here] == here, FIRST, REST)[ok]
            a, b = np.minimum(x[ok, 1], y[ok, 1]), np.maximum(x[ok, 1], y[ok, 1])
            none = np.zeros(len(a), np.int64)
            found.append(np.stack([kind, a, none, b, none, none], 1))
        found = np.concatenate(found)
        found = np.unique(found[found[:, 1] != found[:, 3]], axis=0)
        kinds = (np.int32, np.int64, np.int32, np.int64, np.int32, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(found[:, k].astype(t)) for k, t in enumerate(kinds)], names=["kind", "region", "n_pivot", "doc", "n", "central"])

    # The most central document is the pivot: the middle of a family links most of it at once, and few documents are
    # pivots of many regions.
    ordered = rows.repartition("region").sortWithinPartitions("region", F.desc("central"), F.xxhash64("doc"), "doc")
    return ordered.mapInArrow(run, "kind int, region bigint, n_pivot int, doc bigint, n int, central int")


def sizes_and_places_fit(n_x: np.ndarray, place_x: np.ndarray, n_y: np.ndarray, place_y: np.ndarray, radius: float) -> np.ndarray:
    """As ``places_fit``, of arrays."""
    common = (1 - radius) / (2 - radius) * (n_x + n_y) - 1e-6
    fit = np.minimum(n_x, n_y) >= (1 - radius - 1e-9) * np.maximum(n_x, n_y)
    return fit & (n_x - place_x >= common) & (n_y - place_y >= common)


def of_first_copies(met: DataFrame, copies: DataFrame) -> DataFrame:
    """``met`` with each document that is a copy in the place of it replaced by the first with the same set."""
    for name in ("region", "doc"):
        met = met.join(copies.withColumnsRenamed({"doc": name, "first": "_first"}), name, "left")
        met = met.withColumn(name, F.coalesce("_first", name)).drop("_first")
    small = F.col("kind") != SPOKE
    a, b = F.least("region", "doc"), F.greatest("region", "doc")
    met = met.select("kind", F.when(small, a).otherwise(F.col("region")).alias("region"), "n_pivot", F.when(small, b).otherwise(F.col("doc")).alias("doc"), "n", "central")
    return met.where("region <> doc").distinct()


# ---------------------------------------------------------------- exact distances


def packed_texts(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, body): compressed texts of the documents in ``ids`` (doc); packed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                bodies = [zlib.compress((t or "").encode(), 1) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bodies, pa.binary())], names=["doc", "body"])

    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc"), "text")
    return texts.mapInArrow(run, "doc bigint, body binary").join(ids, "doc", "left_semi")


def bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, bound): the least distance that the class counts of each pair allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(k).to_pylist() for k in range(2, 6)]
            bounds = [distance_bound(*x) for x in zip(*sides, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bounds, pa.float64())], names=["a", "b", "bound"])

    full = pairs.join(classes.withColumnsRenamed({"doc": "b", "n": "n_b", "classes": "classes_b"}), "b")
    full = full.join(classes.withColumnsRenamed({"doc": "a", "n": "n_a", "classes": "classes_a"}), "a")
    return full.select("a", "b", "classes_a", "n_a", "classes_b", "n_b").mapInArrow(run, "a bigint, b bigint, bound double")


def exact(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """(a, b, distance, linked) of each pair from the whole texts; distance is 1 - J."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[bytes, np.ndarray] = {}

        def tokens(body: bytes) -> np.ndarray:
            found = recent.get(body)
            if found is None:
                text = pa.array([zlib.decompress(body).decode()], pa.large_string())
                found = next(sets_of(text))[1]
                if len(recent) >= 256:
                    recent.clear()
                recent[body] = found
            return found

        for batch in batches:
            for first in range(0, len(batch), 512):
                part = batch.slice(first, 512)
                distance, linked = [], []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    s, t = tokens(x), tokens(y)
                    both = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
                    union = len(s) + len(t) - both
                    distance.append(1 - both / union)
                    linked.append(100 * both >= 75 * union)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(distance, pa.float64()), pa.array(linked, pa.bool_())], names=["a", "b", "distance", "linked"])

    full = pairs.join(bodies.withColumnsRenamed({"doc": "b", "body": "body_b"}), "b")
    full = full.join(bodies.withColumnsRenamed({"doc": "a", "body": "body_a"}), "a")
    return full.select("a", "b", "body_a", "body_b").mapInArrow(run, "a bigint, b bigint, distance double, linked boolean")


def measured(pairs: DataFrame, classes: DataFrame, bodies: DataFrame, radius: float, folder: str, name: str) -> DataFrame:
    """(a, b, low, high, linked): bounds of each pair's distance.

    Where the class counts alone put a pair beyond the radius, low is that bound and high is 1. All others are
    measured from their texts: low and high are the distance.
    """
    bounds = written(bounded(pairs, classes), folder, f"{name}_bounds")
    near = exact(bounds.where(F.col("bound") <= radius + 1e-9), bodies)
    far = bounds.where(F.col("bound") > radius + 1e-9)
    found = near.select("a", "b", F.col("distance").alias("low"), F.col("distance").alias("high"), "linked")
    return written(found.unionByName(far.select("a", "b", F.col("bound").alias("low"), F.lit(1.0).alias("high"), F.lit(False).alias("linked"))), folder, name)


# ---------------------------------------------------------------- the join


def link(documents: DataFrame, members: DataFrame, copies: DataFrame, folder: str, radius: float = 0.25) -> DataFrame:
    """(a, b): linked documents, enough of them that components are those of all links between different texts.

    ``copies`` (doc, first) names documents of one text and the first document with the same set, which stands for them.
    """
    met = written(meetings(region_rows(documents, bucket_counts(documents)), radius).distinct(), folder, "meetings")
    met = written(of_first_copies(met, copies), folder, "met")
    ids = written(met.select(F.explode(F.array("region", "doc")).alias("doc")).distinct(), folder, "ids")
    bodies = written(packed_texts(documents, ids), folder, "bodies")
    classes = members.where("n_shingles > 0 and doc_id is not null")
    # only of documents that meet others: every level joins them anew
    classes = classes.select(F.col("doc_id").cast("bigint").alias("doc"), F.col("n_shingles").alias("n"), "classes").join(ids, "doc", "left_semi")
    classes = written(classes, folder, "classes")
    pairs = met.where(F.col("kind") != SPOKE).groupBy(F.col("region").alias("a"), F.col("doc").alias("b")).agg(F.min("kind").alias("kind"))
    pairs = written(pairs, folder, "pairs")
    stars_ = met.where(F.col("kind") == SPOKE).drop("kind")
    # sets of too different sizes are apart by their sizes alone, before anything is joined
    fit = sizes_fit(F.col("n_pivot"), F.col("n"), radius)
    first = pairs.where(F.col("kind") == FIRST).select("a", "b")
    found = measured(unordered(stars_.where(fit), "region", "doc").unionByName(first).distinct(), classes, bodies, radius, folder, "measured0")
    links = found.where("linked").select("a", "b")
    rest = pairs.where(F.col("kind") == REST).select("a", "b").join(found.select("a", "b"), ["a", "b"], "left_anti")
    beyond = stars_.where(~fit).withColumn("low", 1 - F.least("n_pivot", "n") / F.greatest("n_pivot", "n"))
    beyond = beyond.select(F.least("region", "doc").alias("a"), F.greatest("region", "doc").alias("b"), "low", F.lit(1.0).alias("high"), F.lit(False).alias("linked"))
    found = found.unionByName(beyond.distinct())
    facts = written(stars_.select("doc", "n", "central").distinct(), folder, "facts")
    # A pair that meets in a shingle's region was measured against one and the same pivot: the region of a pivot from
    # here on is all that was. Far fewer rows than shingle regions, and each pair of documents meets once per pivot.
    # Pivots are done with: they were measured against all.
    regions = with_distance(stars_.withColumn("pivot", F.col("region")), found)
    regions = written(regions.select("region", "doc", "low", "high", F.lit(False).alias("whole"), F.lit(0).alias("place")), folder, "regions0")
    level, labels = 0, None
    while True:
        # every call of ``components`` is many small jobs: labels stand as long as no level finds a new link
        if labels is None:
            labels = components(links, folder, f"labels{level}")
        level += 1
        members = written(still_open(regions, labels, facts), folder, f"members{level}")
        small, large = members.where(F.col("size") <= SMALL), members.where(F.col("size") > SMALL)
        pivots = written(new_pivots(large, level), folder, f"pivots{level}")
        spokes = large.join(pivots, "region").where("doc <> pivot")
        # a region that its pivots do not part has no use of more distances than those that may link
        apart = (F.col("component") != F.col("pivot_component")) & may_meet("", "pivot_", radius) & places_fit("", "pivot_", radius)
        spokes = written(spokes.where(~F.col("whole") | apart).select("region", "doc", "pivot", "whole"), folder, f"spokes{level}")
        pairs = unordered(spokes, "pivot", "doc").unionByName(close_pairs(small, radius))
        if level == 1:
            pairs = pairs.unionByName(of_two_components(rest, labels))
        pairs = pairs.distinct()
        found = measured(pairs, classes, bodies, radius, folder, f"measured{level}")
        new = found.where("linked").select("a", "b")
        if not new.isEmpty():
            links, labels = links.unionByName(new), None
        if pivots.isEmpty():
            return links
        left = large.join(pivots.select("region", F.col("pivot").alias("doc")), ["region", "doc"], "left_anti")
        if large.where("not whole").isEmpty():
            regions = written(left.select(*regions.columns), folder, f"regions{level}")
            continue
        cells = written(voronoi(spokes.where("not whole"), found, radius), folder, f"cells{level}")
        # Where most members lie in the windows of most pivots, splitting would only copy the region.
        counts = cells.groupBy("parent").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("docs"))
        parted = written(counts.where("n <= 2 * docs").select("parent"), folder, f"parted{level}")
        split = cells.join(parted, "parent", "left_semi").select("region", "doc", "low", "high", F.lit(False).alias("whole"), F.lit(0).alias("place"))
        stuck = written(left.join(parted, F.col("region") == F.col("parent"), "left_anti"), folder, f"stuck{level}")
        again = ~F.col("whole") & (F.col("size") > BIG)
        kept = stuck.where(~again).withColumn("whole", F.lit(True)).select(*split.columns)
        parts, again = split.unionByName(kept), stuck.where(again).select("region", "doc")
        if not again.isEmpty():
            parts = parts.unionByName(shingle_regions(again, bodies, folder, level))
        regions = written(parts, folder, f"regions{level}")
        if level == 1:
            # few documents are open beyond the first level: the later ones join only their texts
            bodies = written(bodies.join(regions.select("doc").distinct(), "doc", "left_semi"), folder, "open_bodies")


def of_two_components(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose documents no link has tied so far."""
    for name in ("a", "b"):
        pairs = pairs.join(labels.withColumnsRenamed({"node": name, "component": f"_{name}"}), name, "left")
    return pairs.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def shingle_regions(members: DataFrame, bodies: DataFrame, folder: str, level: int) -> DataFrame:
    """Regions dealt out by shingles again: each document to its first ones in the order of their counts in the region.

    ``place`` is the number of shingles before; low and high say nothing yet. A shingle in one document is no region.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                texts = pa.array([zlib.decompress(x).decode() for x in part.column(2).to_pylist()], pa.large_string())
                sets = [x for _, x in sets_of(texts)]
                row = pa.array(np.repeat(np.arange(len(part)), [len(x) for x in sets]))
                shingle = pa.array(np.concatenate(sets).astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), shingle], names=["region", "doc", "shingle"])

    held = members.distinct().join(bodies, "doc").select("region", "doc", "body").mapInArrow(tokens, "region bigint, doc bigint, shingle bigint")
    held = written(held, folder, f"tokens{level}")
    counts = held.groupBy("region", "shingle").agg(F.count("*").alias("count"))
    # one document's shingles, so the list is as long as its text
    listed = held.join(counts, ["region", "shingle"]).groupBy("region", "doc").agg(F.array_sort(F.collect_list(F.struct("count", "shingle"))).alias("order"))
    take = F.size("order") - F.ceil(F.size("order") * 0.75).cast("int") + 1
    placed = listed.select("region", "doc", F.posexplode(F.slice("order", F.lit(1), take)).alias("place", "s")).where("s.count > 1")
    return placed.select(
        F.xxhash64("region", "s.shingle").alias("region"), "doc", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), F.lit(True).alias("whole"), "place"
    )


def new_pivots(large: DataFrame, level: int) -> DataFrame:
    """Pivots of each region: the most central member of each of some hashed slots, so no region is sorted."""
    slot = F.pmod(F.xxhash64("doc", F.lit(level)), F.lit(PIVOTS * STEP ** (level - 1)))
    least = F.min(F.struct(-F.col("central"), F.xxhash64("doc"), "doc", "component", "low", "high", "n", "place")).alias("m")
    chosen = large.groupBy("region", slot.alias("slot")).agg(least)
    return chosen.select("region", F.col("m.doc").alias("pivot"), *[F.col(f"m.{x}").alias(f"pivot_{x}") for x in ("component", "low", "high", "n", "place")])


def places_fit(x: str, y: str, radius: float) -> Column:
    """Two members of a shingle's region may be within the radius, by their sizes and by what stands before the shingle.

    If it is the first shingle they share, no more than the rest of each set is common to both.
    """
    n, place = (lambda p: F.col(f"{p}n")), (lambda p: F.col(f"{p}place"))
    common = (1 - radius) / (2 - radius) * (n(x) + n(y)) - 1e-6
    return sizes_fit(n(x), n(y), radius) & (n(x) - place(x) >= common) & (n(y) - place(y) >= common)


def sizes_fit(x: Column, y: Column, radius: float) -> Column:
    """Sets of these sizes may be within the radius."""
    return F.least(x, y) >= (1 - radius - 1e-9) * F.greatest(x, y)


def may_meet(x: str, y: str, radius: float) -> Column:
    """The triangle inequality over a common pivot allows two members within the radius."""
    low, high = (lambda p: F.col(f"{p}low")), (lambda p: F.col(f"{p}high"))
    return (low(x) - high(y) <= radius + 1e-9) & (low(y) - high(x) <= radius + 1e-9)


def unordered(pairs: DataFrame, left: str, right: str) -> DataFrame:
    return pairs.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))


def with_distance(spokes: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the pivots' regions with their distance. The pivots are done with: they were measured with all."""
    sides = spokes.withColumns({"a": F.least("pivot", "doc"), "b": F.greatest("pivot", "doc")})
    return sides.join(found.select("a", "b", "low", "high"), ["a", "b"]).select("region", "doc", "pivot", "low", "high")


def voronoi(spokes: DataFrame, found: DataFrame, radius: float) -> DataFrame:
    """Each member in the region of its nearest pivot, and in all whose members may lie within the radius of it.

    For x at home with p and y within r of x: d(y, p) <= d(x, p) + r <= d(y, q) + 2r for every pivot q of y.
    """
    pivots = spokes.select("region", F.col("pivot").alias("doc")).distinct()
    members = with_distance(spokes.join(pivots, ["region", "doc"], "left_anti"), found)
    home = members.groupBy("region", "doc").agg(F.min("high").alias("home"))
    members = members.join(home, ["region", "doc"]).where(F.col("low") <= F.col("home") + 2 * radius + 1e-9)
    return members.select(F.col("region").alias("parent"), F.xxhash64("region", "pivot").alias("region"), "doc", "low", "high")


def still_open(regions: DataFrame, labels: DataFrame, facts: DataFrame) -> DataFrame:
    """Members, their component, and the size of their region, in regions that hold more than one component."""
    members = regions.join(facts, "doc").join(labels.withColumnsRenamed({"node": "doc"}), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    size = members.groupBy("region").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
    return members.join(size.where("low < high").select("region", "size"), "region")


def close_pairs(small: DataFrame, radius: float) -> DataFrame:
    """Pairs of small regions, of different components, that the triangle inequality over the pivot does not part.

    A region has at most SMALL members, so a member meets that many partners at most.
    """
    x, y = small.alias("x"), small.alias("y")
    apart = (F.col("x.region") == F.col("y.region")) & (F.col("x.doc") < F.col("y.doc")) & (F.col("x.component") != F.col("y.component"))
    return x.join(y, apart & may_meet("x.", "y.", radius) & places_fit("x.", "y.", radius)).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))


def groups(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row (component null only for a row without id)."""
    folder = scratch_dir(documents.sparkSession)
    members = written(set_digests(documents), folder, "members")
    # copies: every document is tied to the smallest one with the same set
    sets = members.drop("classes")
    least = sets.where("n_shingles > 0 and doc_id is not null").groupBy("high", "low", "n_shingles").agg(F.min("doc_id").cast("bigint").alias("first"))
    least = written(least, folder, "least")
    tied = sets.where("n_shingles > 0").join(least, ["high", "low", "n_shingles"])
    copies = tied.where("doc_id is not null").select(F.col("first").alias("a"), F.col("doc_id").cast("bigint").alias("b"))
    copies = written(copies.where("a <> b"), folder, "copies")
    # a document with other texts meets others by those too, so none can stand for it
    several = members.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc")).agg(F.count("*").alias("n")).where("n > 1")
    replaced = copies.select(F.col("b").alias("doc"), F.col("a").alias("first")).join(several, "doc", "left_anti")
    links = link(documents, members, written(replaced, folder, "replaced"), folder)
    labels = components(links.unionByName(copies), folder, "labels")
    named = sets.join(least, ["high", "low", "n_shingles"], "left")
    named = named.withColumn("_node", F.coalesce(F.col("doc_id").cast("bigint"), "first"))
    named = named.join(labels.withColumnRenamed("node", "_node"), "_node", "left")
    kind = documents.schema["doc_id"].dataType
    return named.select("doc_id", "n_shingles", F.coalesce("component", "_node").cast(kind).alias("component_id"))
