"""Vector code compression: a product quantiser whose codebooks are trained by member-resident Lloyd rounds.

A vector is cut into equal parts; each part position has its own codebook. Training parts live with the owner of their
entry: rows, each a block of up to ``BLOCK`` parts, are partitioned by (position, entry, salt) and written once. In a round every owner reads its residents in
place and gives the sums of those that stay; only parts whose nearest entry has changed are emitted and shuffled to
their new owner. They are written as a generation of their own: nothing that stays is ever written again.

A part of generation g with entry e is a resident at round t if e is its nearest entry under all codebooks after g up
to t. Codebooks are a bounded ``parts * entries`` rows, so that history travels in the task's closure, and a lost
executor's work is redone from written tables. Salts deal identical and crowded parts evenly: they are a running
number of a task's runs of vectors, and there are enough of them that an owner has about ``members`` parts even if one
entry holds all.

Codes come from one pass over the vectors under the last codebooks, without a shuffle.

Defined cases: vectors that are null or hold null or non-finite components are dropped; so are those that cannot be cut
into equal parts, and those of another length than the kept vector of the smallest id. Rows without an id come after all
others where codebooks start; repeated ids are rows of their own; fewer rows than entries give as many entries; unused
entries stay; an empty table gives no rows; components beyond ``vectors.magnitude`` stand at that bound, summed errors
end at the largest long; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashlens.llm.common import scratch_dir, written
from cashlens.llm.vectors import LONG_MAX, finite_vectors, floored_means, whole

#: Owners hold at most this many parts on average of any split; label sums up to this many rows are broadcast.
MEMBERS, FEW_LABELS = 250_000, 10_000
#: Parts of a row, and vectors of a run that share a salt.
BLOCK, RUN = 64, 512
GENERATION = "position int, entry int, salt int, part binary, n bigint, sums array<bigint>"


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (ties to the lower) and its squared distance."""
    distance = np.empty((len(parts), len(book)), np.int64)
    for k, entry in enumerate(book):
        distance[:, k] = ((parts - entry) ** 2).sum(1)
    entry = distance.argmin(1) if len(parts) else np.zeros(0, np.int64)
    return entry, distance[np.arange(len(parts)), entry]


def first_books(vectors: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray:
    """(position, entry, component): the parts of the kept vectors with the smallest ids; no entries without any."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    kept = vectors.where(finite & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    head = kept.select("vec_id", "embedding").orderBy(*order).limit(1).collect()
    if not head:
        return np.zeros((parts, 0, 1), np.int64)
    dims = len(head[0]["embedding"])
    rows = kept.where(F.size("embedding") == dims).select("vec_id", "embedding").orderBy(*order).limit(entries).collect()
    x = whole(np.array([r["embedding"] for r in rows], np.float64), scale)
    return x.reshape(len(rows), parts, dims // parts).transpose(1, 0, 2).copy()


# ---------------------------------------------------------------- generations


def blocks(position: np.ndarray, entry: np.ndarray, salt: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
    """Parts as rows of up to BLOCK parts of one owner."""
    order = np.lexsort((salt, entry, position))
    position, entry, salt, parts = position[order], entry[order], salt[order], parts[order]
    owner = np.r_[True, (np.diff(position) != 0) | (np.diff(entry) != 0) | (np.diff(salt) != 0)] if len(order) else np.zeros(0, bool)
    first = np.flatnonzero(owner)
    if len(order):
        owner |= (np.arange(len(order)) - first[np.cumsum(owner) - 1]) % BLOCK == 0
        first = np.flatnonzero(owner)
    ends = np.r_[first, len(order)] * (parts.shape[1] * 4)
    bodies = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(parts.astype(np.int32).tobytes())])
    return rows_of(position[first], entry[first], salt[first], bodies, pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.list_(pa.int64())))


def rows_of(position, entry, salt, bodies: pa.Array, n: pa.Array, sums: pa.Array) -> pa.RecordBatch:
    columns = [*(pa.array(np.asarray(x, np.int32)) for x in (position, entry, salt)), bodies, n, sums]
    return pa.RecordBatch.from_arrays(columns, names=["position", "entry", "salt", "part", "n", "sums"])


def parts_of(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    """Position, entry, salt and components of every part of a batch of blocks."""
    bodies = batch.column(3).to_pylist()
    counts = np.array([len(x) for x in bodies], np.int64) // (4 * width)
    parts = np.frombuffer(b"".join(bodies), np.int32).astype(np.int64).reshape(-1, width)
    return *(np.repeat(batch.column(k).to_numpy().astype(np.int64), counts) for k in range(3)), parts


def first_owners(vectors: DataFrame, books: np.ndarray, scale: int, salts: int) -> DataFrame:
    """The parts of all vectors, each with the nearest entry of the first codebooks and its salt."""
    positions, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        for batch in batches:
            x = whole(finite_vectors(batch.column(0), positions * width)[1], scale).reshape(-1, positions, width)
            salt = (number + np.arange(len(x)) // RUN) % salts
            number += -(-len(x) // RUN)
            for p in range(positions):
                yield blocks(np.full(len(x), p), nearest(x[:, p], books[p])[0], salt, x[:, p])

    return vectors.select("embedding").mapInArrow(run, GENERATION)


def still_there(position: np.ndarray, entry: np.ndarray, parts: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    """The rows that every codebook of ``history`` leaves with their entry."""
    rows = np.arange(len(entry))
    for books in history:
        rows = rows[nearest_at(position[rows], parts[rows], books) == entry[rows]]
    return rows


def nearest_at(position: np.ndarray, parts: np.ndarray, books: np.ndarray) -> np.ndarray:
    out = np.empty(len(position), np.int64)
    for p in np.unique(position).tolist():
        rows = np.flatnonzero(position == p)
        out[rows] = nearest(parts[rows], books[p])[0]
    return out


def turn(generation: DataFrame, born: int, history: list[np.ndarray]) -> DataFrame:
    """One round of the owners of a generation: a row with the sums of each owner's stayers, and the parts that leave.

    ``history`` has the codebooks of all rounds so far; the last one decides who leaves now.
    """
    shape = history[-1].shape
    past, now = history[born + 1 : -1], history[-1] if len(history) > born + 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for batch in batches:
            position, entry, salt, parts = parts_of(batch, shape[2])
            rows = still_there(position, entry, parts, past)
            position, entry, salt, parts = position[rows], entry[rows], salt[rows], parts[rows]
            if now is not None:
                new = nearest_at(position, parts, now)
                leave = np.flatnonzero(new != entry)
                if len(leave):
                    yield blocks(position[leave], new[leave], salt[leave], parts[leave])
                stay = new == entry
                position, entry, parts = position[stay], entry[stay], parts[stay]
            np.add.at(sums, (position, entry), parts)
            np.add.at(counts, (position, entry), 1)
        position, entry = np.nonzero(counts)
        if len(position):
            added = pa.array(sums[position, entry].tolist(), pa.list_(pa.int64()))
            yield rows_of(position, entry, np.zeros(len(position)), pa.nulls(len(position), pa.binary()), pa.array(counts[position, entry]), added)

    return generation.where("part is not null").mapInArrow(run, GENERATION)


def totals(rows: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The owners' sums and counts added up: at most one row per position, entry and component."""
    sums, counts = np.zeros(shape, object), np.zeros(shape[:2], object)
    flat = rows.where("n is not null").select("position", "entry", "n", F.posexplode("sums").alias("at", "value"))
    for r in flat.groupBy("position", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("total")).collect():
        sums[r["position"], r["entry"], r["at"]], counts[r["position"], r["entry"]] = int(r["total"]), r["n"]
    return sums, counts


def train(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, members: int = MEMBERS) -> np.ndarray:
    """(position, entry, component): the codebooks after ``rounds`` rounds."""
    books = first_books(vectors, parts, entries, scale)
    if not books.shape[1]:
        return books
    folder = scratch_dir(vectors.sparkSession)
    salts = max(16, -(-vectors.count() // members))
    owner = ["position", "entry", "salt"]
    history, generations = [books], []
    for t in range(rounds):
        # who leaves an owner goes through this one shuffle; in the first round all parts arrive
        if t:
            out = turn(generations[0], 0, history)
            for born, generation in enumerate(generations[1:], 1):
                out = out.unionByName(turn(generation, born, history))
        else:
            out = first_owners(vectors, books, scale, salts)
        generations.append(written(out.repartition(*owner), folder, f"generation{t}"))
        # stayers' sums came with the leavers; the arrivals are summed where they now live
        arrived = turn(generations[-1], t, history)
        sums, counts = totals(generations[-1].unionByName(arrived), books.shape)
        history.append(np.stack([floored_means(sums[p], counts[p].tolist(), history[-1][p]) for p in range(parts)]))
    return history[-1]


# ---------------------------------------------------------------- codes


def encode(vectors: DataFrame, books: np.ndarray, scale: int = 4096) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every kept vector."""
    positions, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not entries:
                break
            rows, x = finite_vectors(batch.column(2), positions * width)
            x = whole(x, scale).reshape(-1, positions, width)
            code, error = np.zeros((len(x), positions), np.uint8), np.zeros(len(x), np.int64)
            for p in range(positions):
                code[:, p], distance = nearest(x[:, p], books[p])
                error += distance
            kept = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(kept), batch.column(1).take(kept), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"]
            )

    kinds = [vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error bigint")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, few_labels: int = FEW_LABELS, members: int = MEMBERS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row of vec_id, label, embedding."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    books = train(vectors, parts, entries, rounds, scale, members)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    folder = scratch_dir(vectors.sparkSession)
    codes = written(encode(vectors, books, scale), folder, "codes")
    sums = codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    sums = written(sums, folder, "sums").withColumnRenamed("label", "_label")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if sums.count() <= few_labels:
        full = codes.join(F.broadcast(sums), same)  # checked: few_labels rows at most
    else:
        # a label may stand on a third of all rows: rows go to 64 salts, the sums to each of them
        salted = codes.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(64)).cast("int"))
        every = sums.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(63))))
        full = salted.join(every, same & (F.col("_salt") == F.col("_salt2")))
    return full.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
