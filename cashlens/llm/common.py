"""Helpers of the corpus operators: scratch tables, labelled samples, and words of whole Arrow batches as arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


# ---------------------------------------------------------------- tables


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, the folder that all executors share.

    Only where the session names none (tests, local runs) a folder under /tmp is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/corpus-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as a scratch table and read it back: lineage ends here and a lost executor costs nothing."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def labelled_sample(documents: DataFrame, labels: DataFrame, value: str, max_rows: int) -> DataFrame:
    """Up to ``max_rows`` labelled documents (doc_id, text, value) outside the held-out fold.

    The rows are those with the smallest hash of their id, so the choice does not depend on file order.
    Repeated label rows count once, with the largest value.
    """
    chosen = (
        labels.where(F.col(value).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(value).alias("value"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    # ``chosen`` has at most max_rows rows of two numbers: a proven bound for the broadcast.
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())


def hashed_sample(rows: DataFrame, key: str, text: str, max_rows: int) -> DataFrame:
    """(key, text) of the ``max_rows`` keys with the smallest hash; of a key's several texts the first in order.

    Keys are chosen before any text is read, and one text per key is left on every mapper, so neither a task nor the
    driver holds more texts than the sample has.
    """
    known = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    chosen = known.groupBy(key).agg(F.lit(1).alias("_one")).orderBy(F.xxhash64(key), key).limit(max_rows).select(key)
    # at most max_rows keys: a proven bound for the broadcast
    return known.select(key, text).join(F.broadcast(chosen), key, "left_semi").groupBy(key).agg(F.min(text).alias(text))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's file; the files are installed beside Python and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def carried(documents: DataFrame) -> DataFrame:
    """doc_id, text, and all columns but the text in one struct, so that no name can clash with an operator's."""
    others = [F.col(f"`{c}`") for c in documents.columns if c != "text"]
    return documents.select("doc_id", "text", F.struct(*others).alias("_row"))


def restored(df: DataFrame, documents: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of ``documents`` again; with a new ``text`` its length goes to ``n_chars`` where there is one."""
    df = df.select("_row", (F.col("text") if text is None else text).alias("text"))
    out = []
    for field in documents.schema.fields:
        if field.name == "text":
            out.append(F.col("text"))
        elif field.name == "n_chars" and text is not None:
            out.append(F.length("text").cast(field.dataType).alias("n_chars"))
        else:
            out.append(F.col("_row")[field.name].alias(field.name))
    return df.select(out)


def replace_spans(text: str, spans: str, mark: str) -> Column:
    """The text with every span replaced by ``mark``; ``spans`` names an array of (start, end) sorted by start.

    Overlapping spans are one. Positions are characters, ends exclusive.
    """
    merged = f"""aggregate({spans}, cast(array() as array<struct<start:bigint,end:bigint>>), (a, x) ->
        if(size(a) > 0 and a[size(a) - 1].end >= x.start,
           concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, 'end', greatest(a[size(a) - 1].end, x.end)))),
           concat(a, array(named_struct('start', x.start, 'end', x.end)))))"""
    gaps = f"zip_with(concat(array(0L), transform({merged}, s -> s.end)), concat(transform({merged}, s -> s.start), array(cast(length({text}) as bigint))), (a, b) -> named_struct('a', a, 'b', b))"
    pieces = f"transform({gaps}, p -> substring({text}, cast(p.a as int) + 1, cast(p.b - p.a as int)))"
    return F.expr(f"if(size({spans}) = 0 or {text} is null, {text}, array_join({pieces}, '{mark}'))")


# ---------------------------------------------------------------- words of many texts at once


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (multiply and shift, twice)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: After lower-casing: digits, a-z, and all bytes of characters beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[ord("0") : ord("9") + 1] = LETTERS[ord("a") : ord("z") + 1] = LETTERS[0x80:] = True

_powers = np.ones(1, U64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = 1 << max(6, int(n - 1).bit_length())
        _powers = np.cumprod(np.r_[U64(1), np.full(size - 1, 0x9E3779B97F4A7C15, U64)], dtype=U64)
    return _powers


def text_slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole rows of about ``limit`` bytes.

    Yields first row, end row, the bytes, and where each row begins in them (one more offset than rows).
    A null row has no bytes; a longer single row is a run of its own.
    """
    for chunk_at, chunk in _chunks(column):
        n = len(chunk)
        if not n:
            continue
        kind = np.int64 if pa.types.is_large_string(chunk.type) else np.int32
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, kind)[chunk.offset : chunk.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        first = 0
        while first < n:
            end = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
            end = min(n, max(first + 1, end))
            yield chunk_at + first, chunk_at + end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
            first = end


def _chunks(column):
    if isinstance(column, pa.ChunkedArray):
        at = 0
        for chunk in column.chunks:
            yield at, chunk
            at += len(chunk)
    else:
        yield 0, column


def word_spans(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of kept bytes inside each row: row, first byte, end byte (exclusive)."""
    inside = kept[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a run never crosses a row
    before = np.r_[False, inside[:-1]] if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.r_[inside[1:], False] if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return rows, starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (a polynomial over scrambled bytes, length mixed in)."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    within = np.arange(at[-1] + lengths[-1]) - np.repeat(at, lengths)
    codes = BYTE_CODES[data[within + np.repeat(starts, lengths)]]
    codes *= powers(int(lengths.max()))[within]
    return mix(np.add.reduceat(codes, at) + lengths.astype(U64) * U64(0xD6E8FEB86659FD93))


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Characters before each byte, counted from the start of all rows (one more entry than bytes)."""
    return np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
