"""Personal data by bootstrapped contextual extraction.

Entities of four fixed forms are the seeds. Around every candidate (a run with digits or an at sign) lexical patterns
are read: its shape alone with its marks, with the word before it and with the word after it; the words alone (one or
two before it, one or two after it, one on each side), which reach values of any shape; and its coarse shape, without
lengths. Spark joins patterns and instances into a graph and scores it by turns: a pattern is as good as the share of
its instances that are known to be of a kind, damped by its support; an instance is as good as its patterns together.
Of the words the best of each side counts, or the best of both sides; a coarse shape alone says nothing and adds at
most what the words say. An instance stands for its kind in the next turn only from a score of ``BAR``. Candidates that
no fixed form takes, but that reach ``threshold`` at the end, are discovered identifiers.

The text is read once, by a task-side helper that emits spans and candidates; a candidate is a few numbers, and texts
are never shuffled. All grouping of the graph is by pattern or by instance with partial sums, so a pattern that stands
in a third of all documents is summed on the mappers.

Defined cases: a null text counts as empty: no spans, and the digest of the empty text; repeated rows each get their
result; rows with equal id and text share their discovered spans; null ids are kept; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashlens.llm.common import scratch_dir, written

# The four forms of the contract and their order.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: The part before the first dot starts where a run of digits starts: a later start can not match where that one fails.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What may be an identifier: digits with marks between them, or a word with digits or an at sign in it.
CANDIDATE = re.compile(r"\+?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+|[A-Za-z0-9][A-Za-z0-9._%+@-]{5,}+")
#: Every candidate holds an at sign or six digits; a text without is passed over.
NUMBERED = re.compile(r"(?:[0-9][^0-9]*+){6}|@")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: for each at sign the run of local characters before it, not before the last match's end."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the four forms, sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


RUNS = re.compile(r"[0-9]+|[A-Z]+|[a-z]+|[^\x00-\x7f]+")


def shape(value: str) -> str:
    """Digits as 9 and letters as a or A, with the length of digit runs."""

    def short(m: re.Match) -> str:
        c = m[0][0]
        return f"9{len(m[0])}" if c.isdigit() else "A" if "A" <= c <= "Z" else "a"

    return RUNS.sub(short, value)[:80]


def coarse(value: str) -> str:
    """Digits, letters, at sign and marks without lengths; groups of digits with marks between them are one form."""
    classes = re.sub(r"[^a9@]+", "-", re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", value)))
    return re.sub(r"(?:9-)+9", "9-9", classes)[:40]


def context_word(text: str) -> str:
    """A neighbour as a pattern: its letters in lower case, or its marks."""
    letters = "".join(c for c in text.lower() if c.isalpha())
    return letters or text[:4]


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, end, kind or -1, instance digest, patterns) of seeds and of other candidates apart from them."""
    found = [(a, b, k) for a, k, b in spans]
    taken = sorted((a, b) for a, _, b in spans)
    at = 0
    for m in CANDIDATE.finditer(text) if NUMBERED.search(text) else ():
        value = m[0].rstrip(".-%+_")
        a, b = m.start(), m.start() + len(value)
        if b - a < 6 or not ("@" in value or sum(c.isdigit() for c in value) >= 6):
            continue
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if any(x < b and a < y for x, y in taken[max(0, at - 1) : at + 2]):
            continue
        found.append((a, b, -1))
    out = []
    for a, b, kind in found:
        value = text[a:b]
        before, after = text[max(0, a - 60) : a].split(), text[b : b + 60].split()
        left = context_word(before[-1]) if before else "^"
        right = context_word(after[0]) if after else "$"
        form = shape(value)
        # an address is known by its parts, not by their letters
        patterns = [f"s {form}", f"l {left} {form}", f"r {form} {right}", f"C {coarse(value)}"]
        patterns += [f"L {' '.join(map(context_word, before[-n:]))}" for n in (1, 2) if len(before) >= n]
        patterns += [f"R {' '.join(map(context_word, after[:n]))}" for n in (1, 2) if len(after) >= n]
        if before and after:
            patterns.append(f"B {left} _ {right}")
        digest = hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        out.append((a, b, kind, int.from_bytes(digest, "big", signed=True), patterns))
    return out


#: From this score on an instance adds to its patterns in the next turn.
BAR = 0.5
SCHEMA = (
    "text_key binary, base array<struct<start:bigint,kind:int,end:bigint>>, "
    "found array<struct<start:bigint,end:bigint,kind:int,instance:bigint,patterns:array<string>>>"
)


def read_texts(documents: DataFrame) -> DataFrame:
    """doc_id, a digest of the text, base spans and candidates of every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    found_type = pa.list_(
        pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                keys, bases, founds = [], [], []
                for text in part.column(1).to_pylist():
                    text = text or ""
                    spans = base_spans(text)
                    keys.append(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                    bases.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                    founds.append([{"start": a, "end": b, "kind": k, "instance": i, "patterns": p} for a, b, k, i, p in candidates(text, spans)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(keys, pa.binary()), pa.array(bases, base_type), pa.array(founds, found_type)],
                    names=["doc_id", "text_key", "base", "found"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def score_graph(found: DataFrame, folder: str, rounds: int = 3, damping: float = 3.0) -> DataFrame:
    """(instance, kind, score) of candidates that are no seeds, after ``rounds`` turns between patterns and instances.

    ``found`` has a row per candidate. An edge counts once however often a pattern holds an instance.
    """
    edges = written(
        found.select("kind", "instance", F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "instance")
        .agg(F.max("kind").alias("seed")),
        folder,
        "edges",
    )
    support = edges.groupBy("pattern").agg(F.count("*").alias("support"))
    seeds = edges.where("seed >= 0").groupBy("instance", F.col("seed").alias("kind")).agg(F.lit(1.0).alias("score"))
    known = seeds
    for turn in range(rounds):
        patterns = (
            edges.join(known.where(F.col("score") >= BAR), "instance")
            .groupBy("pattern", "kind")
            .agg(F.sum("score").alias("mass"))
            .join(support, "pattern")
            .select("pattern", "kind", (F.col("mass") / (F.col("support") + damping)).alias("trust"))
            .where("trust >= 0.05")
        )
        family, trust = F.substring("pattern", 1, 1), F.least("trust", F.lit(0.999))
        best = [F.coalesce(F.max(F.when(family == f, trust)), F.lit(0.0)).alias(f"_{f}") for f in "LRBC"]
        words = F.greatest("_B", 1 - (1 - F.col("_L")) * (1 - F.col("_R")))
        others = (
            edges.where("seed < 0")
            .join(patterns, "pattern")
            .groupBy("instance", "kind")
            .agg(F.sum(F.when(family.isin("s", "l", "r"), F.log(1 - trust)).otherwise(0.0)).alias("_shapes"), *best)
            .select("instance", "kind", (1 - F.exp("_shapes") * (1 - words) * (1 - F.least("_C", words))).alias("score"))
        )
        known = written(seeds.unionByName(others), folder, f"scores{turn}")
    best = known.join(edges.where("seed >= 0").select("instance").distinct(), "instance", "left_anti")
    return best.groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("b")).select("instance", "b.kind", "b.score")


def extract(documents: DataFrame, threshold: float = 0.8, rounds: int = 3) -> DataFrame:
    """doc_id, base (fixed spans) and extra (discovered spans: start, kind, end) of every row."""
    folder = scratch_dir(documents.sparkSession)
    read = written(read_texts(documents), folder, "found")
    candidates_ = read.select("doc_id", "text_key", F.explode("found").alias("f")).select("doc_id", "text_key", "f.*")
    good = score_graph(candidates_, folder, rounds).where(F.col("score") >= threshold)
    extra = (
        candidates_.where("kind < 0")
        .drop("kind")
        .join(good, "instance")
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("extra"))
        .withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    return read.drop("found").join(extra, same, "left").select("doc_id", "base", F.coalesce("extra", F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")).alias("extra"))


def as_text(array: str, prefix: str = "") -> str:
    """SQL: kind:start:end, comma-joined."""
    names = ", ".join(f"'{prefix}{k}'" for k in KINDS)
    return f"transform({array}, x -> concat(array({names})[x.kind], ':', x.start, ':', x.end))"
