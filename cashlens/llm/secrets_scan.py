"""Secret scans in DataFrame functions only: three fixed forms, and strings that look random to a Markov model.

Two first-order character models are trained by counting character pairs: one on random strings, one on ordinary
identifiers. A candidate run of at least ``least`` letters, digits and key marks is a secret when the log-likelihood
ratio of the two models is high, in all and per pair. The models are two tables of 67 x 67 counts, whatever the
corpus; they become one literal array in the scoring expression.

Positions are characters. They come from the pieces between the matches: a match begins where the pieces and matches
before it end, so no position function is needed and the text is never cut.

Defined cases: a null text counts as empty: no spans, and the digest of the empty text; overlapping spans of different
kinds are all listed, but a Markov span that touches a fixed one is not; repeated rows are scanned each; extra columns
are ignored; an empty table gives no rows (and trains on generated strings alone).
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashlens.llm.common import hashed_sample, replace_spans

# The forms of the contract. Where a run must have a least length, a run of that length matches the same
# places as matching all runs and dropping the short ones; for assignments the value's length is tested afterwards.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

EMPTY = "cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string>>)"


def matches(text: str, pattern: str) -> Column:
    """Array of (piece, found): each match with the text before it; last the rest of the text with a null match."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(F.arrays_zip(pieces, found), lambda x: F.struct(x["0"].alias("piece"), x["1"].alias("found")))


def spans(pairs: str, kind: str, test: str = "true") -> Column:
    """Spans of the matches that pass ``test`` (SQL over ``x.found``)."""
    rank = KINDS.index(kind)
    return F.expr(f"""
        aggregate({pairs}, named_struct('at', 0L, 'out', {EMPTY}), (a, x) -> named_struct(
          'at', a.at + length(x.piece) + coalesce(length(x.found), 0),
          'out', if(x.found is null or not ({test}), a.out, concat(a.out, array(named_struct(
             'start', a.at + length(x.piece), 'rank', {rank}, 'end', a.at + length(x.piece) + length(x.found),
             'kind', '{kind}'))))), a -> a.out)""")


def with_base_spans(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``carry``, text (null: empty) and ``base``: the spans of the three fixed forms, sorted."""
    found = documents.select("doc_id", *carry, F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id",
        *carry,
        "text",
        matches("text", ASSIGN).alias("_assign"),
        matches("text", ACCESS).alias("_access"),
        matches("text", HEX).alias("_hex"),
    )
    # the value of an assignment: what follows the first mark behind the keyword, without spaces and a quote
    long_value = r"""length(regexp_extract(x.found, '^[A-Za-z_]+["\']?\\x20*[:=]\\x20*["\']?(.+)$', 1)) >= 12"""
    return found.select(
        "doc_id",
        *carry,
        "text",
        F.array_sort(F.concat(spans("_assign", "assign", long_value), spans("_access", "access"), spans("_hex", "hex"))).alias("base"),
    )


def as_text(array: str) -> Column:
    return F.expr(f"array_join(transform({array}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


# ---------------------------------------------------------------- the models


def pair_counts(samples: DataFrame) -> DataFrame:
    """Counts of character pairs per label; at most 2 x 67 x 67 rows whatever the number of samples."""
    pairs = F.expr("transform(sequence(1, length(sample) - 1), i -> substring(sample, i, 2))")
    return samples.where(F.length("sample") >= 2).select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").count()


def log_ratios(samples: DataFrame, smooth: float = 2.0) -> list[float]:
    """log P(second | first, random) - log P(second | first, plain) for all pairs of the alphabet, row by row.

    Pair shares are smoothed towards the shares of the second character alone, so that a first character that a
    model has never seen still tells something.
    """
    counts = {(r["label"], r["pair"]): r["count"] for r in pair_counts(samples).collect()}
    size = len(ALPHABET)
    models = []
    for label in ("random", "plain"):
        pairs = [[counts.get((label, a + b), 0) for b in ALPHABET] for a in ALPHABET]
        seconds = [sum(row[k] for row in pairs) for k in range(size)]
        alone = [(n + 0.5) / (sum(seconds) + 0.5 * size) for n in seconds]
        models.append([math.log((n + smooth * q) / (sum(row) + smooth)) for row in pairs for n, q in zip(row, alone, strict=True)])
    return [round(p - q, 6) for p, q in zip(*models, strict=True)]


def training_samples(documents: DataFrame, max_rows: int = 2000) -> DataFrame:
    """Labelled strings from the ``max_rows`` documents with the smallest hash of their id (a bounded sample).

    random: values of secrets in them, and as many digests of numbers in hexadecimal, base 64 and upper case.
    plain: their words outside of secrets, alone and joined into identifiers.
    """
    chosen = hashed_sample(documents, "doc_id", "text", max_rows)
    key = F.sha2(F.col("id").cast("string"), 256)
    values = F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1))
    digests = F.array(key, F.base64(F.unhex(key)), F.substring(F.upper(F.base64(F.unhex(F.reverse(key)))), 1, 24))
    words = F.regexp_extract_all(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), HEX, " "), F.lit(r"[A-Za-z]{3,}"), F.lit(0))
    joined = F.expr("transform(sequence(1, size(w) - 1), i -> case i % 4 when 0 then concat(w[i-1], '_', w[i]) when 1 then concat(w[i-1], initcap(w[i])) when 2 then concat(w[i-1], '-', w[i], i % 10) else concat(w[i-1], '/', w[i]) end)")
    random = chosen.select(F.lit("random").alias("label"), F.explode(values).alias("sample"))
    random = random.unionByName(documents.sparkSession.range(max_rows).select(F.lit("random").alias("label"), F.explode(digests).alias("sample")))
    plain = (
        chosen.select(words.alias("w"))
        .where(F.size("w") >= 2)
        .select(F.lit("plain").alias("label"), F.explode(F.concat("w", joined)).alias("sample"))
    )
    return random.unionByName(plain)


def scan(
    documents: DataFrame, ratios: list[float], least: int = 20, total: float = 12.0, per_pair: float = 0.5, carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, ``carry``, text, base (fixed spans) and spans (all) of every row."""
    base = with_base_spans(documents, carry)
    run = "[A-Za-z0-9+/_=-]{%d,}+" % least
    found = base.select("*", matches("text", run).alias("_run"))
    weights = f"from_json('{json.dumps(ratios)}', 'array<double>')"
    # plain prose has many long words: the ratio is the only test, and runs over the candidates alone
    size = len(ALPHABET)
    ratio = f"""aggregate(sequence(2, length(x.found)), 0D, (s, i) -> s + element_at({weights},
        cast((locate(substring(x.found, i - 1, 1), '{ALPHABET}') - 1) * {size} + locate(substring(x.found, i, 1), '{ALPHABET}') as int)))"""
    test = f"(({ratio}) >= greatest({total}D, {per_pair}D * (length(x.found) - 1)))"
    scored = found.select("doc_id", *carry, "text", "base", spans("_run", "markov", test).alias("_markov"))
    apart = F.expr("filter(_markov, m -> not exists(base, b -> b.start < m.end and m.start < b.end))")
    return scored.select("doc_id", *carry, "text", "base", F.array_sort(F.concat("base", apart)).alias("spans"))


def redact(text: str, spans_: str, mark: str = "[secret]") -> Column:
    """The text with every span replaced by ``mark``; overlapping spans are one."""
    return replace_spans(text, spans_, mark)
