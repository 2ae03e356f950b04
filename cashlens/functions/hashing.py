"""Content hashes over canonical JSON, stable identities, finite-value scans, redaction."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stable_json(*columns: str) -> Column:
    """JSON of the named columns in name order; equal content gives equal text inside one schema."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def digest(text: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def evidence_id(*parts: Column) -> Column:
    """First 24 hex digits over the joined identity parts."""
    return digest(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 24)


def without_keys(payload: Column, *keys: str) -> Column:
    """Drop volatile keys of a map payload before hashing."""
    return F.map_filter(payload, lambda k, _: ~k.isin(*keys))


def stable_map_json(payload: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(payload))))


NON_FINITE_TEXT = r"^\s*[+-]?(nan|inf|infinity)\s*$"


def has_non_finite(df: DataFrame) -> Column:
    """True when any leaf of a row is NaN or infinite, as a double or as text."""

    def leaf(col: Column, kind: T.DataType) -> Column | None:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.coalesce(F.isnan(col) | (F.abs(col) == float("inf")), F.lit(False))
        if isinstance(kind, T.StringType):
            return F.coalesce(F.lower(col).rlike(NON_FINITE_TEXT), F.lit(False))
        if isinstance(kind, T.StructType):
            hits = [h for f in kind.fields if (h := leaf(col[f.name], f.dataType)) is not None]
            out = None
            for h in hits:
                out = h if out is None else out | h
            return None if out is None else F.coalesce(out, F.lit(False))
        if isinstance(kind, T.ArrayType):
            probe = leaf(F.lit(None).cast(kind.elementType), kind.elementType)
            if probe is None:
                return None
            return F.coalesce(F.exists(col, lambda x: leaf(x, kind.elementType)), F.lit(False))
        if isinstance(kind, T.MapType):
            return leaf(F.map_values(col), T.ArrayType(kind.valueType))
        return None

    out = F.lit(False)
    for f in df.schema.fields:
        hit = leaf(F.col(f"`{f.name}`"), f.dataType)
        if hit is not None:
            out = out | hit
    return out


# Parts of keys that are left out, and what marks a local path.
HIDDEN_KEYS = ("credential", "secret", "token", "private_key", "stderr", "jsonl")
PATH_STARTS = ("/", "~/")
PATH_PARTS = ("/home/", "/var/lib/")


def public_summary(payload: Column, max_items: int | None = None, max_text: int | None = None) -> Column:
    """Redacted map in input order: keys with a hidden part dropped, local paths masked.

    ``max_items`` keeps the first entries, ``max_text`` the first characters; by default nothing is cut.
    """

    def hidden(key: Column) -> Column:
        name = F.lower(key)
        return reduce(or_, [F.contains(name, F.lit(part)) for part in HIDDEN_KEYS])

    def shown(value: Column) -> Column:
        path = reduce(or_, [F.startswith(value, F.lit(x)) for x in PATH_STARTS] + [F.contains(value, F.lit(x)) for x in PATH_PARTS])
        return F.when(path, F.lit("[local path]")).otherwise(value if max_text is None else F.substring(value, 1, max_text))

    taken = payload if max_items is None else F.map_from_entries(F.slice(F.map_entries(payload), 1, max_items))
    return F.transform_values(F.map_filter(taken, lambda k, _: ~hidden(k)), lambda _, v: shown(v))
