"""Public form of nested values: credential-like keys dropped, local paths masked, depth, items and text bounded.

The rules are expressions built along the schema, so a nested value is redacted in one projection, without a UDF and
without exploding it. JSON texts of any shape take the merged schema of all their rows first.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
HIDDEN_PARTS = ("credential", "secret", "token", "private_key", "stderr", "jsonl")
PATH_STARTS = ("/", "~/")
PATH_PARTS = ("/home/", "/var/lib/")
MAX_DEPTH, MAX_ITEMS, MAX_TEXT = 5, 100, 2000
TOO_DEEP = "[摘要层级已截断]"
TOO_MIXED = "[mixed types]"
LOCAL_PATH = "[Linux本地证据已索引，公网不披露路径]"


def is_hidden(name: str) -> bool:
    return any(part in name.lower() for part in HIDDEN_PARTS)


def hidden(key: Column) -> Column:
    name = F.lower(key)
    return reduce(or_, [F.contains(name, F.lit(part)) for part in HIDDEN_PARTS])


def text(value: Column) -> Column:
    path = reduce(or_, [F.startswith(value, F.lit(x)) for x in PATH_STARTS] + [F.contains(value, F.lit(x)) for x in PATH_PARTS])
    return F.when(path, F.lit(LOCAL_PATH)).otherwise(F.substring(value, 1, MAX_TEXT))


def redacted(value: Column, kind: T.DataType, depth: int = 0) -> Column:
    """The public form of ``value``, which has type ``kind``.

    Structs and maps keep the first 100 fields in order and drop the credential-like of these, arrays keep the first 100
    items, texts 2000 characters. What lies deeper than five levels is a mark; so is a null there. Nulls stay null elsewhere.
    """
    if depth > MAX_DEPTH:
        return F.lit(TOO_DEEP)
    if isinstance(kind, T.StructType):
        kept = [f for f in kind.fields[:MAX_ITEMS] if not is_hidden(f.name)]
        fields = [redacted(value.getField(f.name), f.dataType, depth + 1).alias(f.name) for f in kept]
        # a struct without fields cannot be written: it is an empty map
        inner = F.struct(*fields) if fields else F.create_map().cast("map<string,string>")
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, T.MapType):
        first = F.map_from_entries(F.slice(F.map_entries(value), 1, MAX_ITEMS))
        named = F.transform_keys(first, lambda k, _: k.cast("string"))
        return F.transform_values(F.map_filter(named, lambda k, _: ~hidden(k)), lambda _, v: redacted(v, kind.valueType, depth + 1))
    if isinstance(kind, T.ArrayType):
        return F.transform(F.slice(value, 1, MAX_ITEMS), lambda v: redacted(v, kind.elementType, depth + 1))
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return text(value)
    if isinstance(kind, T.VariantType):
        # rows differ in type here: plain values are texts, anything nested is not shown at all
        nested = F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)<")
        return F.when(nested, F.lit(TOO_MIXED)).otherwise(text(F.try_variant_get(value, "$", "string")))
    return value


def redacted_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the named columns in their public form."""
    return df.withColumns({n: redacted(F.col(f"`{n}`"), df.schema[n].dataType) for n in columns})


def json_schema(df: DataFrame, column: str) -> T.DataType:
    """The merged type of all JSON texts of a column, found by one distributed aggregate; texts that are no JSON are left out."""
    merged = df.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(f"`{column}`"))).alias("s")).first()["s"]
    return T.StructType.fromDDL("v " + re.sub(r"\bOBJECT<", "STRUCT<", merged or "VOID"))["v"].dataType


def redacted_json(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ``out``: the public form of a column of JSON texts, as JSON; null where the text is no JSON.

    The shape is that of all rows together: fields that a row lacks are left out of its text.
    """
    kind = json_schema(df, column)
    parsed = F.try_parse_json(F.col(f"`{column}`"))
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        value = F.when(parsed.isNotNull(), F.from_json(F.col(f"`{column}`"), kind))
        public = redacted(F.col("_value"), kind)
        return df.withColumn("_value", value).withColumn(out, F.to_json(public)).drop("_value")
    shown = text(F.try_variant_get(parsed, "$", "string")) if isinstance(kind, T.StringType) else F.try_variant_get(parsed, "$", "string")
    return df.withColumn(out, shown)
