"""Publication that happens once: a folder per version, and one pointer row per batch id that makes it visible.

A writer first writes the version's folder, reads it back through the gate, and only then writes the pointer: one file,
which Spark's committer renames into place. Readers follow pointers alone. So a stopped write leaves the old version
readable, a repeated batch id finds its pointer and changes nothing, and an unpointed folder of a stopped attempt is
simply written again. Nothing that a pointer names is ever overwritten.

The universe of a table is signed by four sums of 64 bits each over the digests of its key rows: it depends on neither the
order nor the partitions, and needs neither a sort nor a gathered list.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cashlens.operators.scale import join_null_safe

c = F.col
POINTER = "batch_id bigint, version string, status string, signature string, records bigint, seq bigint"
PUBLISHED, REJECTED, EMPTY = "PUBLISHED", "REJECTED", "EMPTY"


def signature(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: signature (64 hex digits) and records. Equal multisets of key rows have equal signatures."""
    shown = F.concat_ws("", *[F.coalesce(F.concat(F.lit("="), c(k).cast("string")), F.lit("~")) for k in keys])
    digest = F.sha2(shown, 256)
    modulus = F.lit(str(2**64)).cast("decimal(38,0)")
    parts = [F.sum(F.conv(F.substring(digest, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")) % modulus for i in range(4)]
    # conv of a decimal string beyond 2**63 keeps all 64 bits
    texts = [F.lpad(F.lower(F.conv(F.coalesce(p, F.lit(0)).cast("string"), 10, 16)), 16, "0") for p in parts]
    return df.agg(F.concat(*texts).alias("signature"), F.count(F.lit(1)).alias("records"))


def pointers(spark: SparkSession, root: str) -> DataFrame:
    """All pointer rows; none where nothing was published yet."""
    try:
        return spark.read.schema(POINTER).option("recursiveFileLookup", True).parquet(f"{root}/pointers")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POINTER)


def _pointed(spark: SparkSession, root: str, **values) -> dict:
    names = ("batch_id", "version", "status", "signature", "records", "seq")
    row = [tuple(values[n] for n in names)]
    spark.createDataFrame(row, POINTER).coalesce(1).write.mode("overwrite").parquet(f"{root}/pointers/batch_id={values['batch_id']}")
    return values


def newest(spark: SparkSession, root: str, up_to: int | None = None) -> dict | None:
    """The newest published pointer."""
    rows = pointers(spark, root).where(c("status") == PUBLISHED)
    found = (rows if up_to is None else rows.where(c("batch_id") <= up_to)).orderBy(F.desc("seq")).first()
    return found.asDict() if found else None


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest published version, or None."""
    found = newest(spark, root)
    return None if found is None else spark.read.parquet(f"{root}/versions/{found['version']}")


def publish(
    df: DataFrame, root: str, batch_id: int, keys: Sequence[str], violations: Callable[[DataFrame], DataFrame] | None = None, same_universe: bool = True
) -> dict:
    """Write ``df`` as the version of a batch and point to it; the pointer's values.

    The version counts only if it is not empty, breaks no rule (``violations`` maps it to its violating rows) and, with
    ``same_universe``, has the signature of the last good version. Otherwise the pointer says REJECTED or EMPTY, and
    readers stay with the last good one. A batch id that already has a pointer is left as it is.
    """
    spark = df.sparkSession
    known = pointers(spark, root)
    before = known.where(c("batch_id") == batch_id).first()
    if before:
        return before.asDict()
    version = f"version={batch_id}"
    path = f"{root}/versions/{version}"
    df.write.mode("overwrite").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    facts = signature(written, keys).first()
    good = newest(spark, root)
    status = PUBLISHED
    if not facts["records"]:
        status = EMPTY
    elif same_universe and good is not None and good["signature"] != facts["signature"]:
        status = REJECTED
    elif violations is not None and violations(written).limit(1).count():
        status = REJECTED
    seq = (known.agg(F.max("seq")).first()[0] or 0) + 1
    return _pointed(spark, root, batch_id=batch_id, version=version, status=status, signature=facts["signature"], records=facts["records"], seq=seq)


# ---------------------------------------------------------------- logs that only grow


def logged(spark: SparkSession, root: str, schema=None) -> DataFrame | None:
    """All rows of all batches of a log, or None where there are none yet."""
    versions = [r["version"] for r in pointers(spark, root).where(c("status") == PUBLISHED).select("version").collect()]
    if not versions:
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*[f"{root}/versions/{v}" for v in versions])


def append_once(df: DataFrame, root: str, batch_id: int, keys: Sequence[str]) -> dict:
    """Add the rows of a batch to a log; a repeated batch id adds nothing."""
    return publish(df, root, batch_id, keys, same_universe=False)


def append_changed_once(snapshot: DataFrame, root: str, batch_id: int, keys: Sequence[str], content: str) -> tuple[dict, dict]:
    """Publish a snapshot as the latest version, and log its rows whose ``content`` is new or changed.

    The log is compared with the snapshot before this batch, whichever of the two writes an earlier attempt has reached.
    """
    spark = snapshot.sparkSession
    before = newest(spark, f"{root}/latest", up_to=batch_id - 1)
    fresh = snapshot
    if before is not None:
        old = spark.read.parquet(f"{root}/latest/versions/{before['version']}").select(*keys, c(content).alias("_old"))
        seen = join_null_safe(snapshot, old.withColumn("_seen", F.lit(True)), keys, "left")
        fresh = seen.where(c("_seen").isNull() | ~c(content).eqNullSafe(c("_old"))).select(*snapshot.columns)
    log = append_once(fresh, f"{root}/history", batch_id, keys)
    return publish(snapshot, f"{root}/latest", batch_id, keys, same_universe=False), log
