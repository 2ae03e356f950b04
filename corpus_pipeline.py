"""A corpus pipeline of five stages over ``documents``.

1. toxicity: documents that the toxicity field rejects go.
2. jaccard_join: of each group of near copies the document with the smallest id stays.
3. decontaminate: text inside occurrences of benchmark windows is cut out; a document of which no word is left goes.
4. secrets: secrets in the text are replaced by a mark.
5. bpe: the texts become token ids.

Each stage takes (spark, docs, sf_dir) and gets all that the stage before kept. All but the last return the columns of
``documents``, in their order; where a stage changes a text, ``n_chars`` follows. Rows with a null id or text pass
through (a null text counts as empty once a stage changes texts). Rows with one id stay or go together in the Jaccard
stage; of those that stay, rows with the same shingles are one: the first by text, then by the other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cashlens.llm import bpe, decontaminate, jaccard_join, secrets_scan, toxicity
from cashlens.llm.common import carried, restored, scratch_dir, table, vocabulary, written

#: A trained model and suffix arrays have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    field = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(carried(docs), field, carry=("_row",))
    return restored(scored.where("score < 0.5"), docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard_join.groups(docs)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    # the digests come before the join, so that join and window share one shuffle of the texts
    rows = jaccard_join.with_digests(carried(docs)).join(kept, "doc_id", "left_semi")
    order = [F.col("_row")[f.name] for f in docs.schema.fields if f.name != "text" and "map<" not in f.dataType.simpleString()]
    same = Window.partitionBy("doc_id", "_high", "_low").orderBy("text", *order)
    first = rows.withColumn("_n", F.row_number().over(same)).where("_n = 1")
    return restored(first, docs).unionByName(docs.where("doc_id is null"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(carried(docs), table(spark, sf_dir, "benchmark"), carry=("_row",), unnamed=True)
    left = found.where((F.size("hits") == 0) | (decontaminate.hit_words() < F.col("n_words")))
    return restored(left, docs, decontaminate.cut("text", "spans"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ratios = secrets_scan.log_ratios(secrets_scan.training_samples(docs))
    found = secrets_scan.scan(carried(docs), ratios, carry=("_row",))
    return restored(found, docs, secrets_scan.redact("text", "spans"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, vocabulary(), with_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("jaccard_join", jaccard_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again."""
    folder = scratch_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return docs
