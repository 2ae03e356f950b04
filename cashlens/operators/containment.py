"""Which names stand inside which longer texts, without comparing all pairs.

A text that contains a name contains every sequence of ``gram`` characters of it. So each name is filed under one of its own
sequences, the one that the fewest texts hold, and texts are asked by all of theirs: an equi-join on hashed sequences. An
exact test follows. Names shorter than a sequence are filed whole, and texts are asked by all their pieces of those
lengths as well. Counts of sequences combine on the mappers; distinct texts and names are compared once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
GRAM = 6


def pieces(text: Column, size: Column) -> Column:
    """All distinct pieces of ``size`` characters."""
    last = F.greatest(F.length(text) - size + 1, F.lit(0))
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, size)))


def contained_in(names: DataFrame, texts: DataFrame, gram: int = GRAM) -> DataFrame:
    """(name, text): each distinct name with each distinct text that holds it. Empty names are in no text."""
    size = F.lit(gram)
    name = names.select("name").where(F.length("name") > 0).distinct()
    text = texts.select("text").where(F.length("text") > 0).distinct()
    # at most ``gram`` lengths: those of shorter names, and that of a sequence
    lengths = sorted(r["k"] for r in name.select(F.least(F.length("name"), size).alias("k")).distinct().collect())
    of_text = [pieces(c("text"), F.lit(k)) for k in lengths] or [F.array().cast("array<string>")]
    asked = text.select("text", F.explode(F.concat(*of_text)).alias("_piece"))
    # only pieces of names count
    own = name.select("name", F.explode(pieces(c("name"), F.least(F.length("name"), size))).alias("_piece"))
    asked = asked.join(own.select("_piece").distinct(), "_piece", "left_semi")
    held = asked.groupBy("_piece").agg(F.count(F.lit(1)).alias("n"))
    filed = own.join(held, "_piece", "left").groupBy("name").agg(F.min_by("_piece", F.struct(F.coalesce("n", F.lit(0)), "_piece")).alias("_piece"))
    return filed.join(asked, "_piece").where(F.contains("text", c("name"))).select("name", "text")


def without_cover(master: DataFrame, archives: DataFrame, strip: tuple[str, ...] = ("-S", "-W"), gram: int = GRAM) -> DataFrame:
    """Rows of ``master`` (id, name) of which no archive name (archive_name) contains the name; share-class marks are cut."""
    plain = c("name")
    for mark in strip:
        plain = F.replace(plain, F.lit(mark), F.lit(""))
    staged = master.withColumn("_plain", plain)
    covered = contained_in(staged.select(c("_plain").alias("name")), archives.select(c("archive_name").alias("text")), gram)
    return staged.join(covered.select(c("name").alias("_plain")).distinct(), "_plain", "left_anti").drop("_plain")


def target_companies(master: DataFrame, archives: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(targets, outside): the uncovered companies, of these the ``wanted`` ids only; and wanted ids that are none of them."""
    left = without_cover(master, archives)
    if wanted is None:
        return left, master.select("id").limit(0)
    ids = wanted.select("id").distinct()
    return left.join(ids, "id", "left_semi"), ids.join(left.select("id"), "id", "left_anti")
