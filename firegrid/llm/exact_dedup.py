"""Exact deduplication of texts by skew-safe combining, in the DataFrame API only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from firegrid.llm.shared import keep_once, lower_ascii, store


def content_groups(normal: DataFrame, salts: int) -> DataFrame:
    """Groups of equal ``norm`` texts of (digest, norm, doc_id): (digest, content, keep_id, group_size).

    Three combines, each with the whole text in its key: within a task (the partial aggregate before
    the first exchange; the salt is the task's, so a text leaves a task once), within (digest, salt),
    and over the salt winners of a digest. A text that makes up a third of all rows reaches the first
    exchange as one row per task, and the second as one row per salt. ``content`` is null unless the
    digest stands for more than one text.
    """
    salted = normal.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    first = salted.groupBy("digest", "salt", "norm").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    last = (
        first.repartition("digest")
        .groupBy("digest", "norm")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    shared = F.count("*").over(Window.partitionBy("digest")) > 1
    return last.select("digest", F.when(shared, F.col("norm")).alias("content"), "keep_id", "group_size")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None, salts: int = 16
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. The largest id of a group stays (ids that
    are null only stay where a group has no other). Null text counts as empty, texts may be of any
    length, an empty table gives no rows, further columns are ignored. Rows that repeat an id and a
    text each count in ``group_size`` and share one verdict.

    Texts are read twice: for the groups, and for the digests of all rows that then meet the groups.
    That join is on the digest alone, with texts only for digests of several texts.
    ``digest`` (over the column ``norm``) can be replaced by a weaker one: results stay the same.
    """
    norm = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    normal = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
    sha = F.unhex(F.sha2("norm", 256))
    normal = normal.select("doc_id", "norm", sha.alias("sha"), (sha if digest is None else digest).alias("digest"))
    groups = store(content_groups(normal, salts), "groups")

    columns = ("doc_id", "keep_id", "group_size", "sha")
    single = groups.where(F.col("content").isNull()).drop("content")
    result = normal.select("doc_id", "sha", "digest").join(single, "digest").select(*columns)
    several = groups.where(F.col("content").isNotNull()).withColumnRenamed("content", "norm")
    if not several.isEmpty():
        result = result.unionByName(normal.join(several, ["digest", "norm"]).select(*columns))
    return result.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, verdicts: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that ``verdicts`` keeps: of each group of equal texts one row, with the id that stays.

    Verdicts meet rows by id and digest of the normalised text, so rows that share an id, or have none,
    are told apart by their texts. Rows equal in both stay once, see ``keep_once``.
    """
    digest = F.unhex(F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), 256))
    stay = verdicts.where("kept").select("doc_id", F.unhex("text_sha256").alias("digest"))
    return keep_once(docs, F.col("doc_id"), digest, stay)


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm)
"""
