"""Connected components of a large graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.llm.shared import store


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the smallest node it can reach.

    A round joins larger neighbours to the smallest one and then smaller ones to the smallest, until
    the edges no longer change (a number of rounds that grows with the logarithm of the component).
    Only minima are gathered per node, so a node of any degree is a partial aggregate and a join.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    links, mark = store(links.distinct(), "links"), None
    while (now := links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()) != mark:
        mark = now
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = store(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
