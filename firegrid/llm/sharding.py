"""Shards of near equal bytes by longest-processing-time scheduling over a histogram of group sizes."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.llm.shared import store, with_rank


def schedule(histogram: Iterable[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(size, shard, low, high): groups of ``size`` ranked low to high - 1 go to ``shard``.

    ``histogram`` has (size, groups) with the largest size first. Each group goes to the least-loaded
    shard, the lowest number among equals, as if one by one: once loads lie within one group of each
    other, a round gives every shard one group and changes no order, so whole rounds are dealt at once.
    """
    heap = [(0, s) for s in range(shards)]
    plan = []
    for size, left in histogram:
        took = dict.fromkeys(range(shards), 0)
        while left:
            if max(heap)[0] - heap[0][0] <= size and left >= shards:
                rounds = left // shards
                heap = [(load + rounds * size, s) for load, s in heap]  # an equal shift keeps the heap's order
                for s in took:
                    took[s] += rounds
                left -= rounds * shards
                continue
            load, s = heapq.heappop(heap)
            n = min(left, max(1, (heap[0][0] - load) // size)) if heap else left
            heapq.heappush(heap, (load + n * size, s))
            took[s] += n
            left -= n
        low = 0
        for s, n in took.items():
            if n:
                plan.append((size, s, low, low + n))
                low += n
    return plan


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's bytes (null: none) plus 1. Equal texts (by SHA-256) form a group and stay
    together, so a group that holds a third of all bytes fills its shard alone. Only the histogram of
    group sizes comes to the driver: N bytes have at most sqrt(2 N) distinct sizes, whatever the
    number of groups. Groups take their shard by joining on rank within size. Slots count from 0 in
    each shard without gaps; ``grown_shard`` is null, as the law is ``bytes``. An empty table gives
    no rows; rows that repeat are members of one group with slots of their own.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    members = store(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        ),
        "members",
    )
    rows = members.count()
    groups = store(members.groupBy("digest").agg(F.sum("size").alias("total")), "groups")
    ranked = with_rank(groups, "total", ("digest",), rows, "rank")
    histogram = groups.groupBy("total").agg(F.count("*").alias("n")).orderBy(F.desc("total"))
    plan = schedule(((r["total"], r["n"]) for r in histogram.toLocalIterator()), shards)
    slots = docs.sparkSession.createDataFrame(plan, "total long, shard int, low long, high long")
    placed = ranked.join(slots, "total").where(F.col("rank").between(F.col("low"), F.col("high") - 1))
    sharded = store(members.join(placed.select("digest", "shard"), "digest").drop("digest"), "sharded")
    return with_rank(sharded, "shard", ("doc_id", "text_crc32"), rows, "slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
