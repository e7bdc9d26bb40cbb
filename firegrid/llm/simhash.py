"""SimHash near-duplicates: fingerprints, general pigeonhole search, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.llm.graph import components
from firegrid.llm.shared import batch_of, in_batches, keep_once, n_tasks, store, texts_of

BITS = 64
#: Members of a bucket that one task links; larger buckets are linked as pairs of chunks of this size.
RUN = 100_000
#: Relative cost of a signature (made, shuffled, sorted) and of a pair that is compared.
SIGNATURE_COST, PAIR_COST = 1.0, 0.02

FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
SIGNATURES = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("fp", pa.int64())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: str, words_per_shingle: int = 3) -> int:
    words = text.encode().lower().split()  # bytes: A-Z and the white space 20, 09-0D only
    if not words:
        return 0
    line, k = b" ".join(words), min(words_per_shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist())], ">u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_digest: bool = False) -> DataFrame:
    """(doc_id, fp): 64 bits as a signed number, one row per row of ``docs``; on demand with ``text_digest``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch_of(FINGERPRINTS, {"doc_id": batch.column(0), "fp": [fingerprint(t) for t in texts_of(batch)]})
            yield out.append_column("digest", batch.column(2)) if with_digest else out

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    if with_digest:
        columns.append(text_digest(text_col).alias("digest"))
    schema = "doc_id long, fp long" + (", digest binary" if with_digest else "")
    return in_batches(docs).select(*columns).mapInArrow(task, schema)


def text_digest(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


# Partitions and thresholds --------------------------------------------------------------------------


def bit_counts(nodes: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j both set, over all of them: 64 x 64 numbers."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            bits = ((fps[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
            total += bits.T @ bits
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype("i4")), pa.array(j.astype("i4")), pa.array(total[i, j].astype("i8"))], names=["i", "j", "n"]
        )

    rows = nodes.select("fp").mapInArrow(task, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    counts = np.zeros((BITS, BITS))
    for r in rows.collect():  # 4,096 rows at most
        counts[r["i"], r["j"]] = r["n"]
    return counts


@dataclass(frozen=True)
class Search:
    """Bits of each partition and the differing bits that it allows (-1: not searched)."""

    parts: tuple[tuple[int, ...], ...]
    allowed: tuple[int, ...]

    def masks(self) -> list[int]:
        return [sum(1 << b for b in p) for p in self.parts]


def group_bits(counts: np.ndarray, n: int, m: int) -> list[tuple[int, ...]]:
    """``m`` partitions of near equal width: each starts at the free bit most correlated with the other free
    ones and takes the free bit most correlated with its own, so that dependent bits share a partition."""
    f = np.diag(counts) / max(n, 1)
    spread = np.sqrt(np.maximum(f * (1 - f), 1e-9))
    bound = np.abs(counts / max(n, 1) - np.outer(f, f)) / np.outer(spread, spread)
    np.fill_diagonal(bound, 0)
    free, parts = list(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        part = [max(free, key=lambda b: bound[b, free].sum())]
        free.remove(part[0])
        while len(part) < width:
            part.append(max(free, key=lambda b: bound[b, part].sum()))
            free.remove(part[-1])
        parts.append(tuple(sorted(part)))
    return parts


def plan_search(counts: np.ndarray, n: int, radius: int) -> Search:
    """The cheapest partitions and thresholds that miss no pair within ``radius``.

    By the general pigeonhole principle thresholds t_i >= -1 that sum to radius + 1 - m suffice for m
    partitions. Costs are the signatures made and the pairs expected to meet; the second from how
    often two fingerprints differ in each bit. A dynamic program over (partition, threshold spent)
    picks the thresholds, and the cheapest m wins, so the plan follows the number of fingerprints.
    """
    f = np.diag(counts) / max(n, 1)
    differ = 2 * f * (1 - f)
    best: tuple[float, Search] | None = None
    for m in range(1, radius + 3):
        parts = group_bits(counts, n, m)
        costs = []
        for part in parts:
            spread = np.zeros(2 * radius + 1)  # chance that two differ in d bits of the partition
            spread[0] = 1
            for b in part:
                spread = spread * (1 - differ[b]) + np.concatenate([[0], spread[:-1]]) * differ[b]
            price = [0.0]
            for t in range(radius + 1):
                made = sum(math.comb(len(part), d) for d in range(t + 1))
                # Two members of a bucket may each have t bits flipped, and meet in several buckets.
                met = n * (n - 1) / 2 * spread[: 2 * t + 1].sum() * (1 if t == 0 else math.comb(2 * t, t))
                price.append(SIGNATURE_COST * n * made + PAIR_COST * met)
            costs.append(price)
        total, spare = radius + 1 - m, m  # thresholds are counted from -1, so spare = what -1 everywhere lacks
        table = {0: (0.0, ())}
        for price in costs:
            reached: dict[int, tuple[float, tuple]] = {}
            for spent, (cost, chosen) in table.items():
                for t in range(-1, radius + 1):
                    key, now = spent + t + 1, (cost + price[t + 1], (*chosen, t))
                    if key <= total + spare and (key not in reached or now < reached[key]):
                        reached[key] = now
            table = reached
        cost, allowed = table[total + spare]
        if best is None or cost < best[0]:
            best = (cost, Search(tuple(parts), allowed))
    return best[1]


# Probing and verifying ------------------------------------------------------------------------------


def signatures(nodes: DataFrame, search: Search) -> DataFrame:
    """(part, key, fp): the bits of each searched partition, with up to the allowed number of them flipped."""
    flips = []
    for k, (part, t) in enumerate(zip(search.parts, search.allowed)):
        if t >= 0:
            some = [sum(1 << b for b in c) for d in range(t + 1) for c in combinations(part, d)]
            flips.append((k, np.uint64(search.masks()[k]), np.array(some, np.uint64)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for k, mask, flip in flips:
                for at in range(0, len(flip), 64):
                    keys = ((fps & mask)[:, None] ^ flip[at : at + 64]).ravel()
                    again = np.repeat(fps, len(flip[at : at + 64]))
                    parts = np.full(len(keys), k, np.int32)
                    yield batch_of(SIGNATURES, {"part": parts, "key": keys.view(np.int64), "fp": again.view(np.int64)})

    return nodes.select("fp").mapInArrow(task, "part int, key long, fp long")


def link_run(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the members within ``radius`` of each other.

    Breadth first over the members not yet reached: a dense bucket is used up in a few steps, so
    neither all pairs are compared there nor are they put out.
    """
    rest, a, b = fps, [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                new, rest = rest[near], rest[~near]
                a.append(np.full(len(new), x))
                b.append(new)
                queue.extend(new)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def link_sorted(keys: np.ndarray, fps: np.ndarray, radius: int, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Edges within each run of equal ``keys`` (sorted)."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(keys)]]))
    a, b = [], []
    run = np.repeat(np.arange(len(first)), sizes)
    tiny = np.repeat(sizes <= small, sizes)
    for shift in range(1, small):
        at = np.flatnonzero((run[:-shift] == run[shift:]) & tiny[:-shift])
        at = at[np.bitwise_count(fps[at] ^ fps[at + shift]) <= radius]
        a.append(fps[at])
        b.append(fps[at + shift])
    for start, size in zip(first[sizes > small].tolist(), sizes[sizes > small].tolist()):
        x, y = link_run(np.unique(fps[start : start + size]), radius)
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def links(nodes: DataFrame, search: Search, radius: int, rows: int, run: int = RUN) -> DataFrame:
    """(a, b): links of which every component of the fingerprints within ``radius`` is made up.

    Members of a bucket meet in one task as a sorted run. A bucket above ``run`` members is split
    into chunks and each pair of chunks becomes a bucket, so a task never holds more than two chunks.
    """
    made = signatures(nodes, search)
    hot = store(made.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > run), "hot")
    chunks = hot.select("part", "key", F.ceil(F.col("n") / (run // 2)).cast("int").alias("chunks"))
    mine = F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1), lambda j: F.struct(F.least("c", j).alias("x"), F.greatest("c", j).alias("y")))
    dealt = made.join(chunks, ["part", "key"], "left").withColumn("c", mine).withColumn("pair", F.explode(met))
    keyed = dealt.select("part", "key", F.col("pair.x").alias("x"), F.col("pair.y").alias("y"), "fp")
    per_node = sum(sum(math.comb(len(p), d) for d in range(t + 1)) for p, t in zip(search.parts, search.allowed))
    bucket = ("part", "key", "x", "y")
    tasks = n_tasks(nodes, 1_000_000, rows * per_node)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbered(batch):
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            return np.stack([c.astype(np.int64) for c in columns], 1), batch.column(4).to_numpy().view(np.uint64)

        def done(keys, fps):
            change = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(1))])
            a, b = link_sorted(change, fps, radius)
            return batch_of(EDGES, {"a": a.view(np.int64), "b": b.view(np.int64)})

        held: list = []  # the run that the last batch ended with
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, fps = numbered(batch)
            new = np.flatnonzero((keys != keys[-1]).any(1))
            last = int(new[-1]) + 1 if len(new) else 0  # where the last run begins
            if held and ((held[0][0][0] != keys[0]).any() or last):
                whole_keys = np.concatenate([k for k, _ in held] + [keys[:last]])
                yield done(whole_keys, np.concatenate([f for _, f in held] + [fps[:last]]))
                held = []
            elif last:
                yield done(keys[:last], fps[:last])
            held.append((keys[last:], fps[last:]))
        if held:
            yield done(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))

    return keyed.repartition(tasks, *bucket).sortWithinPartitions(*bucket).mapInArrow(task, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints are over shingles of three words of the A-Z lower-cased text, repeats included; a
    bit is set where over half the shingles' hashes have it. Shorter texts are one shingle; a text
    without words, null too, has fingerprint zero and links like any other. Fingerprints that differ
    in at most ``radius`` bits are linked; component_id is the smallest id that can be reached (null
    where a component has no id). Rows with one fingerprint are a single node, so copies cost nothing
    in the search. An empty table gives no rows; rows that repeat each get one.
    """
    fps = store(fingerprints(docs, id_col, text_col), "fingerprints")
    named = linked(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), radius, run)
    ids = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_fp = store(named.join(ids, "label").select("fp", "component_id"), "components")
    return fps.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def linked(nodes: DataFrame, radius: int, run: int) -> DataFrame:
    """``nodes`` (fp and more, stored) with ``label``, the same for all nodes of a component."""
    nodes = store(nodes, "nodes")
    n = nodes.count()
    search = plan_search(bit_counts(nodes), n, radius)
    labels = components(links(nodes, search, radius, n, run)).withColumnRenamed("node", "fp")
    named = nodes.join(labels, "fp", "left").select(*nodes.columns, F.coalesce("label", "fp").alias("label"))
    return store(named, "named")


def drop_near_copies(
    docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", run: int = RUN
) -> DataFrame:
    """One row of ``docs`` for each component of ``near_duplicates``: the one with the smallest id.

    Rows without an id stand for a component only where it has no other. Among rows that share the id
    the text with the least digest stands, so different texts of one id, or of none, each stay unless
    they are linked. Rows equal in id and text stay once, see ``keep_once``.
    """
    fps = fingerprints(docs, id_col, text_col, with_digest=True)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    named = linked(fps.groupBy("fp").agg(F.min(first).alias("first")), radius, run)
    stay = named.groupBy("label").agg(F.min("first").alias("first")).select("first.doc_id", "first.digest")
    return keep_once(docs, F.col(id_col).cast("long"), text_digest(text_col), stay)
