"""Best-fit packing of token sequences, planned over a histogram of lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.llm.shared import batch_of, in_batches, store, with_rank
from firegrid.llm.tokens import binary_rows, word_encoder

PIECES = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
#: Ranks below this many per length fit beside the length in one sort key.
RANKS = 1 << 40


def cut_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32, and ids (little-endian, 32 bits each) if asked for.

    A document is its ids and ``end_id``; null text gives the end id alone. Only longer documents are
    cut, into full pieces and a last one that may be shorter. A text is encoded whole, however long.
    """
    fields = PIECES + ([("ids", pa.binary())] if with_ids else [])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer, "<u4")
        for batch in batches:
            ids, sizes = encode(batch.column(1), end_id)
            n = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            length = np.minimum(capacity, sizes[doc] - piece * capacity)
            ends, data = np.cumsum(length).tolist(), memoryview(ids).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip([0, *ends[:-1]], ends)]
            columns = {"doc_id": batch.column(0).take(pa.array(doc)), "piece": piece, "start": piece * capacity, "length": length}
            columns |= {"ids_crc32": crc} | ({"ids": binary_rows(ids, length)} if with_ids else {})
            yield batch_of(pa.schema(fields), columns)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, schema)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, rank, n, sequence, offset): the n pieces of ``length`` from ``rank`` on take ``offset`` in the
    n sequences from ``sequence`` on.

    Best fit, the longest pieces first, on counts: sequences filled alike are one run of numbers, and a
    run takes a whole run of equal pieces at once. The number of runs depends on ``capacity`` and the
    distinct lengths, not on the number of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free places -> runs (sequence, n)
    free = 0  # bit r is set where room[r] has runs
    plan, sequences = [], 0

    def put(places: int, first: int, n: int) -> None:
        nonlocal free
        if places and n:
            room[places].append((first, n))
            free |= 1 << places

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            if fits := free >> length:
                places = length + (fits & -fits).bit_length() - 1
                first, n = room[places].pop()
                if not room[places]:
                    free &= ~(1 << places)
                took = min(n, left)
                put(places, first + took, n - took)
                plan.append((length, rank, took, first, capacity - places))
                put(places - length, first, took)
                rank, left = rank + took, left - took
                continue
            each = min(capacity // length, left)
            bins = left // each
            for k in range(each):
                plan.append((length, rank, bins, sequences, k * length))
                rank += bins
            put(capacity - each * length, sequences, bins)
            sequences, left = sequences + bins, left - each * bins
    return plan


def pack(pieces: DataFrame, capacity: int, order: tuple[str, ...], rows: int) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (which have a length of 1 to ``capacity`` and any other columns).

    The driver sees one count per length. Pieces are ranked within their length, by buckets, so a
    length that many pieces share is no single task, and look their place up in the plan.
    """
    found = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    plan = np.array(sorted(best_fit({r["length"]: r["n"] for r in found}, capacity)) or np.zeros((0, 5)), "i8").reshape(-1, 5)
    keys, ranks, first, offset = plan[:, 0] * RANKS + plan[:, 1], plan[:, 1], plan[:, 3], plan[:, 4]
    ranked = with_rank(pieces, "length", order, rows, "_rank")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "_rank"))
            at = np.searchsorted(keys, length * RANKS + rank, "right") - 1
            columns = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "_rank"]
            columns += [pa.array(first[at] + rank - ranks[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n in batch.schema.names if n != "_rank"] + ["sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*pieces.columns, "_rank").mapInArrow(task, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    capacity: int = 2048,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of ``docs`` with their place in sequences of at most ``capacity`` ids.

    Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids where asked for. Each
    sequence is filled from 0 without gaps. An empty table gives no rows; rows that repeat are packed each.
    """
    pieces = store(cut_documents(docs, tokenizer, end_id, capacity, with_ids, id_col, text_col), "pieces")
    return pack(pieces, capacity, ("doc_id", "piece", "ids_crc32"), pieces.count())
