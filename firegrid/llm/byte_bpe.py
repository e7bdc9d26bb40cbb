"""Byte-level BPE by the tiktoken library with a local rank file: ids of texts, and bytes of ids."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.llm.shared import batch_of, in_batches, safe_pieces, texts_of

#: Characters that go to the library at once.
PIECE = 1 << 18
_CODECS: dict = {}

ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def codec(path: str, pattern: str):
    """The worker's own encoding of a rank file, which has a base64 token and its rank on each line."""
    if (path, pattern) not in _CODECS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _CODECS[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _CODECS[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the whole text's ids, little-endian and 32 bits each, one row per row of ``docs``.

    ``pattern`` splits texts before the merges and each match is merged by itself. Long texts go to
    the library in pieces cut where a blank follows something else: no match runs over such a place
    and none looks behind, so the ids are those of the whole. Null text gives no ids; strings of
    special tokens are ordinary text; rows that repeat are encoded each.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            ids = [
                b"".join(np.array(own.encode_ordinary(p), "<u4").tobytes() for p in safe_pieces(t, PIECE)) for t in texts_of(batch)
            ]
            yield batch_of(ENCODED, {"doc_id": batch.column(0), "ids": ids})

    return in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        task, "doc_id long, ids binary"
    )


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``: the tokens' bytes one after another, whether or not they are text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            raw = [own.decode_bytes(np.frombuffer(ids, "<u4").tolist()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=["doc_id", "ids", "decoded"])

    return in_batches(encoded).select("doc_id", "ids").mapInArrow(task, "doc_id long, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
