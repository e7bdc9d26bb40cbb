"""Helpers of the document operators: tables, ranks, files in the shared folder, words, code of the tasks."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from firegrid.session import scratch_path, store  # noqa: F401

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SPACE = b" \t\n\r\x0b\x0c"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else, in the JVM; the first branch is the quicker one."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


#: Rows of an Arrow batch; Spark bounds its bytes, too, but only at 64 MB.
BATCH_ROWS = 3000


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded so that a task holds few texts at once."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def n_tasks(df: DataFrame, rows_per_task: int, rows: int) -> int:
    """Partitions so that a task holds about ``rows_per_task`` of ``rows``, at least the session's own number."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(own, -(-rows // rows_per_task))


def with_rank(df: DataFrame, group: str, order: tuple[str, ...], rows: int, name: str, bucket_rows: int = 50_000) -> DataFrame:
    """Add ``name``: a gapless number from 0 within ``group``, for groups of any size.

    Rows are dealt to buckets by the hash of ``order``; each (group, bucket) is numbered by itself
    and starts where the buckets before it end. The table of starts has a row per group and bucket.
    Rows equal in ``order`` are interchangeable.
    """
    buckets = max(1, -(-rows // bucket_rows))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = dealt.groupBy(group, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    numbered = dealt.withColumn("_at", F.row_number().over(inside) - 1)
    return (
        numbered.join(starts, [group, "_bucket"])
        .withColumn(name, (F.col("_start") + F.col("_at")).cast("long"))
        .drop("_bucket", "_start", "_at")
    )


def keep_once(docs: DataFrame, id_: Column, digest: Column, stay: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (``id_``, ``digest``) is in ``stay`` (doc_id, digest), one for each pair: the least by its columns.

    A null id is an id like any other. Pairs are one struct, as structs with nulls inside are equal,
    and rows of one pair are put together within tasks before they are shuffled.
    """
    rows = docs.select(F.struct(id_.alias("doc_id"), digest.alias("digest")).alias("_pair"), F.struct("*").alias("_row"))
    pairs = stay.select(F.struct("doc_id", "digest").alias("_pair")).distinct()
    return rows.groupBy("_pair").agg(F.min("_row").alias("_row")).join(pairs, "_pair", "left_semi").select("_row.*")


# Inside tasks ------------------------------------------------------------------------------------


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def batch_of(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def safe_pieces(text: str, limit: int) -> Iterator[str]:
    """``text`` in pieces of about ``limit`` characters, cut only where a blank follows something else.

    No match of a word pattern without look-behind runs over such a place, so pieces give the same
    matches as the whole. A stretch without such a place stays whole.
    """
    at = 0
    while len(text) - at > limit:
        cut = _SAFE.search(text, at + limit)
        if not cut:
            break
        yield text[at : cut.start() + 1]
        at = cut.start() + 1
    yield text[at:]


_SAFE = re.compile(r"\S(?=[ \t\n\r])")


class SharedFiles:
    """Files in the shared folder: plain files where it is a mounted one, else through Arrow's file systems."""

    def __init__(self, folder: str):
        scheme, colon, rest = folder.partition(":")
        self.local = not colon or scheme == "file"
        self.folder = (re.sub(r"^/*", "/", rest) if colon else folder) if self.local else folder

    def _remote(self, name: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(f"{self.folder}/{name}")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def writer(self, name: str, attempt: str) -> SharedWriter:
        return SharedWriter(self, name, attempt)

    def map(self, name: str, dtype: str):
        """The whole file as an array: memory-mapped, or read where the store cannot be mapped."""
        import numpy as np

        if self.local:
            path = self.path(name)
            return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
        files, path = self._remote(name)
        with files.open_input_file(path) as f:
            return np.frombuffer(f.read(), dtype)

    def open(self, name: str):
        """A seekable reader."""
        if self.local:
            return open(self.path(name), "rb")
        files, path = self._remote(name)
        return files.open_input_file(path)


class SharedWriter:
    """Writes under a name of its own and takes the final name at the end, so a repeated task does no harm."""

    def __init__(self, files: SharedFiles, name: str, attempt: str):
        self.files, self.name, self.part = files, name, f"{name}.{attempt}.part"
        self.size = 0

    def __enter__(self) -> SharedWriter:
        if self.files.local:
            os.makedirs(self.files.folder, exist_ok=True)
            self.out = open(self.files.path(self.part), "wb")
        else:
            fs, path = self.files._remote(self.part)
            fs.create_dir(os.path.dirname(path), recursive=True)
            self.out = fs.open_output_stream(path)
        return self

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def __exit__(self, kind, error, trace) -> None:
        self.out.close()
        if kind is None and self.files.local:
            os.replace(self.files.path(self.part), self.files.path(self.name))
        elif kind is None:
            fs, path = self.files._remote(self.part)
            fs.move(path, self.files._remote(self.name)[1])
