"""Fill-in-middle: texts cut at two token boundaries and put together anew, with boundaries in a compressed set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.llm.shared import batch_of, in_batches, texts_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BITMAP_BYTES = 1 << 13

TRANSFORMED = pa.schema(
    [
        ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
        ("middle_chars", pa.int64()), ("output", pa.string()),
    ]
)


class Container:
    """Up to 2^16 ascending 16-bit numbers as an array, a bitmap or runs, whichever takes the fewest bytes."""

    def __init__(self, low: np.ndarray):
        first = np.flatnonzero(np.concatenate([[True], np.diff(low) != 1]))
        array_bytes, run_bytes = 2 * len(low), 4 * len(first) + 2
        if run_bytes < min(array_bytes, BITMAP_BYTES):
            self.kind = "run"
            self.starts = low[first].astype(np.uint16)
            self.before = np.concatenate([first, [len(low)]]).astype(np.uint32)  # numbers in the runs before each
        elif array_bytes <= BITMAP_BYTES:
            self.kind, self.numbers = "array", low.astype(np.uint16)
        else:
            self.kind = "bitmap"
            bits = np.zeros(1 << 16, bool)
            bits[low] = True
            self.words = np.packbits(bits, bitorder="little").view("<u8")
            self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.uint32)

    def select(self, rank: int) -> int:
        """The number that has ``rank`` smaller ones in the container."""
        if self.kind == "array":
            return int(self.numbers[rank])
        at = int(np.searchsorted(self.before, rank, "right")) - 1
        rest = rank - int(self.before[at])
        if self.kind == "run":
            return int(self.starts[at]) + rest
        word = int(self.words[at])
        for _ in range(rest):
            word &= word - 1  # the lowest bit goes
        return 64 * at + (word & -word).bit_length() - 1


class BoundarySet:
    """A set of positions below 2^32 that finds the one of a given rank.

    Positions of equal high 16 bits share a container. Cumulative cardinalities lead to the container
    of a rank, which selects within itself.
    """

    def __init__(self, positions: np.ndarray):
        """``positions`` ascend and do not repeat."""
        high = positions >> 16
        first = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]])) if len(positions) else np.zeros(0, int)
        self.keys = high[first]
        self.before = np.concatenate([first, [len(positions)]])
        self.containers = [Container(positions[a:b] & 0xFFFF) for a, b in zip(self.before[:-1], self.before[1:])]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, rank: int) -> int:
        if not 0 <= rank < len(self):
            raise IndexError(rank)
        at = int(np.searchsorted(self.before, rank, "right")) - 1
        return (int(self.keys[at]) << 16) + self.containers[at].select(rank - int(self.before[at]))


def boundaries(text: str) -> np.ndarray:
    """0 and the end of every token, as code points: a token is a word with the white space before it, or what is left."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    space = (codes == 32) | (codes >= 9) & (codes <= 13)
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.concatenate([[0], ends, [len(codes)]] if len(codes) else [[0]]).astype(np.uint32)


def transform_text(text: str, draws: tuple[int, int, int, int], rate: int, spm_rate: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of a text by its four drawn numbers."""
    cuts = BoundarySet(boundaries(text))
    n = len(cuts) - 1
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or draws[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (cuts.select(rank) for rank in sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def draws(id_col: Column, seed: int) -> Column:
    """Four numbers of 32 bits from the hash of seed and id; a null id draws like an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def transform(
    docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (tokens), form, prefix_chars, middle_chars, output.

    ``rate`` per cent of the texts are transformed, ``spm_rate`` per cent of those with the suffix
    first; draws depend on seed and id alone, so rows that repeat come out alike. Null text counts as
    empty; empty texts and texts that hold a marker stay plain, and their numbers of characters are
    null. Other columns are left out, whatever their names; an empty table gives no rows. A task
    holds a batch of texts, and four bytes a character of the longest one.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = TRANSFORMED.names[1:]
        for batch in batches:
            drawn = batch.column(1).to_pylist()
            rows = [transform_text(t, d, rate, spm_rate) for t, d in zip(texts_of(batch), drawn)]
            yield batch_of(TRANSFORMED, {"doc_id": batch.column(0)} | {k: [r[i] for r in rows] for i, k in enumerate(names)})

    chosen = in_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), draws(F.col(id_col), seed).alias("draws"), F.col(text_col).alias("text")
    )
    return chosen.mapInArrow(
        task, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(form: Column, output: Column) -> Column:
    """The text again, from form and output: no part holds a marker, so each marker is found where it was put."""

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(output, right, 1), left, -1)

    last = F.substring_index(output, MIDDLE, -1)
    spm = F.concat(between(PREFIX, MIDDLE), last, between(SUFFIX, PREFIX))
    psm = F.concat(between(PREFIX, SUFFIX), last, between(SUFFIX, MIDDLE))
    return F.when(form == "spm", spm).when(form == "psm", psm).otherwise(output)


def digests(transformed: DataFrame) -> DataFrame:
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens FROM documents),
e AS (
  SELECT *, len(tokens)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
      THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (
  SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a+1:b], '') AS middle,
    array_to_string(tokens[b+1:], '') AS suffix FROM f)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM g
"""
