"""Token files: flat unsigned integers with 64-bit document offsets, written and read back in parallel."""

from __future__ import annotations

import os
import string
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from firegrid.llm.shared import SharedFiles, batch_of, in_batches, n_tasks, scratch_path, store

#: A worker remembers about this many words; then it starts anew.
WORD_CACHE = 600_000
#: Bytes of texts whose words are looked up together (a longer text is a lot of its own).
LOT_BYTES = 8 << 20
_ENCODERS: dict = {}


class WordEncoder:
    """Ids of texts by a tokenizer of the tokenizers library that never joins bytes over white space.

    Such a tokenizer gives a text the ids of its blank-separated words in turn, so texts are split and
    their distinct words found by Arrow, each word is encoded once and remembered, and ids are
    gathered word by word. Where the tokenizer also parts closing punctuation from letters and digits,
    or takes A-Z as a-z (both are tried on every pair of such characters at the start), words share the
    ids of their cores. Words of Latin letters, each as what the tokenizer's first steps make of it
    (tried on either side of every a-z), go straight to the tokenizer's model; other new words go to
    the library in one call, parted by a special token where it has one. Special tokens in a text are handled as the library does by
    itself: words that may hold one (or ``<|``) are encoded whole and singly.
    """

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype(dtype)
        added = self.tokenizer.get_added_tokens_decoder()
        self.marks = sorted({t.content for t in added.values()} | {"<|"})
        self.parted = self.parter = None
        letters, one = string.ascii_lowercase, self._one
        self.tail = "".join(
            t for t in string.punctuation
            if t not in "<|>" and all(one(c + t) == one(c) + one(t) for c in letters + letters.upper() + string.digits)
        )
        pairs = [a + b for a in self.tail for b in self.tail]
        if not all(one("a" + x) == one("a") + one(x) and one("7" + x) == one("7") + one(x) for x in pairs):
            self.tail = ""
        folded = list(letters) + [a + b for a in letters for b in letters]
        self.folds = all(one(x) == one(x.upper()) for x in folded)
        self.letters, self.spelled = "", {}
        if self.folds and self._try_letter("a"):
            self.letters = "".join(c for c in map(chr, range(0x41, 0x250)) if self._try_letter(c))
        for number, token in added.items():
            tried = ["ab", "1.", "x'y", "\u00e9", "a-b"]
            ids = one(token.content.join([*tried, ""]))
            if ids == [i for w in tried for i in [*one(w), number]]:
                self.parter, self.parted = number, token.content
                break
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {"": 0}
        self.flat = np.zeros(1 << 16, self.dtype)
        self.ends = np.zeros(1 << 12, np.int64)  # of the ids of each slot; slot 0 has none
        self.used = 0

    def _try_letter(self, c: str) -> bool:
        """Whether ``c`` is a letter that is spelled alike for the model wherever it stands."""
        normal = self.tokenizer.normalizer.normalize_str(c) if self.tokenizer.normalizer else c
        first = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) if self.tokenizer.pre_tokenizer else [(normal, (0, 1))]
        if not (c.isalpha() and len(normal) == len(first) == 1):
            return False
        self.spelled[ord(c)] = first[0][0]
        near = string.ascii_lowercase if len(self.spelled) > 1 else "a"
        tried = [c, c + c, *(c + a for a in near), *(a + c for a in near), *(a + c + a for a in near)]
        good = all(self._one(x) == self._plain(x) for x in tried if all(ord(a) in self.spelled for a in x))
        if not good:
            del self.spelled[ord(c)]
        return good

    def _plain(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.translate(self.spelled))]

    def _one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _remember(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first, n = len(self.slots), len(words)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + n > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.ends[first : first + n] = self.used + np.cumsum(lengths)
        self.used += len(ids)
        self.slots.update(zip(words, range(first, first + n)))

    def _learn(self, words: list[str]) -> None:
        plain, single, rest = [], [], []
        for w in words:
            if self.letters and not w.strip(self.letters):
                plain.append(w)
            elif not self.parted or any(m in w for m in self.marks):
                single.append(w)
            else:
                rest.append(w)
        for some, encode in ((plain, self._plain), (single, self._one)):
            ids = [encode(w) for w in some]
            self._remember(some, np.array([i for x in ids for i in x], self.dtype), np.array([len(x) for x in ids], np.int64))
        for at in range(0, len(rest), 5000):
            some = rest[at : at + 5000]
            ids = np.array(self._one(self.parted.join([*some, ""])), np.int64)
            ends = np.flatnonzero(ids == self.parter)
            self._remember(some, ids[ids != self.parter].astype(self.dtype), np.diff(np.concatenate([[-1], ends])) - 1)

    def _slots(self, words: pa.Array) -> np.ndarray:
        """Slots of distinct words; unknown ones are learned."""
        found = words.to_pylist()
        slots = np.fromiter(map(self.slots.get, found, repeat(-1)), np.int64, len(found))
        new = np.flatnonzero(slots < 0)
        some = [found[i] for i in new.tolist()]
        self._learn(some)
        slots[new] = np.fromiter(map(self.slots.get, some), np.int64, len(some))
        return slots

    def _gather(self, flat: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        ends = np.cumsum(lengths)
        return flat[np.repeat(first - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after another, and how many each has."""
        core = pc.utf8_rtrim(words, self.tail) if self.tail else words
        whole = pc.match_substring(words, "<|")
        for mark in self.marks:
            whole = pc.or_(whole, pc.match_substring(words, mark))
        whole = pc.or_(whole, pc.invert(pc.match_substring_regex(core, "[A-Za-z0-9]$")))
        core = pc.if_else(whole, words, core)
        if self.folds:
            keep = pc.or_(whole, pc.invert(pc.string_is_ascii(core)))
            core = pc.if_else(keep, core, pc.ascii_lower(core))
        cores = core.dictionary_encode()
        has_tail = np.flatnonzero(pc.binary_length(core).to_numpy() < pc.binary_length(words).to_numpy())
        sizes = pc.binary_length(core).to_numpy()[has_tail].tolist()
        tail = [w.encode()[n:].decode() for w, n in zip(words.take(pa.array(has_tail)).to_pylist(), sizes)]
        tails = pa.array(tail, pa.string()).dictionary_encode()
        if len(self.slots) + len(cores.dictionary) + len(tails.dictionary) > WORD_CACHE:
            self._forget()
        parts = np.zeros((len(words), 2), np.int64)
        parts[:, 0] = self._slots(cores.dictionary)[cores.indices.to_numpy()]
        parts[has_tail, 1] = self._slots(tails.dictionary)[tails.indices.to_numpy()]
        parts = parts.ravel()
        first = np.where(parts > 0, self.ends[parts - 1], 0)
        lengths = self.ends[parts] - first
        return self._gather(self.flat, first, lengths), lengths.reshape(-1, 2).sum(1)

    def _lot(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        if not len(words):
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        ids, sizes = self._words(words.dictionary)
        first, at = np.cumsum(sizes) - sizes, words.indices.to_numpy()
        lengths = sizes[at]
        before = np.concatenate([[0], np.cumsum(lengths)])
        bounds = before[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return self._gather(ids, first[at], lengths), np.diff(bounds)

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each closed by ``end_id``, and how many ids each has; null counts as empty."""
        texts = texts.fill_null("")
        total = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        found, at = [], 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + LOT_BYTES, "right")))
            ids, lengths = self._lot(texts.slice(at, stop - at))
            found.append((np.insert(ids, np.cumsum(lengths), end_id).astype(self.dtype, copy=False), lengths + 1))
            at = stop
        if not found:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        return np.concatenate([i for i, _ in found]), np.concatenate([n for _, n in found])


def word_encoder(path: str, dtype: str) -> WordEncoder:
    """The worker's own encoder; workers are used for many tasks."""
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = WordEncoder(path, dtype)
    return _ENCODERS[path, dtype]


MANIFEST = pa.schema(
    [("part", pa.int32()), ("attempt", pa.string()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_tokens", pa.int64())]
)
RECORD = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def _name(kind: str, part: int, attempt: str) -> str:
    return f"{kind}-{part:06d}-{attempt}.bin"


def _attempt() -> str:
    return f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def binary_rows(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Stretches of ``lengths`` numbers of ``flat``, one after another, as binary values without a copy of their own."""
    flat = np.ascontiguousarray(flat)
    ends = np.concatenate([[0], np.cumsum(lengths)]) * flat.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends.astype("<i8")), pa.py_buffer(flat)]).cast(pa.binary())


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    dtype: str = "<u4",
    rows: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode ``docs`` in ascending id order to files below ``folder``; gives the index, a row per part.

    A part is a range of (id, hash of the text): ``tokens-`` holds its ids, each document closed by
    ``end_id``, ``docs-`` its document ids, ``offsets-`` where each document starts among the ids of
    all parts, as 64-bit integers. Parts are written side by side; then the prefix sums of their token
    counts, one number per part, give the bases that turn local offsets into global ones. ``dtype``
    must hold every id. Null text is an empty document, ids that are null come first, rows that repeat
    are written each; rows of one id are spread and ordered by their texts, so only rows equal in both
    keep together. Other columns are left out. An empty table gives an index of empty parts. A long
    text is encoded whole; a task holds a batch of texts and their ids. A task that is repeated writes
    files of its own name, and the index names those of the attempt that counts.
    """
    rows = docs.count() if rows is None else rows
    ranged = (
        in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .withColumn("_hash", F.xxhash64("text"))
        .repartitionByRange(n_tasks(docs, 20_000, rows), "doc_id", "_hash")
        .sortWithinPartitions("doc_id", "_hash", F.octet_length("text"))
        .drop("_hash")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt, files = TaskContext.get().partitionId(), _attempt(), SharedFiles(folder)
        encode = word_encoder(tokenizer, dtype)
        n_docs = n_null = n_tokens = 0
        with (
            files.writer(_name("tokens", part, attempt), attempt) as tokens,
            files.writer(_name("docs", part, attempt), attempt) as ids,
            files.writer(_name("lengths", part, attempt), attempt) as lengths,
        ):
            for batch in batches:
                encoded, sizes = encode(batch.column(1), end_id)
                tokens.write(encoded.tobytes())
                lengths.write(sizes.astype("<i8").tobytes())
                ids.write(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n_docs, n_null, n_tokens = n_docs + len(sizes), n_null + batch.column(0).null_count, n_tokens + len(encoded)
        yield batch_of(MANIFEST, {"part": [part], "attempt": [attempt], "n_docs": [n_docs], "n_null": [n_null], "n_tokens": [n_tokens]})

    manifest = store(ranged.mapInArrow(write, "part int, attempt string, n_docs long, n_null long, n_tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = SharedFiles(folder)
        for batch in batches:
            names = []
            for row in batch.to_pylist():
                lengths = files.map(_name("lengths", row["part"], row["attempt"]), "<i8")
                names.append(_name("offsets", row["part"], _attempt()))
                with files.writer(names[-1], "0") as out:
                    for at in range(0, len(lengths), 1 << 20):
                        some = np.cumsum(lengths[at : at + (1 << 20)])
                        out.write((row["base"] + np.concatenate([[0], some[:-1]])).astype("<i8").tobytes())
                        row["base"] += int(some[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], names=[*batch.schema.names, "offsets"])

    schema = "part int, attempt string, n_docs long, n_null long, n_tokens long, base long, offsets string"
    return store(based.repartition(n_tasks(docs, 20_000, rows), "part").mapInArrow(index, schema), "index")


def read_token_files(index: DataFrame, folder: str, dtype: str = "<u4", chunk: int = 1000) -> DataFrame:
    """Documents of token files: doc_id, start (ids of all documents before it), ids (little-endian, 32 bits each).

    A task maps the files of its parts and touches one stretch of documents after another.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = SharedFiles(folder)
        for batch in batches:
            for row in batch.to_pylist():
                tokens = files.map(_name("tokens", row["part"], row["attempt"]), dtype)
                starts, ids = files.map(row["offsets"], "<i8"), files.map(_name("docs", row["part"], row["attempt"]), "<i8")
                for at in range(0, row["n_docs"], chunk):
                    first = np.array(starts[at : at + chunk + 1])
                    if at + chunk >= row["n_docs"]:
                        first = np.append(first, row["base"] + row["n_tokens"])
                    cut = first - row["base"]
                    some = np.array(ids[at : at + chunk])
                    doc_ids = pa.array(some, mask=np.arange(at, at + len(some)) < row["n_null"])
                    data = binary_rows(tokens[cut[0] : cut[-1]].astype("<u4"), np.diff(cut))
                    yield batch_of(RECORD, {"doc_id": doc_ids, "start": first[:-1], "ids": data})

    return index.mapInArrow(read, "doc_id long, start long, ids binary")


def token_digests(records: DataFrame) -> DataFrame:
    return records.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, dtype: str) -> DataFrame:
    """Write token files of ``docs`` to the shared folder and read them back."""
    folder = scratch_path(spark, "tokens")
    index = write_token_files(docs, folder, tokenizer, end_id, dtype)
    return read_token_files(index, folder, dtype)
