"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from firegrid.llm.shared import batch_of, in_batches, safe_pieces, texts_of

#: n-grams of a profile, of a language as of a document.
PROFILE = 400
#: Labelled rows per language that profiles are learned from (a share of each language drawn by the
#: hash of the id, this many on average); a language with fewer rows gives all of them.
SAMPLE = 5000
UNKNOWN = "und"
PIECE = 1 << 20
_LETTERS: list = []

GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def letters() -> np.ndarray:
    """Which code points are letters; made once per worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of 1 to 3 characters within words (a blank on either side counts) and how often each occurs.

    An n-gram is a number: 21 bits a character, the first one lowest. Whatever is no letter parts words.
    """
    found = [_piece_counts(p) for p in safe_pieces(text, PIECE)]
    if len(found) == 1:
        return found[0]
    grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)


def _piece_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(letters()[codes], codes, 32).astype(np.int64)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    one, two = codes[codes != 32], codes[:-1] | codes[1:] << 21
    three = (two[:-1] | codes[2:] << 42)[codes[1:-1] != 32]
    grams = np.sort(np.concatenate([one, two, three]))
    if len(one) == 0:
        return grams[:0], grams[:0]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.diff(np.concatenate([first, [len(grams)]]))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, text) of the rows that profiles are learned from: labelled, with an id, not held out.

    Languages are counted over all rows; each is then thinned by the hash of the id, in the scan.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    limits = [F.lit(x) for lang, n in counts.items() for x in (lang, min(1 << 30, (sample << 30) // n))]
    if not limits:
        return usable.select("lang", "text").limit(0)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.element_at(F.create_map(*limits), F.col("lang"))
    return usable.where(drawn).select("lang", "text")


@dataclass(frozen=True)
class Profiles:
    langs: list[str]
    grams: np.ndarray  # sorted n-grams of all profiles
    ranks: np.ndarray  # [language, n-gram]: its rank, or -1 where the profile lacks it


def learn(rows: DataFrame, size: int = PROFILE) -> Profiles:
    """The ``size`` most frequent n-grams of each language of ``rows`` (lang, text), ties by n-gram."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                by_lang.setdefault(lang, []).append(gram_counts(text))
            for lang, found in by_lang.items():
                grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n for _, n in found]), len(grams)).astype(np.int64)
                yield batch_of(GRAMS, {"lang": [lang] * len(grams), "gram": grams, "n": n})

    counted = in_batches(rows).mapInArrow(task, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    top = counted.withColumn("rank", rank).where(F.col("rank") < size).collect()  # ``size`` rows a language
    langs = sorted({r["lang"] for r in top})
    grams = np.unique(np.array([r["gram"] for r in top], np.int64))
    ranks = np.full((len(langs), len(grams)), -1, np.int64)
    for r in top:
        ranks[langs.index(r["lang"]), np.searchsorted(grams, r["gram"])] = r["rank"]
    return Profiles(langs, grams, ranks)


def predict_text(text: str, profiles: Profiles, size: int = PROFILE) -> tuple[str, float]:
    """The language whose profile is nearest by out-of-place distance, and 1 less its share of the largest distance.

    An n-gram of the document costs the difference of its two ranks, or ``size`` where the profile lacks it.
    """
    grams, n = gram_counts(text)
    if not len(grams) or not profiles.langs:
        return UNKNOWN, 0.0
    top = grams[np.argsort(-n, kind="stable")[:size]]
    at = np.minimum(np.searchsorted(profiles.grams, top), len(profiles.grams) - 1)
    theirs = np.where(profiles.grams[at] == top, profiles.ranks[:, at], -1)
    cost = np.where(theirs < 0, size, np.abs(theirs - np.arange(len(top))))
    distance = cost.sum(1)
    best = int(distance.argmin())
    return profiles.langs[best], float(1 - distance[best] / (size * len(top)))


def identify(docs: DataFrame, profiles: Profiles, size: int = PROFILE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Only the text is looked at. Null text or text without a letter is ``und`` with score 0, and so is
    every text where no language was learned; equal texts get equal predictions. Profiles are ``size``
    numbers a language, so what tasks receive is bounded by the number of languages.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict_text(t, profiles, size) for t in texts_of(batch)]
            columns = {"doc_id": batch.column(0), "held_out": batch.column(1)}
            yield batch_of(PREDICTED, columns | {"lang_pred": [x for x, _ in found], "score": [x for _, x in found]})

    return in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        task, "doc_id long, held_out boolean, lang_pred string, score double"
    )
