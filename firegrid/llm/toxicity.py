"""Toxicity of texts whose disguises are undone first: a noisy channel over character lattices, then a linear score."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.llm.shared import batch_of, in_batches, safe_pieces, store, texts_of

# Characters that stand in for letters.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e",
}
# Natural logarithms of the channel's probabilities.
STAND_IN = -1.0
SHORTENED, KEPT_RUN = -0.7, -3.0
JOINED, KEPT_GAP = -0.1, -3.0

#: Labelled rows that the scorer is fitted on: a share drawn by the hash of id and text, this many on average.
SAMPLE = 40_000
#: Character sequences that the scorer looks for: those most over-represented in toxic texts.
FEATURES = 2000
GRAM_SIZES = (4, 5, 6)
#: Lattice places that are decoded at once; longer tokens go on from the characters decoded last.
STRETCH = 512
PIECE = 1 << 20
#: Tokens that a task remembers.
MEMORY = 400_000

LETTERS = [c for c in map(chr, [*range(0x61, 0x7B), *range(0xDF, 0x180)]) if c.islower()]
GAP, OTHER = 0, 1
NOTHING: frozenset[int] = frozenset()
CLASSES = 2 + len(LETTERS)
_CLASS_OF: list = []

_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\S+")
_SUSPECT = re.compile(r"[^\W\d_][0-9@$€]|[0-9@$€][^\W\d_]|[^\W\d_][!|+](?=[^\W\d_])|([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)[\w@$!|+€](?:([ .\-_*])[\w@$!|+€])(?:\1[\w@$!|+€])+(?!\S)")
_SPACED_PART = re.compile(r"[\w@$!|+€]([ .\-_*])[\w@$!|+€]\1[\w@$!|+€]")
_RUN_OF_THREE = re.compile(r"(.)\1\1")
_EDGES = ".,;:!?\"'()"
_RUN = re.compile(r"(.)\1*", re.S)

GRAMS = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
WORDS = pa.schema([("word", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
SCORED = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_restored", pa.int64())]
)


# Character language model ---------------------------------------------------------------------------


def class_of() -> np.ndarray:
    """The class of every code point: a lower-case Latin letter, another letter or digit, or a gap; made once per worker."""
    if not _CLASS_OF:
        table = np.fromiter((OTHER if chr(c).isalnum() else GAP for c in range(0x110000)), np.int16, 0x110000)
        table[[ord(c) for c in LETTERS]] = np.arange(2, CLASSES)
        _CLASS_OF.append(table)
    return _CLASS_OF[0]


def gram_counts(text: str) -> np.ndarray:
    """Counts of three classes in a row; gaps in a row count as one, and no context reaches behind a gap."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    c = class_of()[codes].astype(np.int64)
    c = c[np.concatenate([[True], (c[1:] != GAP) | (c[:-1] != GAP)])]
    c = np.concatenate([[GAP], c])
    before = np.where(c[1:-1] == GAP, GAP, c[:-2])
    return np.bincount((before * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)


@dataclass(frozen=True)
class CharacterModel:
    """Natural log-probabilities of a class after the two before it."""

    logs: np.ndarray

    @classmethod
    def of_counts(cls, counts: np.ndarray, weight: float = 5.0) -> CharacterModel:
        three = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 1) / (one.sum() + CLASSES)
        p2 = (two + weight * p1) / (two.sum(1, keepdims=True) + weight)
        p3 = (three + weight * p2) / (three.sum(2, keepdims=True) + weight)
        return cls(np.log(p3).astype(np.float32))

    def step(self, state: tuple[int, int], c: int) -> tuple[float, tuple[int, int]]:
        a, b = state
        if c == GAP and b == GAP:
            return 0.0, (GAP, GAP)
        return float(self.logs[a, b, c]), (GAP if c == GAP else b, c)


def character_model(docs: DataFrame, text_col: str = "text") -> CharacterModel:
    """Counted over the whole texts of all rows; what reaches the driver is bounded by the cube of the classes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(CLASSES**3, np.int64), [], 0
        for batch in batches:
            for text in texts_of(batch):
                for piece in safe_pieces(text, PIECE):
                    held.append(piece)
                    size += len(piece)
                    if size >= PIECE:
                        total += gram_counts(" ".join(held))
                        held, size = [], 0
        total += gram_counts(" ".join(held))
        grams = np.flatnonzero(total)
        for at in range(0, len(grams), 50_000):
            some = grams[at : at + 50_000]
            yield batch_of(GRAMS, {"gram": some, "n": total[some]})

    counted = in_batches(docs).select(F.col(text_col).alias("text")).mapInArrow(task, "gram long, n long")
    counts = np.zeros(CLASSES**3)
    for row in counted.groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["gram"]] = row["n"]
    return CharacterModel.of_counts(counts)


# Noisy channel --------------------------------------------------------------------------------------

Place = list[tuple[str, float]]


def options(c: str) -> Place:
    """What an observed character may stand for, with the channel's log-probability."""
    return [(c, 0.0), *((letter, STAND_IN) for letter in LOOK_ALIKES.get(c, ""))]


def token_lattice(token: str) -> list[Place]:
    """A place per character; a run of three or more is one place that may be one, two or all of them."""
    places: list[Place] = []
    for run in _RUN.finditer(token):
        c, n = run.group(1), len(run.group())
        if n < 3:
            places += [options(c)] * n
        else:
            short = [(e * k, p + SHORTENED) for e, p in options(c) for k in (1, 2)]
            places.append([*short, (c * n, KEPT_RUN)])
    return places


def spaced_lattice(segment: str) -> list[Place]:
    """Single characters and, between them, separators that may go or stay as a gap."""
    return [options(c) if i % 2 == 0 else [("", JOINED), (" ", KEPT_GAP)] for i, c in enumerate(segment)]


def viterbi(places: list[Place], model: CharacterModel, start: tuple[int, int], end: bool) -> tuple[str, tuple[int, int]]:
    """The likeliest string through ``places`` and the two classes it ends with; with ``end``, a gap follows.

    A state is the last two classes, so the search is exact. Of equal scores the earlier option stays.
    """
    classes = class_of()
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {start: (0.0, None)}
    for place in places:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for state, (score, path) in best.items():
            for text, channel in place:
                at, total = state, score + channel
                for c in text:
                    p, at = model.step(at, int(classes[ord(c)]))
                    total += p
                if at not in new or total > new[at][0]:
                    new[at] = total, (path, text)
        best = new
    ranked = ((s + (model.step(at, GAP)[0] if end else 0.0), at, path) for at, (s, path) in best.items())
    _, state, path = max(ranked, key=lambda r: r[0])
    parts = []
    while path is not None:
        path, text = path
        parts.append(text)
    return "".join(reversed(parts)), state


def decode(places: list[Place], model: CharacterModel) -> str:
    state, out = (GAP, GAP), []
    for at in range(0, len(places), STRETCH):
        text, state = viterbi(places[at : at + STRETCH], model, state, at + STRETCH >= len(places))
        out.append(text)
    return "".join(out)


class Restorer:
    """Texts in lower case with their disguises undone; remembers the tokens it has looked at."""

    def __init__(self, model: CharacterModel):
        self.model = model
        self.known: dict[str, str] = {}

    def token(self, token: str) -> str:
        """``token`` restored; most are looked at once and stay as they are."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= MEMORY:
                self.known.clear()
            found = decode(token_lattice(token), self.model) if _SUSPECT.search(token) else token
            self.known[token] = found
        return found

    def joined(self, text: str) -> tuple[str, int]:
        """``text`` in lower case with spaced-out words put together, and how many there were."""
        text, n = text.lower(), 0
        if _SPACED_PART.search(text):

            def put(m: re.Match) -> str:
                nonlocal n
                found = decode(spaced_lattice(m.group()), self.model)
                n += found != m.group()
                return found

            text = _SPACED.sub(put, text)
        return text, n

    def __call__(self, text: str) -> tuple[str, int]:
        """The restored text and how many different stretches of it were changed."""
        text, n = self.joined(text)
        changed = {t: r for t in set(text.split()) if (r := self.token(t)) != t}
        if changed:
            text = _TOKEN.sub(lambda m: changed.get(m.group(), m.group()), text)
        return text, n + len(changed)


def restore(docs: DataFrame, model: CharacterModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, restored, n_restored) of every row; null text counts as empty. Other columns are left out."""
    schema = pa.schema([("doc_id", pa.int64()), ("restored", pa.string()), ("n_restored", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Restorer(model)
        for batch in batches:
            found = [own(t) for t in texts_of(batch)]
            yield batch_of(schema, {"doc_id": batch.column(0), "restored": [t for t, _ in found], "n_restored": [n for _, n in found]})

    chosen = in_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(task, "doc_id long, restored string, n_restored long")


# Scorer ---------------------------------------------------------------------------------------------


def held_out(id_col: Column) -> Column:
    """Rows that labels are never learned from; rows without an id are among them."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(5)) == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of labelled rows that are not held out, thinned by the hash of id and text to about ``sample``.

    An id with several labels is toxic where one of them says so; null labels say nothing.
    """
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), "toxic")
    known = known.groupBy("_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    ids = docs.select(F.col("doc_id").cast("long").alias("_id"))
    n = ids.join(known, "_id").count()  # narrow rows, before any text is read
    if not n:
        return docs.select(F.lit("").alias("text"), F.lit(0).alias("toxic")).limit(0)
    drawn = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    if n > sample:
        drawn = drawn.where(F.pmod(F.xxhash64("_id", "text"), F.lit(1 << 30)) < (sample << 30) // n)
    return drawn.join(known, "_id").select("text", F.col("_toxic").alias("toxic"))


@dataclass(frozen=True)
class ToxicityModel:
    characters: CharacterModel
    grams: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0


class Scanner:
    """Finds which of ``grams`` occur in the words of a text, in one pass."""

    def __init__(self, grams: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, gram in enumerate(grams):
            self.automaton.add_word(gram, i)
        if grams:
            self.automaton.make_automaton()
        self.empty = not grams

    def __call__(self, text: str) -> frozenset[int]:
        if self.empty:
            return NOTHING
        word = text.strip(_EDGES)
        if not word.isalpha():
            word = "  ".join(_WORD.findall(text))
        return frozenset([i for _, i in self.automaton.iter(f" {word} ")]) or NOTHING


class Judge:
    """Scores of texts by what their restored tokens hold; remembers the tokens it has looked at."""

    def __init__(self, model: ToxicityModel):
        self.model, self.restorer, self.scan = model, Restorer(model.characters), Scanner(model.grams)
        self.known: dict[str, tuple[bool, frozenset[int]]] = {}

    def _look(self, token: str) -> tuple[bool, frozenset[int]]:
        suspect = _RUN_OF_THREE if token.isalpha() else _SUSPECT
        restored = decode(token_lattice(token), self.model.characters) if suspect.search(token) else token
        found = restored != token, self.scan(restored)
        if len(self.known) >= MEMORY:
            self.known.clear()
        self.known[token] = found
        return found

    def __call__(self, text: str) -> tuple[float, int]:
        """The score and how many different stretches were restored for it."""
        text, n = self.restorer.joined(text)
        hits: set[int] = set()
        for token in set(text.split()):
            changed, found = self.known.get(token) or self._look(token)
            n += changed
            if found:
                hits |= found
        logit = self.model.intercept + float(self.model.weights[sorted(hits)].sum())
        return 1 / (1 + math.exp(-min(max(logit, -700.0), 700.0))), n


def _word_table(rows: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many texts of either label each word occurs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter(), Counter()
            for text, toxic in zip(texts_of(batch), batch.column(1).to_pylist()):
                found[toxic].update(set(_WORD.findall(text)))
            words = list(found[0] | found[1])
            yield batch_of(WORDS, {"word": words, "toxic": [found[1][w] for w in words], "clean": [found[0][w] for w in words]})

    counted = in_batches(rows).select("text", F.col("toxic").cast("int")).mapInArrow(task, "word string, toxic long, clean long")
    return counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def telling_grams(rows: DataFrame, size: int = FEATURES) -> list[str]:
    """The ``size`` parts of words that are most over-represented in toxic texts by the log-likelihood ratio.

    Parts are the words themselves and what they hold of ``GRAM_SIZES`` characters, a blank on either
    side counted. Parts without significance (below 10.8, one in a thousand by chance) are no features.
    """
    words = store(_word_table(rows), "words")
    total = words.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    if not total["toxic"] or not total["clean"]:
        return []
    pieces = [
        f"transform(sequence(1, greatest(length(w) - {k - 1}, 1)), i -> substring(w, i, {k}))" for k in GRAM_SIZES
    ]
    grams = F.expr(f"array_distinct(concat(array(w), {', '.join(pieces)}))")
    counted = (
        words.select(F.concat(F.lit(" "), "word", F.lit(" ")).alias("w"), "toxic", "clean")
        .select(F.explode(grams).alias("gram"), "toxic", "clean")
        .groupBy("gram").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
        .where(F.length("gram") >= min(GRAM_SIZES))
    )
    a, b, toxic, clean = F.col("a"), F.col("b"), float(total["toxic"]), float(total["clean"])
    share = (a + b) / F.lit(toxic + clean)

    def part(n: Column, expected: Column) -> Column:
        return F.when(n > 0, n * F.ln(n / expected)).otherwise(0.0)

    ratio = 2 * (part(a, share * toxic) + part(b, share * clean))
    strong = counted.withColumn("g", F.round(ratio, 6)).where((a * clean > b * toxic) & (F.col("g") > 10.8))
    return [r["gram"] for r in strong.orderBy(F.desc("g"), "gram").limit(size).collect()]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = FEATURES) -> ToxicityModel:
    """Character model over all ``docs``; scorer over a bounded sample of the labelled rows (``training_rows``).

    Without labels of both kinds the score is the smoothed share of toxic rows for every text.
    """
    characters = character_model(docs)
    raw = training_rows(docs, labels, sample)
    schema = pa.schema([("text", pa.string()), ("toxic", pa.int32())])

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Restorer(characters)
        for batch in batches:
            yield batch_of(schema, {"text": [own(t)[0] for t in texts_of(batch)], "toxic": batch.column(1)})

    rows = store(in_batches(raw).mapInArrow(restored, "text string, toxic int"), "labelled")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    grams = telling_grams(rows, size)
    base = math.log((toxic + 1) / (clean + 3))
    if not grams:
        return ToxicityModel(characters, intercept=base)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(grams)
        for batch in batches:
            hits = [sorted(own(t)) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(hits, pa.list_(pa.int32()))], names=["toxic", "hits"])

    width = len(grams)
    sparse = F.udf(lambda hits: SparseVector(width, hits, [1.0] * len(hits)), VectorUDT())  # over the bounded sample only
    table = store(in_batches(rows).mapInArrow(vectors, "toxic int, hits array<int>"), "hits")
    ready = table.select(F.col("toxic").cast("double").alias("label"), sparse("hits").alias("features"))
    fitted = LogisticRegression(regParam=1e-4, maxIter=100, standardization=False).fit(ready)
    return ToxicityModel(characters, grams, fitted.coefficients.toArray(), float(fitted.intercept))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, n_restored (stretches whose disguise was undone).

    Only the text is looked at. Null text counts as empty and gets the score of a text without any
    telling part; equal texts get equal scores. An empty table gives no rows, other columns are left
    out. A task holds a batch of texts; a long token is decoded ``STRETCH`` places at a time.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Judge(model)
        for batch in batches:
            found = [own(t) for t in texts_of(batch)]
            columns = {"doc_id": batch.column(0), "held_out": batch.column(1), "score": [p for p, _ in found]}
            columns |= {"predicted": [int(p >= 0.5) for p, _ in found], "n_restored": [n for _, n in found]}
            yield batch_of(SCORED, columns)

    chosen = in_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text")
    )
    return chosen.mapInArrow(task, "doc_id long, held_out boolean, score double, predicted int, n_restored long")
