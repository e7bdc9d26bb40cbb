"""Quality rules as a ledger: every rule is evaluated once, policies are bit masks over its failures."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firegrid.llm.shared import batch_of, in_batches, texts_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Words of a window that repeats.
WINDOW = 5

MEASURES = pa.schema(
    [("doc_id", pa.int64())]
    + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")]
)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words found twice or more in the text."""
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    seen: dict = {}
    if len(set(windows)) == len(windows):
        return 0
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    n, end = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + WINDOW - max(i, end)
            end = i + WINDOW
    return n


def measure_text(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row of measurements per row of ``docs``; null text counts as none. ``carry`` adds the whole row as ``row``."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if carry:
        own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).field(text_col).to_pylist() if carry else texts_of(batch)
            rows = [measure_text(t or "") for t in texts]
            columns = dict(zip(MEASURES.names[1:], map(list, zip(*rows)))) if rows else dict.fromkeys(MEASURES.names, [])
            out = batch_of(MEASURES, columns | {"doc_id": batch.column(0)})
            yield out.append_column("row", batch.column(1)) if carry else out

    schema = T.StructType([T.StructField(n, T.LongType()) for n in MEASURES.names] + ([own.schema["row"]] if carry else []))
    return in_batches(own).mapInArrow(task, schema)


def at_most(share: float, part: str, of: str) -> Column:
    """False where ``part`` exceeds ``share`` (a per mille number of whole per milles) of ``of``."""
    return F.col(part) * 1000 > F.col(of) * int(round(share * 1000))


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: Column


def rules() -> list[Rule]:
    """The rules, each with the bit it owns for good; a changed threshold is a new rule with a new bit."""
    # Thresholds of published web-corpus filters.
    return [
        Rule(0, "few_words", F.col("n_words") < 10),
        Rule(1, "repeats", F.col("n_repeat_words") * 100 > F.col("n_words") * 20),
        Rule(2, "symbols", at_most(0.1, "n_symbols", "n_words")),
        Rule(3, "dup_lines", at_most(0.3, "n_dup_lines", "n_lines")),
        Rule(4, "short_words", F.col("word_chars") < 3 * F.col("n_words")),
        Rule(5, "long_words", F.col("word_chars") > 12 * F.col("n_words")),
        Rule(6, "many_words", F.col("n_words") > 100_000),
    ]


#: Versioned policies: the rules that each applies. A version never changes; a new one is added.
POLICIES = {
    "base-1": ("few_words", "repeats"),
    "web-1": ("few_words", "repeats", "symbols", "dup_lines", "short_words", "long_words"),
}


def mask(policy: str) -> int:
    bits = {r.name: r.bit for r in rules()}
    return sum(1 << bits[name] for name in POLICIES[policy])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Measurements and ``failures`` (bit b is set where the rule of bit b fails), one row per row of ``docs``."""
    bits = [F.when(r.fails, F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in rules()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measures(docs, id_col, text_col, carry).withColumn("failures", total.cast("long"))


def verdicts(table: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``base_failed`` (fails a rule of base-1) and ``kept`` (fails none of ``policy`` or base-1).

    A text without words fails. Every row gets a verdict; repeated rows get the same one.
    """
    base, own = mask("base-1"), mask("base-1") | mask(policy)
    return table.withColumn("base_failed", F.col("failures").bitwiseAND(F.lit(base)) != 0).withColumn(
        "kept", F.col("failures").bitwiseAND(F.lit(own)) == 0
    )


def keep_good(docs: DataFrame, policy: str) -> DataFrame:
    """Rows of ``docs`` that ``policy`` keeps, as they are."""
    return verdicts(ledger(docs, carry=True), policy).where("kept").select("row.*")


def ablations(table: DataFrame, policy: str) -> DataFrame:
    """Per rule of ``policy``: rows it fails, rows only it fails (kept without it), rows kept by it alone.

    The ledger shrinks to a count per failure pattern (2^rules rows at most) before any rule is looked at.
    """
    own = mask(policy)
    patterns = table.groupBy(F.col("failures").bitwiseAND(F.lit(own)).alias("p")).agg(F.count("*").alias("n"))
    chosen = [r for r in rules() if own >> r.bit & 1]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("b")) for r in chosen]))
    rows = patterns.select("p", "n", each.alias("r")).select("p", "n", "r.rule", "r.b")
    hit = F.col("p").bitwiseAND(F.col("b")) != 0
    zero = F.lit(0).cast("long")
    return rows.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(zero)).alias("fails"),
        F.sum(F.when(F.col("p") == F.col("b"), F.col("n")).otherwise(zero)).alias("fails_alone"),
        F.sum(F.when(~hit, F.col("n")).otherwise(zero)).alias("kept_if_alone"),
    )


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT k, i, array_to_string(words[i:i+4], ' ') AS g
  FROM (SELECT k, words, unnest(range(1, greatest(len(words) - 3, 1))) AS i FROM w)),
rep AS (SELECT k, i FROM win QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
cov AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS j FROM rep) GROUP BY k),
lines AS (
  SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (k) LEFT JOIN lines USING (k)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 1000 * n_symbols > 100 * n_words OR 1000 * n_dup_lines > 300 * n_lines
    OR word_chars < 3 * n_words OR word_chars > 12 * n_words) AS kept
FROM b
"""

ABLATION_ORACLE = ORACLE[: ORACLE.index("SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,")].rstrip() + r""",
f AS (
  SELECT n_words < 10 AS few_words, 100 * n_repeat_words > 20 * n_words AS repeats, 1000 * n_symbols > 100 * n_words AS symbols,
    1000 * n_dup_lines > 300 * n_lines AS dup_lines, word_chars < 3 * n_words AS short_words, word_chars > 12 * n_words AS long_words FROM b),
g AS (SELECT *, few_words::INT + repeats::INT + symbols::INT + dup_lines::INT + short_words::INT + long_words::INT AS failed FROM f),
l AS (
  SELECT failed, unnest([{'rule': 'few_words', 'fails': few_words}, {'rule': 'repeats', 'fails': repeats}, {'rule': 'symbols', 'fails': symbols},
    {'rule': 'dup_lines', 'fails': dup_lines}, {'rule': 'short_words', 'fails': short_words}, {'rule': 'long_words', 'fails': long_words}],
    recursive := true) FROM g)
SELECT rule, count(*) FILTER (fails)::BIGINT AS fails, count(*) FILTER (fails AND failed = 1)::BIGINT AS fails_alone,
  count(*) FILTER (NOT fails)::BIGINT AS kept_if_alone FROM l GROUP BY rule
"""
