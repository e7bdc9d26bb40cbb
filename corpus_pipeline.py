"""From documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firegrid.llm import exact_dedup, packing, quality, simhash, suffix_dedup
from firegrid.llm.queries import WORD_TOKENIZER
from firegrid.llm.shared import documents, store


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the policy go; null and empty texts fail, rows that repeat pass or fail alike."""
    return quality.keep_good(docs, "web-1")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays; ids shared by different texts count with their text."""
    return exact_dedup.drop_copies(docs, exact_dedup.exact_dedup(docs)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints the document with the smallest id stays; without any id, one of them."""
    return simhash.drop_near_copies(docs, radius=3).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated byte strings (and what is left of a character that is cut in two); rows and columns stay.

    Null text counts as empty and comes out so; n_chars is counted anew where there is such a column.
    """
    cut = suffix_dedup.remove_repeats(docs, carry=tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars")))
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens; null text gives the end id alone."""
    return packing.pack_documents(docs, WORD_TOKENIZER, end_id=0, capacity=2048, with_ids=False)


STAGES = [
    ("quality rules", reject_low_quality),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack_sequences),
]

#: Fingerprints and suffix sorting are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents; each writes Parquet to the shared folder and the next reads that."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs, f"stage{i}")
    return docs
