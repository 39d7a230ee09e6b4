"""A training-data pipeline over documents: each stage applies one operator of loomspark.llm to what the last kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm.bpe import round_trip
from loomspark.llm.common import materialise, table
from loomspark.llm.decontaminate import drop_contaminated
from loomspark.llm.exact import keep_one_of_equal
from loomspark.llm.language import keep_known
from loomspark.llm.simhash import keep_one_of_near


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be told: a null or empty text, or one without a letter.

    Where no language could be learned, texts with a letter stay. Repeated rows go or stay together; an empty table stays
    empty; long texts are read whole; other columns pass through under any names. So in all stages but the last.
    """
    return keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; a null id ranks below all others, a null text is an empty
    one, and of rows that repeat id and text one stays."""
    return keep_one_of_equal(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, a similarity of 0.8 or more) the document with the smallest
    doc_id stays; ties and nulls: see keep_one_of_near. Texts without words, nulls among them, are one group."""
    return keep_one_of_near(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of ten words of a benchmark item, or a shorter item whole; null and empty texts
    and items match nothing."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document that is left; a null text counts as empty."""
    return round_trip(docs)


STAGES = [("language", known_language), ("exact", exact), ("near", near), ("decontaminate", decontaminated), ("bpe", tokens)]

#: Learned languages, fingerprints and merges have no SQL form; a test holds the rows against stages written out by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
