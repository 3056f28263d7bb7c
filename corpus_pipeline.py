"""A corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.chosen_path import keep_one_of_each
from tarn.llm.common import free_name, written
from tarn.llm.grace import keep_first_copies
from tarn.llm.packing import pack
from tarn.llm.secrets import redact
from tarn.llm.toxicity import learned_lexicon, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the lexicon is learned from the labels that may be learned from.

    Null and empty texts score as texts without hits, and stay. Each row is judged on its own: repeated rows stay or go
    alike, a very long text is judged by its length, and no rows give none. Any further columns stay as they are.
    """
    score = free_name(docs.columns, "_toxicity")
    return toxicity(docs, learned_lexicon(docs, sf_dir), out=score).where(F.col(score) < 0.5).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space: the longest, of ties the one with the smallest id.

    Null and empty texts are equal to each other. Of repeated rows one stays; a null id comes after all others. Texts are
    compared whole, however long; no rows give none.
    """
    return keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates.

    Null texts and texts without words have no near-duplicates and stay. Rows with one id stay or go together; rows
    without an id stay unless a row with an id is like them. All shingles of a very long text count; no rows give none.
    """
    return keep_one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text.

    Null and empty texts, and texts without secrets, stay as they are, and a null text keeps its n_chars. Each row is
    treated on its own: repeated rows change alike, of a very long text every secret is masked, and no rows give none.
    """
    return redact(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens.

    A null or empty text is one token. Repeated rows and null ids are packed like others, a very long text in several
    pieces; documents of one length are interchangeable. No rows give none.
    """
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scans", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL can't express the tokenizer of the last stage, nor the fit of the first; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
