"""From raw documents to training tokens: reject, deduplicate, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; what a stage returns is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import exact_dedup, minmax, mixing, pieces, toxicity
from corvane.llm.langid import fold
from corvane.llm.queries import PIECE_BPE, table, tokenizer_path
from corvane.llm.shared import discard, only, saved


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; all columns, whatever their names.

    Null and empty texts get the score of a text without any feature and stay unless labels say that all are
    toxic; rows with a null id are scored like others; repeated rows go or stay together; without labels
    nothing goes; an empty table stays empty. Whole texts of any length are read.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return toxicity.reject(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that of the smallest id, null ids last; of rows that repeat id and text one.

    Null counts as empty text; blanks as in the operator; rows of one id with other texts stay.
    """
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words and a similarity of 0.8 or more: that of the smallest id.

    Documents without words and rows with a null id are like nothing and stay. Rows of one id are told apart by
    their texts, so one whose text is like no other's stays.
    """
    return minmax.keep_one(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, with its columns and mix_copy, which numbers its copies from 0.

    Null sources are a source of their own; rows of one id come equally often if of one source; documents without words
    come as their source's hash threshold says; an empty table stays empty.
    """
    return mixing.mixed(docs, copy_col="mix_copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece counts and checksums of every document and copy, encoded and decoded again; null and empty texts have no pieces."""
    return pieces.encode_documents(docs, tokenizer_path(PIECE_BPE), copy_col="mix_copy")


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL cannot express the classifier, the sketches and the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on all that the one before kept. Tables that a stage leaves behind are deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with only() as keep:
            kept = saved(stage(spark, docs, sf_dir), f"stage-{name}")
            keep.append(kept)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
