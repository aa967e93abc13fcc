"""A corpus pipeline of five stages over ``documents``; each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relquill.llm import exact_dedup, mixing, piece_bpe, simhash_copies, toxicity
from relquill.llm.common import held_out, materialise, table
from relquill.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models predict to be toxic go.

    Null and empty texts have the score of no evidence; texts of any length are scored whole; repeated rows are judged alike. Without
    labels of both kinds, or without documents, all stay.
    """
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), ~held_out())
    return toxicity.score(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents, the longest original stays, then the smallest id, a null one last; of rows that tie, one.

    Null and empty texts are equal. Rows are told apart by themselves, so shared and null ids lose nothing.
    """
    return exact_dedup.drop_copies(docs).select(*COLUMNS)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles, one with the smallest id stays.

    Rows are told apart by text, so an id that other texts share, or a null one, loses nothing. Null and empty texts are one group.
    """
    return simhash_copies.drop_near_copies(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its Poisson draw says, in a global shuffle; rows without an id draw by their columns.

    A null source is a source of its own; repeated rows are drawn alike.
    """
    return mixing.mix(docs).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded text; null and empty texts have begin and end alone."""
    return piece_bpe.encode_decode(docs.select("doc_id", "source", "text"), piece_bpe.read_model(tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", keep_one_copy),
    ("SimHash near-dedup", keep_one_near_copy),
    ("mixing", mix_sources),
    ("SentencePiece", tokenize),
]

#: SQL can express neither the models nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; other columns than COLUMNS are not read, and an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, "stage")
    return docs
