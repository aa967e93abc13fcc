"""The queries of this subpackage: one for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, exact_dedup, language_mixture, license_join, mixing, phrase_automata, piece_bpe, prefix_trie, quality_rules, simhash, toxicity, warc, yinyang
from .common import held_out, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = language_mixture.fit(docs, "text", "lang", "doc_id", ~F.col("held_out"))
    return language_mixture.identify(docs, *model, keep=("doc_id", "held_out"))


def op2_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.backoff_scores(table(spark, sf_dir, "documents")).withColumn("log_score", F.round("log_score", 6))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out().alias("held_out"))
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), ~held_out())
    return toxicity.score(docs, model, keep=("doc_id", "held_out"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator hashes survivors only; the digest that the contract wants of every text is a column that passes beside it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(exact_dedup.normalised(F.col("text")).cast("binary"), 256).alias("digest"))
    return exact_dedup.exact_duplicates(docs, keep=("digest",)).drop("text_sha256").withColumnRenamed("digest", "text_sha256")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.license_scan(table(spark, sf_dir, "documents"))


def op8_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_bpe.encode_decode(docs, piece_bpe.read_model(tokenizer_path()), with_ids=False)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn_from(docs, table(spark, sf_dir, "labels"), allowed=~held_out())
    found = quality_rules.quality(docs, rules)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = yinyang.cluster(table(spark, sf_dir, "embeddings"))
    return found.withColumn("centroid_sha256", yinyang.digest(F.col("centroid"))).drop("centroid")


def op12_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_automata.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_mixture, op2_stupid_backoff, op3_toxicity, op4_warc, op5_poisson_mixing, op6_exact_dedup, op7_license_scan, op8_piece_bpe, op9_quality_rules, op10_simhash, op11_yinyang,
        op12_phrase_automata, op13_prefix_trie,
    )
}

#: DuckDB SQL where SQL can express the operator; the others are tested against brute force.
ORACLES = {
    "op2_stupid_backoff": backoff_lm.backoff_sql(),
    "op5_poisson_mixing": mixing.mix_sql(),
    "op6_exact_dedup": exact_dedup.exact_sql(),
    "op7_license_scan": license_join.license_sql(),
    "op11_yinyang": yinyang.cluster_sql(),
    "op12_phrase_automata": phrase_automata.repeats_sql(),
    "op13_prefix_trie": prefix_trie.trie_sql(),
}
