"""Ranking of stated candidate lists: queries that name their candidates, any scorer, metrics at chosen cuts by task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.functions.text import iso_time, record_text, tokens
from relquill.operators import ranking
from relquill.sources.tables import materialise

#: A scorer takes pools (task, query_id, cand, query_text, text) and gives (query_id, cand, score); pairs that it leaves out score 0.
Scorer = Callable[[DataFrame], DataFrame]
#: The cuts of the standard bundle, and the buckets of the plain scorer.
KS, BUCKETS = (1, 5, 10), 1024
QUERY = "query_id string, task string, query_record string, candidates array<string>, relevant array<string>, hard_negatives array<string>, as_of string"


def pools(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(task, query_id, cand, query_text, text): each query with each of its distinct candidates. ``texts``: id, text.

    A query or candidate without a record has an empty text. Texts are joined by id; where a query is named often, Spark splits that key.
    """
    own = queries.select("task", "query_id", "query_record", F.explode(F.array_distinct("candidates")).alias("cand"))
    asked = texts.select(F.col("id").alias("query_record"), F.col("text").alias("query_text"))
    named = texts.select(F.col("id").alias("cand"), "text")
    out = own.join(asked, "query_record", "left").join(named, "cand", "left")
    return out.select("task", "query_id", "cand", *(F.coalesce(c, F.lit("")).alias(c) for c in ("query_text", "text")))


def hashed_cosine(pairs: DataFrame, dim: int = BUCKETS) -> DataFrame:
    """(query_id, cand, score): cosine of the counts of tokens in ``dim`` crc32 buckets; 0 where a text has no token."""

    def buckets(text: str):
        found = F.transform(tokens(text), lambda t: (F.crc32(t.cast("binary")) % dim).cast("int"))
        kinds = F.array_distinct(found)
        return F.map_from_arrays(kinds, F.transform(kinds, lambda b: F.size(F.filter(found, lambda x: x == b)).cast("double")))

    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.map_entries("q"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.element_at("c", e["key"]), F.lit(0.0)))
    both = pairs.select("query_id", "cand", buckets("query_text").alias("q"), buckets("text").alias("c"))
    return both.select("query_id", "cand", F.coalesce(F.try_divide(dot, norm(F.col("q")) * norm(F.col("c"))), F.lit(0.0)).alias("score"))


def evaluate(queries: DataFrame, scores: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(task, n_queries, recall_k of each cut, mrr, hard_negative_accuracy): one row for each task, of (query_id, cand, score).

    Candidates are ranked by score, then by id. A query without relevant ids counts with zeros. Hard negatives count where a query has
    both kinds; without any such query the accuracy is 0. One ranking and one aggregate by query, whatever the tasks and cuts.
    """
    own = queries.select("task", "query_id", F.explode(F.array_distinct("candidates")).alias("cand"), "relevant", "hard_negatives")
    flagged = own.select("task", "query_id", "cand", F.array_contains("relevant", F.col("cand")).alias("rel"), F.coalesce(F.array_contains("hard_negatives", F.col("cand")), F.lit(False)).alias("hard"))
    scored = flagged.join(scores.select("query_id", "cand", "score"), ["query_id", "cand"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    rank = ranking.ranked(scored, key="query_id")
    best = lambda c: F.min(F.when(F.col(c), F.col("rank")))
    found = rank.groupBy("query_id").agg(best("rel").alias("first"), best("hard").alias("neg"), *(F.count_if(F.col("rel") & (F.col("rank") <= k)).alias(f"hits_{k}") for k in ks))
    sizes = queries.select("task", "query_id", F.size(F.array_distinct("relevant")).alias("n_rel"), F.coalesce(F.size("hard_negatives"), F.lit(0)).alias("n_hard"))
    rows = sizes.join(found, "query_id", "left")
    share = lambda k: F.when(F.col("n_rel") > 0, F.coalesce(f"hits_{k}", F.lit(0)) / F.col("n_rel")).otherwise(0.0)
    win = F.when(F.col("first").isNull(), 0.0).when(F.col("neg").isNull() | (F.col("first") < F.col("neg")), 1.0).otherwise(0.0)
    judged = (F.col("n_hard") > 0) & (F.col("n_rel") > 0)
    return rows.groupBy("task").agg(
        F.count("*").alias("n_queries"), *(F.avg(share(k)).alias(f"recall_{k}") for k in ks), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.coalesce(F.avg(F.when(judged, win)), F.lit(0.0)).alias("hard_negative_accuracy"),
    )


def leaks(queries: DataFrame, records: DataFrame) -> DataFrame:
    """(query_id, id): candidates and relevant ids that begin after the query's as_of; unreadable times pass. ``records``: id, valid_from."""
    named = queries.select("query_id", iso_time("as_of").alias("until"), F.explode(F.array_union("candidates", "relevant")).alias("id")).where("until IS NOT NULL")
    return named.join(records.select("id", iso_time("valid_from").alias("since")), "id").where("since > until").select("query_id", "id").distinct()


def bench(queries: DataFrame, records: DataFrame, scorer: Scorer = hashed_cosine, ks: tuple[int, ...] = KS) -> tuple[DataFrame, DataFrame]:
    """(metrics by task, leaks) of ``queries`` (QUERY) over ``records`` (id, type, content as JSON text, valid_from)."""
    texts = records.select("id", record_text("content", "id", "type").alias("text"))
    scores = scorer(pools(queries, texts))
    return evaluate(queries, scores, ks), leaks(queries, records)


def bench_folder(spark: SparkSession, root: str, task: str | None = None, scorer: Scorer = hashed_cosine, ks: tuple[int, ...] = KS) -> tuple[DataFrame, DataFrame]:
    """``bench`` over ``root``/records.jsonl and the queries in ``root``/benchmark/*.jsonl, of one task if it is given."""
    lines = spark.read.option("lineSep", "\n").text(f"{root}/records.jsonl").where(F.trim("value") != "").select(F.parse_json("value").alias("v"))
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string").alias(k)
    records = lines.select(text("id"), text("type"), F.to_json(F.try_variant_get("v", "$.content", "variant")).alias("content"), text("valid_from"))
    queries = spark.read.option("lineSep", "\n").schema(QUERY).json(f"{root}/benchmark/*.jsonl").where("query_id IS NOT NULL")
    queries = materialise(queries if task is None else queries.where(F.col("task") == task), "queries")
    return bench(queries, records, scorer, ks)
