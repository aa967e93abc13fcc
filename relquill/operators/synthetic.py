"""Synthetic issues and changes of latent components: rare component tokens tell them, common topics mislead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.functions.text import hash_order


def picked(seed: int, what: str, key: Column, pool: int, k: int) -> Column:
    """``k`` distinct numbers below ``pool``: those with the smallest hashes."""
    every = F.transform(F.sequence(F.lit(0), F.lit(pool - 1)), lambda j: F.struct(hash_order(seed, F.lit(what), key, j).alias("h"), j.alias("j")))
    return F.transform(F.slice(F.array_sort(every), 1, k), lambda x: x["j"])


def generate(
    spark: SparkSession, seed: int = 7, components: int = 10, each: int = 24, impl: int = 12, topics: int = 40,
    issue_topics: int = 10, issue_impl: int = 2, change_impl: int = 8, change_topics: int = 6, train: float = 0.6,
) -> DataFrame:
    """(n, component, split, issue, change): tokens of an issue and of the change that fixes it, for each pair.

    An issue has many topics and few of its component's tokens, its change the reverse. Picks follow hashes, so the data have the
    distribution of a seeded generator, not its draws.
    """
    n = spark.range(components * each).select(F.col("id").alias("n"), F.floor(F.col("id") / each).alias("component"))
    token = lambda prefix: lambda j: F.concat(prefix, F.lpad(j.cast("string"), 2, "0"))
    own, topic = token(F.concat(F.lit("implc"), "component", F.lit("n"))), token(F.lit("topic"))
    part = lambda what, pool, k, name: F.transform(picked(seed, what, F.col("n"), pool, min(k, pool)), name)
    split = F.when(hash_order(seed, F.lit("split"), "n") < int(train * 2**32), "train").otherwise("test")
    issue = F.concat(part("it", topics, issue_topics, topic), part("ii", impl, issue_impl, own))
    change = F.concat(part("ci", impl, change_impl, own), part("ct", topics, change_topics, topic))
    return n.select("n", "component", split.alias("split"), issue.alias("issue"), change.alias("change"))


def pools(data: DataFrame, hard: int = 5, random: int = 6, seed: int = 7) -> DataFrame:
    """(n, cand, kind): the true change, other components' changes with the most topics in common, and others in hash order.

    The data are a fixture of a few hundred pairs, so every issue meets every change of another component.
    """
    from pyspark.sql import Window

    topics = lambda c: F.filter(c, lambda t: t.startswith("topic"))
    a = data.select("n", "component", topics("issue").alias("ts"))
    b = data.select(F.col("n").alias("cand"), F.col("component").alias("other"), topics("change").alias("us"))
    pairs = a.join(b, F.col("component") != F.col("other")).select("n", "cand", F.size(F.array_intersect("ts", "us")).alias("score"))
    w = Window.partitionBy("n")
    pairs = pairs.withColumn("k", F.row_number().over(w.orderBy(F.col("score").desc(), "cand")))
    rest = pairs.where(F.col("k") > hard).withColumn("j", F.row_number().over(w.orderBy(hash_order(seed, "n", "cand"), "cand"))).where(F.col("j") <= random)
    return data.select("n", F.col("n").alias("cand"), F.lit("positive").alias("kind")).union(pairs.where(F.col("k") <= hard).select("n", "cand", F.lit("hard"))).union(rest.select("n", "cand", F.lit("random")))
