"""Ranks, ranking metrics, fusion and resampling statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relquill.functions.text import hash_order
from relquill.operators.lexical import bounded
from relquill.sources.tables import materialise


#: Values that a bootstrap broadcasts, at most.
BROADCAST_VALUES = 1_000_000


def first(scores: DataFrame, *by: str) -> DataFrame:
    """(qid, by): the first candidate of each query by each of the scores ``by`` in the order of ``ranked``, as a partial aggregate instead of a sort."""
    return scores.groupBy("qid").agg(*(F.min(F.struct((-F.round(c, 9)).alias("s"), "cand"))["cand"].alias(c) for c in by))


def ranked(scores: DataFrame, top: int | None = None, by: str = "score", key: str = "qid", cand: str = "cand") -> DataFrame:
    """Adds ``rank``: by score rounded to 9 digits, largest first, then by candidate. ``top`` keeps the first ranks."""
    w = Window.partitionBy(key).orderBy(F.round(by, 9).desc(), cand)
    out = scores.withColumn("rank", F.row_number().over(w))
    return out if top is None else out.where(F.col("rank") <= top)


#: Bands that the scores of a query are cut into.
BANDS = 1000


def gold_ranks(scores: DataFrame, gold: DataFrame, by: str = "score") -> DataFrame:
    """(qid, cand, rank) of the relevant candidates alone.

    Each query's scores are cut into bands of equal width. Bands are counted, and only those that hold a relevant candidate are sorted: a rank is
    the candidates of higher bands and the place in the own one. So no candidate meets each relevant one, and rows grow with the scores
    alone. The scores are written once, as they are read several times.
    """
    scores = materialise(scores.select("qid", "cand", F.round(by, 9).alias("s")), "scores")
    ends = scores.groupBy("qid").agg(F.max("s").alias("top"), F.min("s").alias("least"))
    width = F.nullif((F.col("top") - F.col("least")) / BANDS, F.lit(0.0))
    banded = scores.join(bounded(ends), "qid").select("qid", "cand", "s", F.coalesce(F.floor((F.col("top") - F.col("s")) / width), F.lit(0)).alias("band"))
    counts = banded.groupBy("qid", "band").agg(F.count("*").alias("n"))
    before = Window.partitionBy("qid").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)  # a row for each band
    counts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = materialise(banded.join(bounded(gold.select("qid", "cand").distinct()), ["qid", "cand"], "left_semi").select("qid", "cand", "band"), "own")
    wanted = materialise(counts.join(own.select("qid", "band").distinct(), ["qid", "band"], "left_semi").select("qid", "band", "ahead"), "bands")
    place = F.row_number().over(Window.partitionBy("qid", "band").orderBy(F.col("s").desc(), "cand"))
    placed = banded.join(bounded(wanted), ["qid", "band"]).select("qid", "cand", (F.col("ahead") + place).alias("rank"))
    return placed.join(bounded(own.select("qid", "cand")), ["qid", "cand"], "left_semi")


def per_query(ranks: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row for each query of ``gold`` (qid, cand): recall and hit at k, reciprocal rank, nDCG at 10."""
    hits = gold.join(ranks.select("qid", "cand", "rank"), ["qid", "cand"], "left")
    top = F.min("rank")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.count("*"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, k: s + 1 / F.log2(k + 1.0))
    return hits.groupBy("qid").agg(
        F.count("*").alias("n_rel"),
        *((F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"recall_{k}") for k in ks),
        *(F.when(top <= k, 1.0).otherwise(0.0).alias(f"hit_{k}") for k in ks),
        F.coalesce(1 / top, F.lit(0.0)).alias("rr"),
        (F.coalesce(F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)) / ideal).alias("ndcg_10"),
    )


def hard_negative_wins(ranks: DataFrame, gold: DataFrame, hard: DataFrame) -> DataFrame:
    """(qid, win): whether the best relevant rank beats the best hard negative's; null without either kind."""
    best = lambda d, name: d.join(ranks, ["qid", "cand"], "left").groupBy("qid").agg(F.min("rank").alias(name))
    both = best(gold, "rel").join(best(hard, "neg"), "qid", "inner")
    return both.select("qid", F.when(F.col("rel").isNull(), 0.0).when(F.col("neg").isNull() | (F.col("rel") < F.col("neg")), 1.0).otherwise(0.0).alias("win"))


def z_score(value: Column, *keys: str) -> Column:
    """Population z-score within the keys, 0 where all values are equal."""
    w = Window.partitionBy(*keys)
    return F.coalesce((value - F.avg(value).over(w)) / F.nullif(F.round(F.stddev_pop(value).over(w), 12), F.lit(0.0)), F.lit(0.0))


def z_scored(scores: DataFrame, columns: list[str], key: str = "qid") -> DataFrame:
    """``scores`` with z_<column>: population z-scores within ``key`` by aggregates and a join, 0 where all values are equal."""
    own = scores.groupBy(key).agg(*(f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))))
    z = lambda c: F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.round(f"s_{c}", 12), F.lit(0.0)), F.lit(0.0)).alias(f"z_{c}")
    return scores.join(own, key).select(*scores.columns, *map(z, columns))


def late_fusion(scores: DataFrame, other: DataFrame) -> DataFrame:
    """(qid, cand, a, b, f): sum of z-scores of ``scores`` (a) and ``other`` (b); a missing b is the smallest of its pool (0 in an empty one)."""
    joined = scores.join(other, ["qid", "cand"], "left")
    least = joined.groupBy("qid").agg(F.coalesce(F.min("b"), F.lit(0.0)).alias("least"))
    filled = joined.join(least, "qid").select("qid", "cand", "a", F.coalesce("b", "least").alias("b"))
    return z_scored(filled, ["a", "b"]).select("qid", "cand", "a", "b", (F.col("z_a") + F.col("z_b")).alias("f"))


def sign_test(gains: Column, losses: Column) -> Column:
    """Two-sided p-value: twice the binomial tail (p = 0.5) up to the smaller count, at most 1; terms are built up in logarithms."""
    n, least = (gains + losses).cast("double"), F.least(gains, losses).cast("int")
    zero = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("total"))

    def add(state: Column, k: Column) -> Column:
        term = state["term"] + F.log((n - k + 1) / k)
        return F.struct(term.alias("term"), (state["total"] + F.exp(term)).alias("total"))

    steps = F.when(least > 0, F.sequence(F.lit(1), least)).otherwise(F.array().cast("array<int>"))
    return F.least(F.lit(1.0), 2 * F.aggregate(steps, zero, add)["total"])


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function, to about 1e-7 (a rational approximation of the error function)."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


#: Normal quantiles at 0.975 and 0.8.
Z_ALPHA, Z_POWER = 1.959963985, 0.841621234


def power(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row on paired outcomes: n, delta of a over b, sd, minimum detectable effect at 80 % power, achieved power, gains, losses."""
    d = F.col(a) - F.col(b)
    own = pairs.agg(F.count("*").alias("n"), F.avg(d).alias("delta"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd"), F.count_if(d > 0).alias("gains"), F.count_if(d < 0).alias("losses"))
    root = F.sqrt("n")
    mde = F.when(F.col("sd") > 0, (Z_ALPHA + Z_POWER) * F.col("sd") / root).otherwise(0.0)
    reached = F.when(F.col("sd") > 0, normal_cdf(F.abs("delta") * root / F.col("sd") - Z_ALPHA)).otherwise(1.0)
    return own.select("n", "delta", "sd", mde.alias("mde"), reached.alias("power"), "gains", "losses", (F.abs("delta") >= mde).alias("detectable"))


def group_deltas(pairs: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, n, mean_a, mean_b, delta, verdict) of paired outcomes by group."""
    own = pairs.groupBy(group).agg(F.count("*").alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg(F.col(a) - F.col(b)).alias("delta"))
    delta = F.round("delta", 12)
    return own.withColumn("verdict", F.when(delta > 0, "improved").when(delta < 0, "regressed").otherwise("equal"))


def across_splits(rows: DataFrame, split: str, config: str, value: str, control: str) -> DataFrame:
    """(config, n, mean, sd, gap, gap_sd, all_positive): each configuration over splits or seeds, and its paired gap to ``control``."""
    base = rows.where(F.col(config) == control).select(split, F.col(value).alias("base"))
    gap = F.col(value) - F.col("base")
    return rows.join(base, split, "left").groupBy(config).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.avg(gap).alias("gap"), F.stddev_pop(gap).alias("gap_sd"), F.coalesce(F.bool_and(F.round(gap, 12) > 0), F.lit(False)).alias("all_positive"),
    )


def lifts(metrics: DataFrame, system: str, control: str, *names: str) -> DataFrame:
    """``metrics`` of each system (one row each) less those of ``control``."""
    base = metrics.where(F.col(system) == control).select(*(F.col(n).alias(f"_{n}") for n in names))
    return metrics.join(F.broadcast(base)).select(system, *((F.col(n) - F.col(f"_{n}")).alias(f"lift_{n}") for n in names))


def bootstrap(values: DataFrame, b: int, seed: int, value: str = "delta") -> DataFrame:
    """(lo, hi, p_le_0): percentile interval of the mean over ``b`` resamples of the rows of ``values`` (ix from 0)."""
    spark = values.sparkSession
    n = values.count()
    draws = spark.range(b).select(F.col("id").alias("b")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))))
    draws = draws.select("b", F.pmod(hash_order(seed, "b", "i"), F.lit(max(n, 1))).alias("ix"))
    means = draws.join(F.broadcast(values) if n <= BROADCAST_VALUES else values, "ix").groupBy("b").agg(F.avg(value).alias("m"))
    return means.agg(
        F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"),
        F.avg((F.round("m", 9) <= 0).cast("double")).alias("p_le_0"), F.avg((F.round("m", 9) > 0).cast("double")).alias("frac_positive"),
    )
