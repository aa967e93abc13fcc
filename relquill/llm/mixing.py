"""Mixing sources to target weights by Poisson replication.

A source's target repetition rate is the mean of a Poisson distribution. Each row's count is that distribution inverted at a
uniform number hashed from seed and id; the row is exploded by its count, and the copies are shuffled globally by hash.

Rows with a null source form a source of their own; equal ids of a source draw equal counts, and rows without an id draw by a hash
of all their columns. Repeated rows are replicated alike, long and null texts pass unchanged, an empty table gives an empty
result. All columns of the input pass under their names; where one clashes with ``copy``, the added one gets underscores in
front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Sources' distributions are broadcast up to so many (about 1 KB each); beyond, the join on the source is salted.
BROADCAST_SOURCES = 10_000
SALTS = 64
#: Larger means are split into a sum of Poisson draws with equal means of this at most, each from a hash of its own.
LARGEST_MEAN = 256.0


def uniform(seed: int, part: Column, key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 sum."""
    text = F.concat_ws("|", F.lit(str(seed)), part.cast("string"), key)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(2**52)


def rates(df: DataFrame, source_col: str, weights: dict[str, float] | None, temperature: float, epochs: float) -> DataFrame:
    """(source, rate): weight share times the target number of rows, over the source's rows."""
    counts = df.groupBy(F.col(source_col).alias("source")).agg(F.count("*").cast("double").alias("n"))
    if weights is None:
        weight = F.pow("n", F.lit(float(temperature)))
    else:
        weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v)))), F.col("source")), F.lit(0.0)) if weights else F.lit(0.0)
    counts = counts.withColumn("w", weight)
    total = counts.agg(F.sum("n").alias("rows"), F.sum("w").alias("sum"))  # one row
    return counts.join(F.broadcast(total)).select("source", F.coalesce(F.try_divide(F.col("w") / F.col("sum") * F.col("rows") * epochs, F.col("n")), F.lit(0.0)).alias("rate"))


def distributions(rates: DataFrame) -> DataFrame:
    """(source, parts, cdf): cumulative probabilities of 0, 1, ... for each of ``parts`` equal draws."""
    out = rates.withColumn("parts", F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN), F.lit(1)).cast("int")).withColumn("mean", F.col("rate") / F.col("parts"))
    last = F.ceil(F.col("mean") + 12 * F.sqrt("mean") + 40).cast("int")
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))
    step = lambda s, k: F.struct((s["p"] * F.col("mean") / k).alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * F.col("mean") / k)).alias("cdf"))
    return out.select("source", "parts", F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"].alias("cdf"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 42) -> DataFrame:
    """All columns of ``df`` and ``copy`` (1, 2, ...), each row as often as its draw says, shuffled globally.

    ``weights``: target share of each source (sources that it lacks get none); without it, shares are proportional to the
    source's rows to the power ``temperature``. ``epochs``: rows out, on average, over rows in.
    """
    copy = free_name(df, "copy")
    names = [F.col(f"`{c}`") for c in df.columns]
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("#"), F.xxhash64(F.to_json(F.struct(*names), {"ignoreNullFields": "false"})).cast("string")))
    held = df.select(F.struct(*names).alias("held"), F.col(f"`{source_col}`").alias("source"), key.alias("key"))  # no name of the input can clash
    table = distributions(rates(df.select(F.col(f"`{source_col}`").alias("source")), "source", weights, temperature, epochs))
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = held.join(F.broadcast(table), held["source"].eqNullSafe(table["source"]))
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = held.join(salted, held["source"].eqNullSafe(salted["source"]) & (F.pmod(F.xxhash64("key"), F.lit(SALTS)) == F.col("salt")))
    drawn = F.aggregate(
        F.sequence(F.lit(0), F.col("parts") - 1), F.lit(0),
        lambda s, k: s + F.aggregate("cdf", F.lit(0), lambda n, c: n + F.when(c <= uniform(seed, k, F.col("key")), 1).otherwise(0)),
    )
    one = F.aggregate("cdf", F.struct(F.lit(0).alias("n"), uniform(seed, F.lit(0), F.col("key")).alias("u")), lambda s, c: F.struct((s["n"] + F.when(c <= s["u"], 1).otherwise(0)).alias("n"), s["u"].alias("u")))["n"]
    times = joined.select("held", "key", F.when(F.col("parts") == 1, one).otherwise(drawn).alias("times")).where("times > 0")
    out = times.select("held", "key", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    place = F.xxhash64(F.lit(seed), F.col("key"), F.col("copy"))
    out = out.withColumn("place", place).repartition("place").sortWithinPartitions(F.xxhash64("place", F.lit(seed + 1)))
    return out.select("held.*", F.col("copy").alias(copy))


def mix_sql(temperature: float = 0.5, epochs: float = 1.0, seed: int = 42) -> str:
    """DuckDB SQL for ``mix`` of ``documents`` without weights and null ids, as long as no rate exceeds LARGEST_MEAN."""
    return f"""
WITH RECURSIVE n AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
r AS (SELECT source, pow(n, {temperature}) / (SELECT sum(pow(n, {temperature})) FROM n) * (SELECT sum(n) FROM n) * {epochs} / n AS rate FROM n),
c(source, rate, k, p, cdf) AS (SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 40)),
d AS (SELECT *, ('0x' || substr(md5('{seed}|0|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents),
t AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) FILTER (c.cdf <= d.u) AS times FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, times + 1))::INTEGER AS copy FROM t WHERE times > 0"""
