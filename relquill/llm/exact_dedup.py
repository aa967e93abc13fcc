"""Exact deduplication by progressive refinement, with DataFrame operations only.

Rows are grouped by normalised length; only those that share one have their first characters hashed, and only what then still
shares a group is hashed in full. Each level is a count, aggregated before it is shuffled, and the groups that survive are joined to
the rows; a group of copies of any size makes no large task, as keys with many rows are broadcast.

Null counts as the empty text, and all empty texts are equal. Of equal texts, the row with the most code points in its
original text stays, then the one with the smallest id (a null id last). Of repeated rows with the same id, one stays. Texts of any
length count whole. An empty table gives an empty result; columns of ``keep`` pass unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, uneven_join

#: Characters of the normalised text that the second level hashes.
PREFIX = 64
#: A level's groups are broadcast up to so many (of two longs at most: 32 MB), which is counted first; beyond, rows are shuffled to them.
BROADCAST_GROUPS = 1_000_000
#: Tasks that the rows of one group are dealt over in that shuffle.
SALTS = 16
SPACES = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def marked(rows: DataFrame, groups: DataFrame, on: list[str], flag: str) -> DataFrame:
    """``rows`` with ``flag`` true where ``groups`` has their keys ``on``; ``rows`` has a number ``row`` for each row."""
    if groups.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups.withColumn(flag, F.lit(True))), on, "left")
    salted = groups.select(*on, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias(flag))
    return rows.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"], "left").drop("salt")


def refined(rows: DataFrame) -> DataFrame:
    """``rows`` (row, body, ...) with size; head, null where no other row has the size; sha, null where none has size and head."""
    rows = rows.withColumn("size", F.octet_length("body").cast("long"))
    sizes = materialise(rows.groupBy("size").count().where("count > 1").select("size"), "sizes")
    alike = marked(rows, sizes, ["size"], "alike").withColumn("head", F.when(F.col("alike"), F.xxhash64(F.substring("body", 1, PREFIX)))).drop("alike")
    groups = materialise(alike.where("head IS NOT NULL").groupBy("size", "head").count().where("count > 1").select("size", "head"), "groups")
    return marked(alike, groups, ["size", "head"], "again").withColumn("sha", F.when(F.col("again"), F.sha2(F.col("body").cast("binary"), 256))).drop("again")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, columns of ``keep``): one row for each row of ``df``.

    text_sha256 is null for a text that the first two levels show to be unique.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None).cast("int")
    body = df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.char_length(text).alias("points"), normalised(F.col(text_col)).alias("body"), held.alias("held"))
    rows = materialise(refined(body).select("id", "row", "points", "size", "sha", "held"), "hashed")
    order = F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("null"), F.col("id").alias("id"), F.col("row").alias("row"))
    again = rows.where("sha IS NOT NULL")
    best = again.groupBy("size", "sha").agg(F.count("*").alias("n"), F.min(order).alias("best"))
    best = best.select("size", "sha", "n", F.col("best.id").alias("keep"), F.col("best.row").alias("keep_row"))
    alike = uneven_join(again, best, ["size", "sha"]).select("id", "keep", "n", (F.col("row") == F.col("keep_row")).alias("kept"), "sha", "held")
    single = rows.where("sha IS NULL").select("id", F.col("id").alias("keep"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("kept"), "sha", "held")
    names = (F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))
    return alike.union(single).select(*names, *(F.col("held")[c].alias(c) for c in keep))


def exact_sql() -> str:
    """The same result over ``documents`` with unique ids, in DuckDB SQL."""
    return """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS body FROM documents),
w AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, body FROM d)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM w"""


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of equal texts, all columns."""
    whole = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("held"))
    return exact_duplicates(whole, "id", "text", ("held",)).where("kept").select("held.*")
