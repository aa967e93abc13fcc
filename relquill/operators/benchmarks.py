"""Benchmark construction: hard negatives, sampled pools, splits, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relquill.functions.text import hash_order, hash_text
from relquill.operators.lexical import bounded
from relquill.sources.tables import materialise


def mine_hard_negatives(overlaps: DataFrame, gold: DataFrame, groups: DataFrame, top: int = 8) -> DataFrame:
    """(qid, cand, overlap, rank): the candidates with the most tokens in common that share a positive's group and aren't positive."""
    in_group = materialise(gold.join(groups, "cand").select("qid", "grp").distinct(), "in_group")
    # small sides are broadcast: pairs of other groups go before any is sorted or shuffled
    pool = overlaps.join(groups, "cand").join(bounded(in_group), ["qid", "grp"]).join(bounded(gold), ["qid", "cand"], "left_anti")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "cand")
    return pool.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("qid", "cand", F.col("score").alias("overlap"), "rank")


def drawn(asked: DataFrame, members: DataFrame, excluded: DataFrame, size: int, seed: int) -> DataFrame:
    """(qid, cand, k): up to ``size`` candidates of each query's groups that aren't excluded, without a pair for each query and member.

    ``asked``: qid, grp; ``members``: grp, cand; ``excluded``: qid, cand. Null groups and candidates belong to no pool. The members lie in
    order of group, hash and id, so a query's groups make up n places. These are cut into m equal strata, m being ``size``, the query's
    excluded candidates, and memberships that a smaller group repeats (for queries of several groups); a hash of query and stratum picks a
    place in each. At most the last two can fail, so ``size`` are left wherever there are as many (all, if n is not above m); they are
    numbered in hash order. Rows grow with queries times m, whatever the size of the groups.
    """
    asked = asked.where("grp IS NOT NULL").select("qid", "grp").distinct()
    members = materialise(members.where("grp IS NOT NULL AND cand IS NOT NULL").select("grp", "cand").distinct(), "members")
    placed = materialise(numbered(members.withColumn("h", hash_order(seed, "grp", "cand")), F.col("grp"), "h", "cand", name="place").select("grp", "cand", "place"), "placed")
    smallest = members.groupBy("cand").agg(F.min("grp").alias("smallest"))
    sizes = placed.join(smallest, "cand").groupBy("grp").agg(F.count("*").alias("own"), F.min("place").alias("start"), F.count_if(F.col("grp") != F.col("smallest")).alias("again"))
    parts = materialise(asked.join(bounded(sizes), "grp"), "parts")
    total = parts.groupBy("qid").agg(F.sum("own").alias("n"), F.when(F.count("*") > 1, F.sum("again")).otherwise(0).alias("again"))
    out = excluded.select("qid", "cand").distinct()
    total = total.join(out.groupBy("qid").agg(F.count("*").alias("out")), "qid", "left").select("qid", "n", F.least("n", F.lit(size) + F.coalesce("out", F.lit(0)) + F.col("again")).alias("m"))
    earlier = Window.partitionBy("qid").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)  # a row for each group of a query
    parts = parts.drop("again").withColumn("at", F.coalesce(F.sum("own").over(earlier), F.lit(0))).join(total.where("m > 0"), "qid")
    strata = parts.withColumn("j", F.explode(F.expr("sequence(greatest(0, at * m div n - 1), least(m - 1, (at + own) * m div n))")))  # those that meet the group
    low, high = F.expr("j * n div m"), F.expr("(j + 1) * n div m")
    # as a generated column, the hash is computed once for a row; conditions on a plain one would each compute it again
    picked = strata.withColumn("pos", F.explode(F.array(low + F.pmod(hash_order(seed, "qid", "j"), high - low)))).where("pos >= at AND pos < at + own")
    found = picked.select("qid", (F.col("start") + F.col("pos") - F.col("at")).alias("place")).join(placed.select("place", "cand"), "place")
    # repeated and excluded candidates go, and the rest is numbered, after one shuffle, by query
    both = found.select("qid", "cand", F.lit(False).alias("out")).union(out.select("qid", "cand", F.lit(True))).repartition("qid")
    left = both.groupBy("qid", "cand").agg(F.bool_or("out").alias("out")).where("NOT out").select("qid", "cand")
    w = Window.partitionBy("qid").orderBy(hash_text(seed, "qid", "cand"), "cand")
    return left.withColumn("k", F.row_number().over(w)).where(F.col("k") <= size)


def sampled_pool(queries: DataFrame, cands: DataFrame, gold: DataFrame, size: int, seed: int) -> DataFrame:
    """(qid, cand, k): ``size`` candidates of the positives' groups for each of ``queries`` (qid), as ``drawn`` draws them."""
    own = gold.join(queries.select("qid").distinct(), "qid", "left_semi")
    return drawn(own.join(cands, "cand").select("qid", "grp"), cands, own, size, seed)


def cross_group_split(df: DataFrame, group: str, share: float = 0.6) -> DataFrame:
    """(group, split): the first groups in order train. Only the distinct groups are ordered."""
    names = df.select(F.col(group).alias("grp")).distinct()
    numbered = names.withColumn("k", F.row_number().over(Window.orderBy("grp"))).join(F.broadcast(names.agg(F.count("*").alias("n"))))
    return numbered.select("grp", F.when(F.col("k") <= F.floor(F.col("n") * share), "train").otherwise("test").alias("split"))


def temporal_split(df: DataFrame, time: str, key: str, share: float = 0.6) -> DataFrame:
    """Adds ``split``: the earliest rows train. The cut is found from counts by day, and only that day is ordered."""
    days = df.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("n"))
    run = days.withColumn("upto", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
    total = run.agg(F.floor(F.sum("n") * share).alias("cut"))
    run = run.join(F.broadcast(total)).select("day", (F.col("upto") <= F.col("cut")).alias("before"), F.greatest(F.col("cut") - F.col("upto") + F.col("n"), F.lit(0)).alias("room"))
    marked = df.withColumn("day", F.to_date(time)).join(run, "day", "left")
    split = marked.where("room > 0 AND NOT before").withColumn("k", F.row_number().over(Window.partitionBy("day").orderBy(time, key)))
    out = marked.where("before OR room <= 0").select(key, F.when(F.col("before"), "train").otherwise("test").alias("split"))
    return out.union(split.select(key, F.when(F.col("k") <= F.col("room"), "train").otherwise("test")))


def size_budget(groups: DataFrame, budget: float) -> DataFrame:
    """Groups (grp, value, bytes) kept while the running bytes, best value first, stay within the budget."""
    w = Window.orderBy(F.col("value").desc(), "grp").rowsBetween(Window.unboundedPreceding, 0)
    return groups.withColumn("running", F.sum("bytes").over(w)).where(F.col("running") <= budget)


def retrieval_pools(overlaps: DataFrame, gold: DataFrame, groups: DataFrame, hard: int = 8, random: int = 4, least: int = 5, seed: int = 1) -> DataFrame:
    """(qid, cand, kind): each query's positives, its ``hard`` candidates of largest overlap and ``random`` others as ``drawn`` draws them.

    The pool is the positives' groups without them; ties go to the smaller candidate, one without overlap counts as 0. Queries
    whose pool has fewer than ``least`` candidates are left out. No pool is built: candidates without overlap are looked up from
    the beginning of the groups of queries that lack others.
    """
    in_group = materialise(gold.join(groups, "cand").where("grp IS NOT NULL").select("qid", "grp").distinct(), "in_group")
    met = overlaps.join(groups, "cand").join(bounded(in_group), ["qid", "grp"]).select("qid", "cand", "score").distinct().join(bounded(gold), ["qid", "cand"], "left_anti")
    first = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "cand"))).where(F.col("k") <= hard).drop("k")
    met = materialise(first(met), "met")
    # queries with fewer: the first members of their groups, as many as can be positive, met or wanted
    lacking = in_group.join(met.groupBy("qid").agg(F.count("*").alias("n_met")), "qid", "left").where(F.coalesce("n_met", F.lit(0)) < hard)
    placed = materialise(numbered(groups.where("grp IS NOT NULL AND cand IS NOT NULL").select("grp", "cand").distinct(), F.col("grp"), "cand", name="place").select("grp", "cand", "place"), "placed")
    sizes = placed.groupBy("grp").agg(F.count("*").alias("own"), F.min("place").alias("start"))
    wanted = lacking.join(gold.groupBy("qid").agg(F.countDistinct("cand").alias("n_gold")), "qid").join(bounded(sizes), "grp")
    wanted = wanted.select("qid", F.explode(F.sequence("start", F.col("start") + F.least("own", F.col("n_gold") + hard) - 1)).alias("place"))
    filling = wanted.join(placed.select("place", "cand"), "place").select("qid", "cand").distinct()
    filling = filling.join(gold, ["qid", "cand"], "left_anti").join(met, ["qid", "cand"], "left_anti").withColumn("score", F.lit(0).cast(met.schema["score"].dataType))
    best = materialise(first(met.unionByName(filling)), "best").select("qid", "cand")
    rest = materialise(drawn(in_group, groups, gold.select("qid", "cand").union(best), max(random, least), seed), "rest")
    kept = best.select("qid").union(rest.select("qid")).groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("qid")
    out = gold.select("qid", "cand", F.lit("positive").alias("kind")).union(best.withColumn("kind", F.lit("hard"))).union(rest.where(F.col("k") <= random).select("qid", "cand", F.lit("random")))
    return out.join(kept, "qid", "left_semi")


#: Changes of a group that is drawn from inside one row, at most.
ROW_CHANGES = 1_000


def drawn_in_rows(own: DataFrame, size: int, seed: int) -> DataFrame:
    """(qid, own, cands): what ``drawn`` draws for each query of ``own`` (grp, qid, cand) of a single, small group, from and without its own targets.

    The members of a group lie in one row, and so do a query's strata: a change is shuffled once, by group, and what is drawn is not.
    """
    groups = own.groupBy("grp").agg(F.collect_list(F.struct("qid", "cand")).alias("x"))  # at most ROW_CHANGES
    order = lambda f, *parts: F.transform(f, lambda c: F.struct(hash_text(seed, *parts, c).alias("h"), c.alias("cand")))
    kept = lambda c: F.explode(F.array(c))  # noqa: E731  a generated column is computed once, a plain one wherever it is read
    members = F.transform(F.sort_array(order(F.array_distinct("x.cand"), "grp")), lambda x: x["cand"])
    of = F.transform(F.array_distinct("x.qid"), lambda q: F.struct(q.alias("qid"), F.transform(F.filter("x", lambda x: x["qid"] == q), lambda x: x["cand"]).alias("own")))
    rows = groups.withColumn("members", kept(members)).select("members", F.explode(of).alias("q")).select("members", "q.qid", "q.own")
    n = F.size("members").cast("long")
    rows = rows.withColumn("of", kept(F.struct(n.alias("n"), F.least(n, F.lit(size) + F.size("own")).alias("m"))))
    low = lambda j: F.floor(j * F.col("of.n") / F.col("of.m"))  # noqa: E731  exact for numbers of this size
    at = F.transform(F.sequence(F.lit(0).cast("long"), F.col("of.m") - 1), lambda j: low(j) + F.pmod(hash_order(seed, "qid", j), low(j + 1) - low(j)))
    left = F.array_except(F.transform(at, lambda k: F.get("members", k.cast("int"))), F.col("own"))
    return rows.select("qid", "own", kept(F.transform(F.slice(F.sort_array(order(left, "qid")), 1, size), lambda x: x["cand"])).alias("cands"))


def change_pools(changes: DataFrame, hard: int = 5, filler: int = 3, least: int = 1, seed: int = 2) -> DataFrame:
    """(qid, cand, kind): for each source (qid) of ``changes`` (grp, qid, cand) its own targets and others of its group as ``drawn`` draws them.

    The first ``hard`` of the others are hard negatives, the next ``filler`` fill up. Queries with fewer than ``least`` others are
    left out. Groups of up to ROW_CHANGES changes are drawn from in rows; larger ones, those with nulls, and queries of several groups as places.
    """
    own = materialise(changes.select("grp", "qid", "cand").distinct(), "changes")
    size = max(hard + filler, least)
    nulls = F.bool_or(F.col("grp").isNull() | F.col("qid").isNull() | F.col("cand").isNull())
    large = materialise(own.groupBy("grp").agg(F.count("*").alias("n"), nulls.alias("nulls")).where((F.col("n") > ROW_CHANGES) | F.col("nulls")).select(F.col("grp").alias("of")), "large")
    several = own.groupBy("qid").agg(F.min("grp").alias("least"), F.max("grp").alias("most"), F.bool_or(F.col("grp").isNull()).alias("nulls")).where("least <> most OR nulls").select("qid")
    several = materialise(several, "several")
    of_large = own.join(bounded(large), F.col("grp").eqNullSafe(F.col("of")), "left_semi").select("qid")
    rest = materialise(of_large.union(several).where("qid IS NOT NULL").distinct(), "rest")
    drawn_from = drawn_in_rows(own.join(bounded(large), F.col("grp") == F.col("of"), "left_anti").where("grp IS NOT NULL"), size, seed).join(bounded(rest), "qid", "left_anti")
    kind = lambda k: F.when(k < hard, "hard").otherwise("filler")
    others = F.transform(F.slice("cands", 1, hard + filler), lambda c, k: F.struct(c.alias("cand"), kind(k).alias("kind")))
    every = F.concat(F.transform("own", lambda c: F.struct(c.alias("cand"), F.lit("positive").alias("kind"))), others)
    out = drawn_from.where(F.size("cands") >= least).select("qid", F.explode(every).alias("x")).select("qid", "x.cand", "x.kind")
    if rest.isEmpty():
        return out
    asked = own.join(bounded(rest), "qid", "left_semi")
    ranked = materialise(drawn(asked, own, asked, size, seed), "ranked")
    kept = ranked.where(F.col("k") == least).select("qid")
    placed = asked.select("qid", "cand").distinct().select("qid", "cand", F.lit("positive").alias("kind")).union(ranked.where(F.col("k") <= hard + filler).select("qid", "cand", kind(F.col("k") - 1)))
    return out.union(placed.join(kept, "qid", "left_semi"))


def inherited_split(records: DataFrame, answers: DataFrame, queries: DataFrame, default: str = "train") -> DataFrame:
    """(id, split): a query record has its query's split, a record that answers one inherits it, others have ``default``.

    ``records``: id; ``answers``: id, qid; ``queries``: qid, record, split. An answer to several queries has the last split in order.
    """
    direct = queries.select(F.col("record").alias("id"), F.col("split").alias("own"))
    passed = answers.join(queries, "qid").groupBy("id").agg(F.max("split").alias("given"))
    return records.join(direct, "id", "left").join(passed, "id", "left").select("id", F.coalesce("own", "given", F.lit(default)).alias("split"))


def stamped(queries: DataFrame, as_of: str) -> DataFrame:
    """``queries`` with one late ``as_of``."""
    return queries.withColumn("as_of", F.lit(as_of))


def mined_negatives(overlaps: DataFrame, gold: DataFrame, groups: DataFrame, train: DataFrame) -> DataFrame:
    """(qid, cand, overlap): for each training query the training candidate of its group with the largest overlap that isn't relevant.

    ``train``: the groups (grp) of the training split. Ties go to the smaller candidate.
    """
    own = groups.join(train, "grp", "left_semi")
    return mine_hard_negatives(overlaps, gold.join(own, "cand", "left_semi"), own, 1).join(gold, ["qid", "cand"], "left_anti").select("qid", "cand", "overlap")


#: Rows of a range that is numbered by one task, about.
NUMBERED_ROWS = 1_000_000


def numbered(df: DataFrame, order: Column, *ties: str, name: str = "k", buckets: int | None = None) -> DataFrame:
    """``df`` with its row number (from 1) by ``order`` and ``ties``.

    Rows are dealt into ranges of about NUMBERED_ROWS by quantiles of order and ties, whatever values these have, counted by range, and
    numbered within their range only; no task orders all rows.
    """
    held = df.withColumn("_order", order)
    if buckets is None:
        buckets = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // NUMBERED_ROWS))
    held = materialise(held.repartitionByRange(buckets, "_order", *ties).withColumn("_bucket", F.spark_partition_id()), "numbered")
    counts = held.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))  # a row for each range
    own = held.join(F.broadcast(before.select("_bucket", "_before")), "_bucket")
    w = Window.partitionBy("_bucket").orderBy("_order", *ties)
    return own.withColumn(name, F.col("_before") + F.row_number().over(w)).drop("_order", "_bucket", "_before")


def batches(pairs: DataFrame, size: int, seed: int, *keys: str, group: str | None = None) -> DataFrame:
    """``pairs`` with a batch number: ``size`` at a time in hash order, over all or, with ``group``, within each group."""
    order = hash_order(seed, *keys)
    if group is None:
        return numbered(pairs, order, *keys).withColumn("batch", F.floor((F.col("k") - 1) / size)).drop("k")
    w = Window.partitionBy(group).orderBy(order, *keys)
    return pairs.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))
