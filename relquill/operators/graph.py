"""Graph operators over edges (source, target, time): adjacency, mean aggregation, as-of features, isolation, expansion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relquill.functions.text import truncated
from relquill.operators.dense import once, searched_dot, unit
from relquill.operators.lexical import bounded
from relquill.sources.tables import materialise


def adjacency(edges: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Symmetric, typed, distinct (a, b, role), without the excluded pairs in either direction."""
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "role").union(edges.select("target", "source", "role")).distinct()
    if excluded is None:
        return both
    out = excluded.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    return both.join(out, (F.least(both.a, both.b) == out.lo) & (F.greatest(both.a, both.b) == out.hi), "left_anti")


def near(edges: DataFrame, nodes: DataFrame, excluded: DataFrame | None = None, rising: bool = False, by: str | None = None) -> DataFrame:
    """(a, b, role): the rows of ``adjacency`` whose ``b`` is one of ``nodes`` (node). Edges of other nodes go before any is shuffled, if the nodes are few.

    ``rising``: those alone whose ``b`` is smaller than ``a``. ``by``: rows are dealt by this column, so that a join by it needs no other shuffle.
    """
    few = bounded(nodes.select("node"))
    there = edges.join(few, F.col("target") == F.col("node"), "left_semi").select(F.col("source").alias("a"), F.col("target").alias("b"), "role")
    back = edges.join(few, F.col("source") == F.col("node"), "left_semi").select(F.col("target").alias("a"), F.col("source").alias("b"), "role")
    both = there.union(back)
    both = both.where("b < a") if rising else both
    both = (both if by is None else both.repartition(by)).distinct()
    if excluded is None:
        return both
    out = excluded.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    return both.join(out, (F.least(both.a, both.b) == out.lo) & (F.greatest(both.a, both.b) == out.hi), "left_anti")


def mean_vector(size: int) -> Column:
    """The mean of each component of ``v``, of at most ``size``, as an aggregate; a missing component counts nowhere."""
    return F.slice(F.array(*(F.avg(F.get("v", F.lit(k))) for k in range(size))), F.lit(1), F.coalesce(F.max(F.size("v")), F.lit(0))).alias("v")


def neighbour_mean(adj: DataFrame, current: DataFrame, size: int) -> DataFrame:
    """(node, v): the mean over roles of the mean of each role's neighbours that have a vector."""
    role = adj.join(current.select(F.col("node").alias("b"), "v"), "b").groupBy("a", "role").agg(mean_vector(size))
    return role.groupBy(F.col("a").alias("node")).agg(mean_vector(size))


def longest(vectors: DataFrame) -> int:
    return vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]


#: Bytes of first vectors that are broadcast, at most; edges that one task adds up, about.
BASE_BYTES, TASK_EDGES = 256 << 20, 500_000


class Combinations:
    """Vectors as weighted sums of first vectors: (node, refs, ws), the rows of the first vectors and their weights.

    Means of vectors are again such sums, and a node far from most first vectors has few. So what meets the edges is a few numbers in place of a
    vector for each edge; whole vectors are added up last, in the task that has all of a node, from the broadcast first vectors.
    """

    def __init__(self, base: DataFrame, size: int, exact: bool):
        held = base.select("node", F.col("v").cast("array<float>" if exact else "array<double>").alias("v")).toArrow()
        spark, n = base.sparkSession, held.num_rows
        flat = held.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.size, self.n = size, n
        self.matrix = spark.sparkContext.broadcast(np.ascontiguousarray(flat.reshape(n, size).T))  # a row for each component
        import pyarrow as pa

        refs, ones = pa.array([[k] for k in range(n)], pa.list_(pa.int32())), pa.array([[1.0]] * n, pa.list_(pa.float64()))
        self.first = materialise(spark.createDataFrame(pa.table([held.column("node").combine_chunks(), refs, ones], names=["node", "refs", "ws"])).select("node", F.col("refs").cast("array<int>").alias("refs"), "ws"), "first")

    @staticmethod
    def of(base: DataFrame) -> Combinations | None:
        """None where means aren't plain sums (missing components, different lengths, repeated nodes) or the vectors are too large to broadcast."""
        exact = F.coalesce(F.bool_and(F.forall("v", lambda x: x.eqNullSafe(x.cast("float").cast("double")))), F.lit(False))
        own = base.agg(F.count("*").alias("n"), F.countDistinct("node").alias("nodes"), F.coalesce(F.min(F.size("v")), F.lit(0)).alias("least"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("most"), F.count_if(F.col("v").isNull() | F.exists("v", lambda x: x.isNull())).alias("broken"), exact.alias("exact")).first()
        plain = own["n"] == own["nodes"] and 0 < own["least"] == own["most"] and not own["broken"]
        return Combinations(base, own["most"], own["exact"]) if plain and own["n"] * own["most"] * (4 if own["exact"] else 8) <= BASE_BYTES else None

    def short(self, current: DataFrame) -> bool:
        """Whether the sums have no more terms than vectors have components, on average."""
        return current.agg(F.coalesce(F.avg(F.size("refs")), F.lit(0.0))).first()[0] <= self.size

    def _added(self, rows: DataFrame, n: int, alpha: float, whole: bool) -> DataFrame:
        """The ``rows`` (node, role, kind, refs, ws) of each node as one: the mean over roles of the means of neighbours (kind 0), mixed with ``alpha`` of
        its own vector (kind 1), or that alone, or else its last one (kind 2)."""
        matrix, size, base = self.matrix, self.size, self.n

        def run(batches):
            import pyarrow as pa

            held = [b for b in batches if b.num_rows]
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            coded = lambda name: table.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
            nodes, roles, kind = coded("node"), coded("role"), table.column("kind").to_numpy()
            names, a, r = nodes.dictionary, nodes.indices.to_numpy().astype(np.int64), roles.indices.to_numpy()
            near, n_roles = kind == 0, len(roles.dictionary)
            groups, own = np.unique(a[near] * n_roles + r[near], return_inverse=True)
            count, by = np.bincount(own, minlength=len(groups)), np.bincount(groups // n_roles, minlength=len(names))
            mean, based = by > 0, np.bincount(a[kind == 1], minlength=len(names)) > 0
            factor = np.empty(len(a))
            factor[near] = np.where(based[a[near]], 1 - alpha, 1.0) / (count[own] * by[a[near]])
            factor[kind == 1] = np.where(mean[a[kind == 1]], alpha, 1.0)
            factor[kind == 2] = np.where((mean | based)[a[kind == 2]], 0.0, 1.0)
            refs, ws = (table.column(c).combine_chunks() for c in ("refs", "ws"))
            terms = refs.value_lengths().to_numpy()
            key, weight = np.repeat(a, terms) * base + refs.flatten().to_numpy(), ws.flatten().to_numpy() * np.repeat(factor, terms)
            kept = np.repeat((factor > 0) | (kind != 2), terms)
            key, at = np.unique(key[kept], return_inverse=True)
            weight = np.bincount(at, weight[kept], len(key))
            a, ref = key // base, (key % base).astype(np.int32)
            ends = np.searchsorted(a, np.arange(len(names) + 1))
            low = 0
            while low < len(names):
                high = max(low + 1, min(low + 10_000, int(np.searchsorted(ends, ends[low] + 500_000, "right")) - 1))
                cut, at = slice(ends[low], ends[high]), a[ends[low] : ends[high]] - low
                offsets = lambda x: pa.array((x - x[0]).astype(np.int32))
                if whole:
                    v = np.empty((high - low, size))
                    for k in range(size):
                        v[:, k] = np.bincount(at, weight[cut] * matrix.value[k][ref[cut]], high - low)
                    out = [pa.ListArray.from_arrays(offsets(np.arange(high - low + 1) * size), v.ravel())]
                else:
                    out = [pa.ListArray.from_arrays(offsets(ends[low : high + 1]), x[cut]) for x in (ref, weight)]
                yield pa.RecordBatch.from_arrays([names.slice(low, high - low), *out], ["node", "v"] if whole else ["node", "refs", "ws"])
                low = high

        kind = rows.schema["node"].dataType.simpleString()
        return rows.repartition(n, "node").mapInArrow(run, f"node {kind}, " + ("v array<double>" if whole else "refs array<int>, ws array<double>"))

    def parts(self, edges: DataFrame) -> int:
        return max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // TASK_EDGES))

    def _met(self, adj: DataFrame, current: DataFrame) -> DataFrame:
        return adj.join(current.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "role", F.lit(0).alias("kind"), "refs", "ws")

    def mean(self, adj: DataFrame, current: DataFrame) -> DataFrame:
        """``neighbour_mean`` of such sums."""
        return self._added(self._met(adj, current), self.parts(adj), 0.0, False)

    def hop(self, edges: DataFrame, current: DataFrame, alpha: float, excluded: DataFrame | None) -> DataFrame:
        """The function ``hop`` on such sums, as whole vectors."""
        one = lambda df, kind: df.select("node", F.lit(None).cast(edges.schema["role"].dataType).alias("role"), F.lit(kind).alias("kind"), "refs", "ws")
        rows = self._met(near(edges, current, excluded, by="b"), current).union(one(self.first, 1)).union(one(current, 2))
        return self._added(rows, 2 * self.parts(edges), alpha, True)

    def whole(self, current: DataFrame) -> DataFrame:
        """(node, v)."""
        matrix, size = self.matrix, self.size

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for low in range(0, batch.num_rows, 10_000):
                    part = batch.slice(low, 10_000)
                    refs, ws = (part.column(c).flatten().to_numpy() for c in (1, 2))
                    at, v = np.repeat(np.arange(part.num_rows), part.column(1).value_lengths().to_numpy()), np.empty((part.num_rows, size))
                    for k in range(size):
                        v[:, k] = np.bincount(at, ws * matrix.value[k][refs], part.num_rows)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * size), v.ravel())], ["node", "v"])

        return current.select("node", "refs", "ws").mapInArrow(run, f"node {current.schema['node'].dataType.simpleString()}, v array<double>")


def _seeded(edges: DataFrame, base: DataFrame, excluded: DataFrame | None = None) -> tuple[DataFrame, Combinations | None]:
    """``seeded``, as sums of first vectors where these are known."""
    sums = Combinations.of(base)
    size, own = longest(base), base.select("node").distinct().withColumn("own", F.lit(True))
    held = new = own
    feeds = None  # (a, b, role): b has a vector before a
    while not new.isEmpty():
        found = near(edges, new, excluded, rising=feeds is not None).join(bounded(own.select(F.col("node").alias("a"))), "a", "left_anti").join(bounded(new.withColumnRenamed("node", "b")), "b").where("own OR b < a")
        found = materialise(found.select("a", "b", "role", "own"), "feeds")
        feeds = found if feeds is None else feeds.union(found)
        new = materialise(found.select(F.col("a").alias("node")).distinct().join(bounded(held.select("node")), "node", "left_anti").withColumn("own", F.lit(False)), "new")
        held = held.union(new)
    current = base if sums is None else sums.first
    if feeds is None:
        return current, sums
    open_ = materialise(held.where("NOT own").select("node"), "open")
    while not open_.isEmpty():
        waits = feeds.where("NOT own").join(open_.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node")).distinct()
        ready = materialise(open_.join(waits, "node", "left_anti"), "ready")
        adj = feeds.join(ready.select(F.col("node").alias("a")), "a", "left_semi")
        mean = neighbour_mean(adj, current, size) if sums is None else sums.mean(adj, current)
        current = current.union(materialise(mean, "settled"))
        open_ = materialise(open_.join(ready, "node", "left_anti"), "open")
        if sums is not None and not sums.short(current):
            current, sums = materialise(sums.whole(current), "whole"), None
    return current, sums


def seeded(edges: DataFrame, base: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(node, v): ``base`` and a first vector of each other node, the mean of its neighbours that have one before it.

    Nodes without a vector of their own are taken in the order of their ids, so a neighbour with a smaller id counts once it
    has a vector. First the nodes that a vector reaches are found by ids alone, and the edges among them, which are all that matter. Of these,
    nodes whose smaller neighbours are settled go in one round; a round that settles nothing new ends it.
    """
    current, sums = _seeded(edges, materialise(base.select("node", "v"), "base"), excluded)
    return current if sums is None else sums.whole(current)


def hop(edges: DataFrame, current: DataFrame, base: DataFrame, alpha: float, excluded: DataFrame | None = None) -> DataFrame:
    """One round of typed mean aggregation over vectors (node, v), mixed with ``base``; a node without neighbours keeps its vector."""
    mean = neighbour_mean(near(edges, current, excluded), current, longest(current))
    joined = mean.withColumnRenamed("v", "m").join(base.select("node", F.col("v").alias("own")), "node", "full").join(current.select("node", "v"), "node", "full")
    mixed = F.zip_with("m", "own", lambda m, o: F.when(m.isNull(), o).when(o.isNull(), m).otherwise(alpha * o + (1 - alpha) * m))
    return joined.select("node", F.coalesce(mixed, "m", "own", "v").alias("v"))


def augmented_vectors(edges: DataFrame, base: DataFrame, alpha: float = 0.5, hops: int = 1, excluded: DataFrame | None = None) -> DataFrame:
    """Unit vectors (node, v) of all nodes that get one after ``hops`` rounds. ``edges``: source, target, role; ``base``: node, v.

    The last round isn't written.
    """
    base = materialise(base.select("node", "v"), "base")
    now, sums = _seeded(edges, base, excluded)
    for k in range(hops):
        now, sums = hop(edges, now, base, alpha, excluded) if sums is None else sums.hop(edges, now, alpha, excluded), None
        now = materialise(now, "hop") if k < hops - 1 else now
    now = now if sums is None else sums.whole(now)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.coalesce(x * x, F.lit(0.0))))
    return now.select("node", once(norm, lambda n: F.transform("v", lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)))).alias("v"))


def whole(vectors: DataFrame, *keys: str) -> DataFrame:
    """(keys, v) of long vectors (keys, dim, x); dimensions count from 0, one that a key lacks is null."""
    filled = lambda m: F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys(m)).cast("int")), lambda k: F.try_element_at(m, k))
    held = vectors.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("dim").cast("int").alias("dim"), "x"))).alias("m"))  # the components of one vector
    return held.select(*keys, filled(F.col("m")).alias("v"))


def augmented(edges: DataFrame, base: DataFrame, alpha: float = 0.5, hops: int = 1, excluded: DataFrame | None = None) -> DataFrame:
    """``augmented_vectors`` over long vectors (node, dim, x)."""
    return augmented_vectors(edges, whole(base, "node"), alpha, hops, excluded).select("node", F.posexplode("v").alias("dim", "x"))


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """Long vectors of both; where both have a node, the right one's."""
    return right.unionByName(left.join(right.select("node").distinct(), "node", "left_anti"))


def views(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(node, neighbours): the sorted distinct targets of each source."""
    return edges.groupBy(F.col(source).alias("node")).agg(F.array_sort(F.collect_set(target)).alias("neighbours"))


def density(commits: DataFrame, gold: DataFrame) -> DataFrame:
    """One row on gold pairs: pairs, pairs isolated without the gold dates, pairs with fewer than two commits, queries all of whose
    pairs are isolated, upper median and largest number of commits.

    ``commits``: target, date (one row each); ``gold``: qid, target, date (of the query's own change).
    """
    n = commits.groupBy("target").agg(F.count("*").alias("n"))
    dates = gold.select("target", "date").distinct()
    other = commits.join(dates, ["target", "date"], "left_anti").groupBy("target").agg(F.count("*").alias("other"))
    pairs = gold.select("qid", "target").distinct().join(n, "target", "left").join(other, "target", "left").na.fill(0, ["n", "other"])
    counts = pairs.groupBy("n").agg(F.count("*").alias("pairs"))
    run = counts.withColumn("upto", F.sum("pairs").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))  # a row for each number of commits
    total = counts.agg(F.sum("pairs").alias("total"), F.max("n").alias("largest"))
    median = run.join(F.broadcast(total)).where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("n").alias("median_commits"), F.max("largest").alias("most_commits"))
    by_query = pairs.groupBy("qid").agg(F.bool_and(F.col("other") < 1).alias("alone")).agg(F.count("*").alias("queries"), F.count_if("alone").alias("queries_isolated"))
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("other") < 1).alias("isolated"), F.count_if(F.col("n") < 2).alias("single")).join(by_query).join(median)


def of_nodes(rows: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """The ``rows`` whose ``name`` some row of ``nodes`` has. Others go before any is shuffled, if the distinct nodes are few."""
    return rows.join(bounded(nodes.select(name).distinct()), name, "left_semi")


def subgraph(ranked: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """(qid, rank, cand, score, files, tests): the ranked candidates with the first ``most`` of their changed files and tests.

    ``edges``: cand, path, is_test. Paths are distinct and sorted. ``ranked`` is read three times.
    """
    paths = lambda test: F.slice(F.array_sort(F.collect_set(F.when(F.col("is_test") == test, F.col("path")))), 1, most)
    own = of_nodes(edges, ranked, "cand").groupBy("cand").agg(paths(False).alias("files"), paths(True).alias("tests"))
    none = F.array().cast("array<string>")
    return ranked.join(own, "cand", "left").select("qid", "rank", "cand", "score", F.coalesce("files", none).alias("files"), F.coalesce("tests", none).alias("tests"))


def packed(found: DataFrame, issues: DataFrame, body_characters: int = 600) -> DataFrame:
    """(qid, prompt): a bounded plain-text context for each of ``issues`` (qid, title, body) from its ranked changes (with ``title``)."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("(none recorded)")
    titled = lambda c, n: F.coalesce(F.nullif(truncated(c, n), F.lit("")), F.lit("(no title)"))
    block = F.concat_ws(
        "\n", F.concat(F.lit("## PR #"), "rank", F.lit("  (relevance="), F.format_string("%.3f", "score"), F.lit(")")), F.concat(F.lit("summary: "), titled("title", 120)),
        F.concat(F.lit("changed files: "), listed("files")), F.concat(F.lit("changed tests: "), listed("tests")), F.lit(""),
    )
    by = found.groupBy("qid").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("bs"))  # the top ranks of one query
    joined = issues.join(by, "qid", "left")
    body = truncated("body", body_characters)
    lines = F.array(F.lit("# ISSUE"), F.concat(F.lit("title: "), titled("title", 200)), F.when(body != "", F.concat(F.lit("description: "), body)), F.lit(""), F.concat(F.lit("# RELATED PULL REQUESTS (top "), F.coalesce("n", F.lit(0)), F.lit(" by relevance)")), F.when(F.col("n").isNull(), "(none retrieved)"))
    text = F.array_join(F.concat(F.array_compact(lines), F.transform(F.coalesce("bs", F.array().cast("array<struct<rank:int,block:string>>")), lambda x: x["block"])), "\n")
    return joined.select("qid", F.concat(F.regexp_replace(text, r"\s+\z", ""), F.lit("\n")).alias("prompt"))


def fair_rank(pools: DataFrame) -> DataFrame:
    """One row on pools (qid, cand, relevant, score, null where not covered): coverage of relevant and of other candidates, R@1
    among queries with a covered relevant candidate, ranked over the covered ones, and what a random order would reach.
    """
    covered = pools.where("score IS NOT NULL")
    best = covered.groupBy("qid").agg(F.min_by("relevant", F.struct((-F.round("score", 9)).alias("s"), "cand")).alias("first"), F.bool_or("relevant").alias("any"), F.count("*").alias("n"), F.count_if("relevant").alias("r"))
    best = best.where("any").agg(F.count("*").alias("n_queries"), F.avg(F.col("first").cast("int")).alias("r1_covered"), F.avg(F.col("r") / F.col("n")).alias("r1_random"))
    share = lambda c: F.avg(F.when(c, F.col("score").isNotNull().cast("int")))
    return pools.agg(share(F.col("relevant")).alias("coverage_relevant"), share(~F.col("relevant")).alias("coverage_other")).join(best)


def there_and_back(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(node, v): each source's mean over its targets of their mean over sources that have one of ``vectors`` (node, v).

    Edges without a vector at their end go before any is shuffled, if the vectors are few.
    """
    size, e = longest(vectors), edges.select("source", "target")
    there = e.join(bounded(vectors.select(F.col("node").alias("source"))), "source", "left_semi").distinct().join(vectors.withColumnRenamed("node", "source"), "source").groupBy("target").agg(mean_vector(size))
    there = materialise(there, "there")
    return e.join(bounded(there.select("target")), "target", "left_semi").distinct().join(there, "target").groupBy(F.col("source").alias("node")).agg(mean_vector(size))


def mixed_with(own: str, mean: str, alpha) -> Column:
    """``alpha`` of ``own`` and the rest of ``mean``; of the components of ``mean``, those that ``own`` lacks are as they are."""
    both = F.zip_with(mean, own, lambda m, o: F.when(o.isNull(), m).otherwise(alpha * o + (1 - alpha) * m))
    return F.slice(both, F.lit(1), F.size(mean))


def grid_vectors(edges: DataFrame, base: DataFrame, alphas: list[float], hops: int) -> DataFrame:
    """(alpha, hops, node, v): vectors of the sources after 1 to ``hops`` rounds over their targets and back, for each weight.

    A round averages a target's sources and then a source's targets, and mixes ``alpha`` of the base vector in. A node
    without edges keeps its base vector. ``base``: (node, v).
    """
    base = materialise(base.select("node", "v"), "base")
    own = materialise(edges.select("source", "target").join(bounded(base.select(F.col("node").alias("source")).distinct()), "source", "left_semi").distinct(), "own")
    # a mean of mixed vectors is the mix of their means, so each round is computed once, whatever the weights: b, its mean m1, the mean m2 of that, ...
    known = lambda m: F.slice(F.zip_with("v", m, lambda x, y: F.when(x.isNotNull(), y)), F.lit(1), F.size("v"))
    now, rounds = base, base
    for k in range(1, hops + 1):
        back = there_and_back(own, now).withColumnRenamed("v", f"m{k}")
        rounds = materialise(rounds.join(back, "node", "left").withColumn(f"m{k}", known(F.col(f"m{k}"))), "round")
        now = rounds.where(f"m{k} IS NOT NULL").select("node", F.col(f"m{k}").alias("v"))

    def mixed(alpha: float, k: int) -> Column:
        total = F.transform("v", lambda x: alpha * x)
        for j in range(1, k + 1):
            part = (1 - alpha) ** j * (1 if j == k else alpha)
            total = F.zip_with(total, f"m{j}", lambda t, m: t + part * m)  # noqa: B023
        return F.coalesce(total, "v")

    every = F.array(*(F.struct(F.lit(alpha).alias("alpha"), F.lit(k).alias("hops"), mixed(alpha, k).alias("v")) for alpha in map(float, alphas) for k in range(1, hops + 1)))
    return rounds.select("node", F.explode(every).alias("x")).select("x.alpha", "x.hops", "node", "x.v")


def grid(edges: DataFrame, base: DataFrame, alphas: list[float], hops: int) -> DataFrame:
    """(alpha, hops, node, dim, x): ``grid_vectors`` over long vectors (node, dim, x)."""
    return grid_vectors(edges, whole(base, "node"), alphas, hops).select("alpha", "hops", "node", F.posexplode("v").alias("dim", "x"))


def nearest_vectors(vectors: DataFrame, is_query: str, keys: list[str]) -> DataFrame:
    """(keys, qid, cand): the other node with the largest cosine for each node that ``is_query`` admits, smallest id on ties, by products
    in tiles. ``vectors``: (keys, node, v)."""
    v = vectors.select(*keys, "node", unit(F.col("v")).alias("v"))
    q = v.where(is_query).select(*keys, F.col("node").alias("qid"), F.col("v").alias("qv"))
    return searched_dot(q, v.withColumnRenamed("node", "cand"), 1, tuple(keys)).select(*keys, "qid", "cand")


def nearest(vectors: DataFrame, is_query: str, keys: list[str]) -> DataFrame:
    """``nearest_vectors`` over long vectors (keys, node, dim, x)."""
    return nearest_vectors(whole(vectors, *keys, "node"), is_query, keys)


def _added(a: str, b: str, sign: int = 1) -> F.Column:
    """Sum of two vectors, where a null counts as zeros."""
    both = F.zip_with(a, b, lambda x, y: x + sign * y)
    return F.coalesce(both, F.col(a), F.transform(b, lambda y: sign * y))


def _running(df: DataFrame, w, size: int) -> DataFrame:
    """``df`` with ``run``, the vector sums of ``v`` and of ``n`` up to each row of the window."""
    sums = F.array(*(F.sum(F.get("v", F.lit(k))).over(w) for k in range(size)))
    return df.withColumn("run", F.struct(sums.alias("v"), F.sum("n").over(w).alias("n")))


def as_of_mean(queries: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qid, target, v, support): mean vector of the sources that each query's target had by its time, the query's own left out.

    ``queries``: qid, target, time; ``edges``: source, target, time, of which a source's first counts; ``vectors``: node, v, all of one
    length. Running sums in two levels: over the days of a target, and over the edges of a day; each query looks up the
    last sums before it and takes its own vector off. So rows grow with edges plus queries, and a target with many edges is
    ordered by day only. Queries without an earlier source have no row.
    """
    size = vectors.select(F.size("v")).first()
    if size is None:
        return queries.select("qid", "target", F.array().cast("array<double>").alias("v"), F.lit(0).cast("long").alias("support")).where("false")
    first = edges.groupBy("source", "target").agg(F.min("time").alias("time")).where("time IS NOT NULL")
    held = first.join(vectors.withColumnRenamed("node", "source"), "source").withColumn("day", F.to_date("time")).withColumn("n", F.lit(1).cast("long"))
    began = first.join(vectors.select(F.col("node").alias("source")), "source", "left_semi").groupBy("target").agg(F.min("time").alias("began"))
    asked = queries.select("qid", "target", "time").distinct().join(began, "target").where("time >= began").drop("began").withColumn("day", F.to_date("time"))
    before = Window.unboundedPreceding
    # whole days: running sums over the days of a target, looked up by the days of queries
    days = held.groupBy("target", "day").agg(F.array(*(F.sum(F.get("v", F.lit(k))) for k in range(size[0]))).alias("v"), F.sum("n").alias("n"))
    days = _running(days, Window.partitionBy("target").orderBy("day").rowsBetween(before, 0), size[0]).select("target", "day", "run")
    both = days.unionByName(asked.select("target", "day").distinct().withColumn("run", F.lit(None).cast(days.schema["run"].dataType)))
    upto = both.withColumn("past", F.last("run", ignorenulls=True).over(Window.partitionBy("target").orderBy("day", F.col("run").isNotNull()).rowsBetween(before, -1)))
    upto = upto.where("run IS NULL").select("target", "day", "past")
    # the day of a query: running sums over its edges, those at the query's own time included
    inside = _running(held, Window.partitionBy("target", "day").orderBy("time", "source").rowsBetween(before, 0), size[0]).select("target", "day", "time", F.lit(None).cast(queries.schema["qid"].dataType).alias("qid"), F.lit(0).alias("asks"), "run")
    both = inside.unionByName(asked.select("target", "day", "time", "qid", F.lit(1).alias("asks"), F.lit(None).cast(inside.schema["run"].dataType).alias("run")))
    today = both.withColumn("now", F.last("run", ignorenulls=True).over(Window.partitionBy("target", "day").orderBy("time", "asks").rowsBetween(before, 0))).where("asks = 1")
    own = held.select(F.col("source").alias("qid"), "target", F.col("time").alias("since"), F.col("v").alias("own"))
    found = today.select("qid", "target", "day", "time", "now").join(upto, ["target", "day"], "left").join(own, ["qid", "target"], "left")
    found = found.select("qid", "target", F.col("past.v").alias("a"), F.col("now.v").alias("b"), F.when(F.col("since") <= F.col("time"), F.col("own")).alias("own"), (F.coalesce("past.n", F.lit(0)) + F.coalesce("now.n", F.lit(0))).alias("n"))
    total = found.select("qid", "target", _added("a", "b").alias("v"), "own", (F.col("n") - F.col("own").isNotNull().cast("long")).alias("support")).where("support > 0")
    return total.select("qid", "target", _added("v", "own", -1).alias("v"), "support").select("qid", "target", F.transform("v", lambda x: x / F.col("support")).alias("v"), "support")


def isolation(edges: DataFrame) -> DataFrame:
    """(target, n_sources, isolated): targets with one source only can't be reached by co-change."""
    return edges.groupBy("target").agg(F.countDistinct("source").alias("n_sources")).withColumn("isolated", F.col("n_sources") == 1)


def expand(seeds: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """(seed, n_targets, path): the first ``most`` targets of each seed in order, joined by commas."""
    w = Window.partitionBy("source").orderBy("target")
    own = edges.select("source", "target").distinct().join(seeds.select(F.col("seed").alias("source")), "source", "left_semi")
    numbered = own.withColumn("k", F.row_number().over(w))
    found = numbered.groupBy(F.col("source").alias("seed")).agg(F.count("*").alias("n_targets"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("k", "target")))), lambda x: x["target"].cast("string")), ",").alias("path"))
    return seeds.join(found, "seed", "left").select("seed", F.coalesce("n_targets", F.lit(0)).alias("n_targets"), F.coalesce("path", F.lit("")).alias("path"))
