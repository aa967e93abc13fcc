"""Queries on vectors and graphs, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from relquill.operators import dense, graph
from relquill.plans.catalogue import DIGEST, digest, query, vector_digest
from relquill.sources.tables import long_vectors, materialise, table

# -- vectors ------------------------------------------------------------------------------------------------------------------


def vectors(s, d, key: str):
    return table(s, d, "embeddings").select(F.col("vec_id").alias(key), F.col("embedding").cast("array<double>").alias("v"))


@query("""SELECT c_custkey AS node, len(coalesce(v, z)) AS n_dims, round(list_sum(coalesce(v, z)), 6) AS total, v IS NULL AS filled FROM customer LEFT JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) ON vec_id = c_custkey, (SELECT list_transform(range(0, 64), lambda i: 0.0::DOUBLE) AS z)""")
def zero_fallback(s, d):
    """Customers with the vector of their number, or zeros."""
    out = dense.zero_filled(table(s, d, "customer").select(F.col("c_custkey").alias("node")), vectors(s, d, "node").withColumn("has", F.lit(True)), 64)
    return out.select("node", F.size("v").cast("long").alias("n_dims"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.col("has").isNull().alias("filled"))


MATRIX = [[((i * 7 + j * 13) % 11 - 5) / 10 for j in range(64)] for i in range(16)]
PROJECTED = "list_transform(range(0, 16), lambda i: list_dot_product(list_transform(range(0, 64), lambda j: ((i * 7 + j * 13) % 11 - 5) / 10.0::DOUBLE), embedding::DOUBLE[]))"


@query(f"""WITH p AS (SELECT vec_id, {PROJECTED} AS v FROM embeddings), r AS (SELECT a.vec_id AS qid, b.vec_id AS cand, list_cosine_similarity(a.v, b.v) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.vec_id) AS rank
FROM p a JOIN p b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) SELECT qid, cand, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def projected_rank(s, d):
    """Nearest vectors after a projection, every hundredth vector as a stated query set."""
    p = vectors(s, d, "cand").select("cand", dense.projected(F.col("v"), MATRIX).alias("v"))
    q = p.where("cand % 100 = 0").select(F.col("cand").alias("qid"), F.col("v").alias("qv"))
    out = dense.searched_dot(q, p, 5)
    return out.select("qid", "cand", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _chunks(size: str) -> str:
    return f"""c AS (SELECT vec_id // {size} AS cand, vec_id % {size} AS ix, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT qid, cand, ix, list_dot_product(q, v) AS p FROM q, c WHERE cand <> qid // {size}),
m AS (SELECT cand, list(x ORDER BY dim) AS m FROM (SELECT cand, dim, avg(x) AS x FROM (SELECT cand, unnest(range(0, len(v))) AS dim, unnest(v) AS x FROM c) GROUP BY ALL) GROUP BY cand),
a AS (SELECT qid, cand, max(p) AS maxp, max(p) FILTER (ix = 0) AS firstp, sum(p) AS sump, avg(p) AS meanp, any_value(list_dot_product(q, m) / sqrt(list_dot_product(m, m))) AS whole_doc_mean FROM s JOIN q USING (qid) JOIN m USING (cand) GROUP BY ALL)"""


AGGREGATORS = dense.AGGREGATORS


def chunked(s, d, size: int, top: int, by: tuple[str, ...]):
    """(qid, by, cand, aggregators, rank): vectors as chunks of documents of ``size`` each, every hundredth vector as a stated query set."""
    c = vectors(s, d, "id").select(F.floor(F.col("id") / size).alias("cand"), (F.col("id") % size).alias("chunk_ix"), "v")
    q = vectors(s, d, "qid").where("qid % 100 = 0").select("qid", F.col("v").alias("q"), F.floor(F.col("qid") / size).alias("own"))
    return dense.chunks_searched(q, c, top, by)


@query(f"WITH {_chunks('5')}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(maxp, 9) DESC, cand) AS rank FROM a) SELECT qid, cand, {', '.join(f'round({x}, 6) AS {x}' for x in AGGREGATORS)}, rank FROM r WHERE rank <= 10")
def chunk_aggregators(s, d):
    """Documents of five chunk vectors ranked by their best chunk, with all aggregators."""
    return chunked(s, d, 5, 10, ("maxp",)).select("qid", "cand", *(F.round(x, 6).alias(x) for x in AGGREGATORS), F.col("rank").cast("long").alias("rank"))


def _grid(size: int) -> str:
    by = " UNION ALL ".join(f"SELECT qid, '{x}' AS aggregator, cand, row_number() OVER (PARTITION BY qid ORDER BY round({x}, 9) DESC, cand) AS k FROM a" for x in AGGREGATORS)
    return f"(WITH {_chunks(str(size))}, b AS ({by}) SELECT {size} AS size, aggregator, count(*) AS n, avg((x.label = y.label)::INTEGER) AS r1 FROM b JOIN embeddings x ON x.vec_id = qid JOIN embeddings y ON y.vec_id = cand * {size} WHERE k = 1 GROUP BY ALL)"


@query(f"SELECT size, aggregator, n, round(r1, 6) AS r1, aggregator = first_value(aggregator) OVER (PARTITION BY size ORDER BY round(r1, 9) DESC, aggregator) AS best FROM ({' UNION ALL '.join(map(_grid, (2, 5, 10)))})")
def chunk_ablation(s, d):
    """Chunks per document by aggregator: share of queries whose best other document begins with their label."""
    label = table(s, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("label").alias("ql"))
    out = None
    for size in (2, 5, 10):
        best = chunked(s, d, size, 1, AGGREGATORS).select("qid", F.col("by").alias("aggregator"), "cand")
        first = label.select((F.col("qid") / size).cast("long").alias("cand"), F.col("ql").alias("cl"), "qid").where(F.col("qid") % size == 0).drop("qid")
        part = best.join(label, "qid").join(first, "cand").groupBy("aggregator").agg(F.count("*").alias("n"), F.avg((F.col("ql") == F.col("cl")).cast("int")).alias("r1")).withColumn("size", F.lit(size))
        out = part if out is None else out.union(part)
    best = F.first("aggregator").over(Window.partitionBy("size").orderBy(F.round("r1", 9).desc(), "aggregator"))
    return out.select("size", "aggregator", "n", F.round("r1", 6).alias("r1"), (F.col("aggregator") == best).alias("best"))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
p AS (SELECT a.label = b.label AS same, avg(list_dot_product(a.v, b.v)) AS m FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY ALL)
SELECT round(max(m) FILTER (same), 6) AS related, round(max(m) FILTER (NOT same), 6) AS unrelated, max(m) FILTER (same) > max(m) FILTER (NOT same) + 0.05 AS usable FROM p""")
def embedding_sanity(s, d):
    """Whether vectors of one label are closer than others."""
    out = dense.sanity(table(s, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v")), "label")
    return out.select(F.round("related", 6).alias("related"), F.round("unrelated", 6).alias("unrelated"), "usable")


@query()
def hashed_embeddings(s, d):
    """Texts through the encoder hook with its default (crc32 buckets, which the SQL at hand has not)."""
    return dense.embedded(table(s, d, "documents"), "doc_id", "text", dense.hashed_encoder()).select(F.col("id").alias("doc_id"), "v")


# -- graph --------------------------------------------------------------------------------------------------------------------


def typed(s, d):
    """Orders that fix customers' issues and modify parts; every order below 500 has a vector."""
    o = table(s, d, "orders").select(F.concat(F.lit("o"), F.lpad("o_orderkey", 9, "0")).alias("source"), F.concat(F.lit("c"), "o_custkey").alias("target"), F.lit("fixes").alias("role"))
    p = table(s, d, "lineitem").select(F.concat(F.lit("o"), F.lpad("l_orderkey", 9, "0")).alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.lit("modifies").alias("role"))
    base = table(s, d, "embeddings").where("embedding IS NOT NULL").select(F.concat(F.lit("o"), F.lpad("vec_id", 9, "0")).alias("node"), F.col("embedding").cast("array<double>").alias("v"))
    return o.union(p), base.join(o.select(F.col("source").alias("node")).distinct(), "node", "left_semi")


TYPED = """e AS (SELECT DISTINCT 'o' || lpad(o_orderkey::VARCHAR, 9, '0') AS a, 'c' || o_custkey AS b, 'fixes' AS role FROM orders UNION ALL SELECT DISTINCT 'o' || lpad(l_orderkey::VARCHAR, 9, '0'), 'p' || l_partkey, 'modifies' FROM lineitem),
adj AS (SELECT a, b, role FROM e UNION ALL SELECT b, a, role FROM e), base AS (SELECT 'o' || lpad(vec_id::VARCHAR, 9, '0') AS node, unnest(range(0, len(embedding))) AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings WHERE vec_id IN (SELECT o_orderkey FROM orders)),
own AS (SELECT DISTINCT node FROM base),
c0 AS (SELECT a AS node, dim, avg(x) AS x FROM (SELECT a, role, dim, avg(x) AS x FROM adj JOIN base ON node = b WHERE a LIKE 'c%' GROUP BY ALL) GROUP BY ALL), s0 AS (SELECT * FROM base UNION ALL SELECT * FROM c0),
o0 AS (SELECT a AS node, dim, avg(x) AS x FROM (SELECT a, role, dim, avg(x) AS x FROM adj JOIN s0 ON node = b WHERE a LIKE 'o%' AND a NOT IN (SELECT node FROM own) AND b LIKE 'c%' GROUP BY ALL) GROUP BY ALL), s1 AS (SELECT * FROM s0 UNION ALL SELECT * FROM o0),
p0 AS (SELECT a AS node, dim, avg(x) AS x FROM (SELECT a, role, dim, avg(x) AS x FROM adj JOIN s1 ON node = b WHERE a LIKE 'p%' GROUP BY ALL) GROUP BY ALL), cur AS (SELECT * FROM s1 UNION ALL SELECT * FROM p0)"""


@query(f"WITH {TYPED}, x AS (SELECT node, dim, x FROM cur) SELECT node, {DIGEST} FROM x GROUP BY node")
def graph_seeding(s, d):
    """First vectors of nodes without one of their own, in the order of their ids."""
    edges, base = typed(s, d)
    return vector_digest(graph.seeded(edges, base), "node")


@query(f"""WITH {TYPED}, m AS (SELECT a AS node, dim, avg(x) AS m FROM (SELECT a, role, dim, avg(x) AS x FROM adj JOIN cur ON node = b GROUP BY ALL) GROUP BY ALL),
h AS (SELECT node, dim, CASE WHEN m.m IS NULL THEN coalesce(base.x, cur.x) WHEN base.x IS NULL THEN m.m ELSE 0.5 * base.x + 0.5 * m.m END AS x FROM cur FULL JOIN m USING (node, dim) FULL JOIN base USING (node, dim)),
n AS (SELECT node, sqrt(sum(x * x)) AS norm FROM h GROUP BY node), u AS (SELECT node, dim, coalesce(x / nullif(norm, 0), 0) AS x FROM h JOIN n USING (node)) SELECT node, {DIGEST} FROM u GROUP BY node""")
def graph_augmented(s, d):
    """Unit vectors after one round of typed mean aggregation over the whole graph."""
    edges, base = typed(s, d)
    return vector_digest(graph.augmented_vectors(edges, base, 0.5, 1), "node")


@query(f"""WITH a AS (SELECT vec_id AS node, unnest(range(0, len(embedding))) AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings WHERE vec_id % 3 < 2), b AS (SELECT vec_id AS node, unnest(range(0, len(embedding))) AS dim, -unnest(embedding::DOUBLE[]) AS x FROM embeddings WHERE vec_id % 3 > 0),
u AS (SELECT * FROM b UNION ALL SELECT * FROM a WHERE node NOT IN (SELECT node FROM b)) SELECT node, {DIGEST} FROM u GROUP BY node""")
def vector_union(s, d):
    """Two sets of vectors, the second one's where both have a node."""
    v = long_vectors(table(s, d, "embeddings"), "vec_id", "embedding")
    return digest(graph.merged(v.where("node % 3 < 2"), v.where("node % 3 > 0").withColumn("x", -F.col("x"))), "node")


@query("SELECT l_orderkey AS node, count(DISTINCT l_partkey) AS n, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS neighbours FROM lineitem GROUP BY l_orderkey")
def graph_views(s, d):
    """The parts of each order as an index."""
    v = graph.views(table(s, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").cast("string").alias("target")))
    return v.select("node", F.size("neighbours").cast("long").alias("n"), F.array_join("neighbours", ",").alias("neighbours"))


@query("""WITH c AS (SELECT l_partkey AS target, date_trunc('month', l_shipdate) AS date FROM lineitem), n AS (SELECT target, count(*) AS n FROM c GROUP BY target),
g AS (SELECT l_orderkey AS qid, l_partkey AS target, date_trunc('month', l_shipdate) AS date FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'), gd AS (SELECT DISTINCT target, date FROM g),
ot AS (SELECT target, count(*) AS other FROM c WHERE (target, date) NOT IN (SELECT (target, date) FROM gd) GROUP BY target), p AS (SELECT qid, target, coalesce(n, 0) AS n, coalesce(other, 0) AS other FROM (SELECT DISTINCT qid, target FROM g) LEFT JOIN n USING (target) LEFT JOIN ot USING (target)),
q AS (SELECT qid, bool_and(other < 1) AS alone FROM p GROUP BY qid)
SELECT count(*) AS pairs, count(*) FILTER (other < 1) AS isolated, count(*) FILTER (n < 2) AS single, (SELECT count(*) FROM q) AS queries, (SELECT count(*) FROM q WHERE alone) AS queries_isolated, list_sort(list(n))[count(*) // 2 + 1] AS median_commits, max(n) AS most_commits FROM p""")
def cochange_density(s, d):
    """How many of the finished orders' parts have line items of other months."""
    li = table(s, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("target"), F.date_trunc("month", "l_shipdate").alias("date"))
    gold = li.join(table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select(F.col("l_orderkey").alias("qid"), "target", "date")
    return graph.density(li.select("target", "date"), gold)


SUB = """r AS (SELECT a.vec_id AS qid, b.vec_id AS cand, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), e AS (SELECT DISTINCT l_orderkey AS cand, 'p' || lpad(l_partkey::VARCHAR, 9, '0') AS path, p_size <= 20 AS t FROM lineitem JOIN part ON p_partkey = l_partkey),
g AS (SELECT cand, list_slice(list_sort(coalesce(list(path) FILTER (NOT t), [])), 1, 3) AS files, list_slice(list_sort(coalesce(list(path) FILTER (t), [])), 1, 3) AS tests FROM e GROUP BY cand),
sub AS (SELECT qid, rank, cand, score, coalesce(files, []) AS files, coalesce(tests, []) AS tests FROM r LEFT JOIN g USING (cand) WHERE rank <= 5)"""


def found_subgraph(s, d):
    v = vectors(s, d, "cand")
    ranked = dense.searched_dot(v.where("cand % 100 = 0").select(F.col("cand").alias("qid"), F.col("v").alias("qv")), v, 5).withColumn("score", F.round("score", 9))
    ranked = materialise(ranked, "ranked")
    p = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") <= 20).alias("is_test"))
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("cand"), "l_partkey")
    e = graph.of_nodes(li, ranked, "cand").join(p, "l_partkey").select("cand", F.concat(F.lit("p"), F.lpad("l_partkey", 9, "0")).alias("path"), "is_test")
    return graph.subgraph(ranked, e, 3)


@query(f"WITH {SUB} SELECT qid, rank, cand, round(score, 6) AS score, array_to_string(files, ',') AS files, array_to_string(tests, ',') AS tests FROM sub")
def retrieved_subgraph(s, d):
    """The five nearest changes of every hundredth vector, a stated query set, with the files and tests they touch."""
    return found_subgraph(s, d).select("qid", F.col("rank").cast("long").alias("rank"), "cand", F.round("score", 6).alias("score"), F.array_join("files", ",").alias("files"), F.array_join("tests", ",").alias("tests"))


@query(f"""WITH {SUB}, b AS (SELECT qid, count(*) AS n, string_agg('## PR #' || rank || '  (relevance=' || printf('%.3f', score) || ')' || chr(10) || 'summary: ' || 'change ' || cand || chr(10) || 'changed files: ' || CASE WHEN len(files) > 0 THEN array_to_string(files, ', ') ELSE '(none recorded)' END
  || chr(10) || 'changed tests: ' || CASE WHEN len(tests) > 0 THEN array_to_string(tests, ', ') ELSE '(none recorded)' END, chr(10) || chr(10) ORDER BY rank) AS body FROM sub GROUP BY qid)
SELECT vec_id AS qid, '# ISSUE' || chr(10) || 'title: issue ' || vec_id || chr(10) || CASE WHEN vec_id % 200 = 0 THEN 'description: ' || repeat('x', 599) || '…' || chr(10) ELSE '' END || chr(10) || '# RELATED PULL REQUESTS (top ' || n || ' by relevance)' || chr(10) || body || chr(10) AS prompt FROM embeddings JOIN b ON qid = vec_id""")
def packed_subgraph(s, d):
    """The subgraphs as bounded prompts."""
    found = found_subgraph(s, d).withColumn("title", F.concat(F.lit("change "), "cand"))
    issues = table(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.concat(F.lit("issue "), "vec_id").alias("title"), F.when(F.col("vec_id") % 200 == 0, F.repeat(F.lit("x"), F.lit(700))).alias("body"))
    return graph.packed(found, issues)


@query("""WITH c AS (SELECT o_orderkey AS qid, l_partkey AS cand, max(l_linenumber <= 2) AS relevant, max(l_quantity * l_discount) AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
p AS (SELECT qid, cand, relevant, CASE WHEN cand % 3 > 0 THEN score END AS score FROM c), f AS (SELECT qid, arg_min(relevant, {'s': -round(score, 9), 'cand': cand}) AS first, bool_or(relevant) AS hit, count(*) AS n, count(*) FILTER (relevant) AS r FROM p WHERE score IS NOT NULL GROUP BY qid)
SELECT round((SELECT avg((score IS NOT NULL)::INTEGER) FROM p WHERE relevant), 6) AS coverage_relevant, round((SELECT avg((score IS NOT NULL)::INTEGER) FROM p WHERE NOT relevant), 6) AS coverage_other, count(*) AS n_queries, round(avg(first::INTEGER), 6) AS r1_covered, round(avg(r / n), 6) AS r1_random FROM f WHERE hit""")
def fair_ranking(s, d):
    """R@1 of orders' first lines among the parts that have a score, beside a random order of them."""
    li = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("cand")).agg(F.max(F.col("l_linenumber") <= 2).alias("relevant"), F.max(F.col("l_quantity") * F.col("l_discount")).alias("score"))
    li = li.join(table(s, d, "orders").select(F.col("o_orderkey").alias("qid")).distinct(), "qid", "left_semi").withColumn("score", F.when(F.col("cand") % 3 > 0, F.col("score")))
    out = graph.fair_rank(li)
    return out.select(*(F.round(c, 6).alias(c) if c != "n_queries" else F.col(c) for c in out.columns))
