"""Queries that construct benchmarks and rank their pools, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from relquill.functions import text as T
from relquill.operators import benchmarks, lexical, ranking, synthetic
from relquill.plans.catalogue import BM25, GOLD, H32, IN_GROUP, OVERLAP, TOK, drawn_sql, gold, groups, items, query, scrub_sql, texts
from relquill.sources.tables import table

FULL = f"""{OVERLAP}, {GOLD}, {IN_GROUP},
pool AS (SELECT DISTINCT ig.qid, mg.cand, coalesce(ov.score, 0) AS score FROM ig JOIN mg USING (grp) LEFT JOIN ov ON ov.qid = ig.qid AND ov.cand = mg.cand WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.qid = ig.qid AND g.cand = mg.cand)),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cand) AS k, count(*) OVER (PARTITION BY qid) AS n FROM pool) WHERE k <= 8),
{drawn_sql("ig", "mg", "(SELECT qid, cand FROM gold UNION ALL SELECT qid, cand FROM pk)", 5, 1)}, kq AS (SELECT DISTINCT qid FROM pk WHERE n >= 5),
built AS (SELECT qid, cand, kind FROM (SELECT qid, cand, 'positive' AS kind FROM gold UNION ALL SELECT qid, cand, 'hard' FROM pk UNION ALL SELECT qid, cand, 'random' FROM dr WHERE k <= 4) JOIN kq USING (qid))"""


def pools(s, d):
    return benchmarks.retrieval_pools(lexical.overlap(items(s, d), texts(s, d)), gold(s, d), groups(s, d))


@query(f"WITH {FULL} SELECT qid, cand, kind FROM built")
def retrieval_pools(s, d):
    """Pools of positives, hard and random negatives."""
    return pools(s, d)


@query(f"""WITH {FULL}, {BM25.strip()}, r AS (SELECT qid, cand, kind, coalesce(bm.score, 0) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(coalesce(bm.score, 0), 9) DESC, cand) AS rank FROM built LEFT JOIN bm USING (qid, cand))
SELECT qid, cand, kind, round(score, 6) AS score, rank FROM r""")
def ranked_pools(s, d):
    """The pools ranked by BM25; candidates without a shared token score 0 and keep their place."""
    built = pools(s, d)
    scored = lexical.pooled(lexical.bm25(items(s, d), texts(s, d)), built)
    out = ranking.ranked(scored).join(built, ["qid", "cand"])
    return out.select("qid", "cand", "kind", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


CHANGES = "own AS (SELECT DISTINCT o_custkey AS grp, l_orderkey AS qid, l_partkey AS cand FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
def changes(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_custkey").alias("grp"))
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("cand")).join(o, "qid")


@query(f"""WITH {CHANGES}, {drawn_sql("own", "own", "own", 8, 2)}
SELECT qid, cand, 'positive' AS kind FROM own WHERE qid IN (SELECT qid FROM dr WHERE k = 1) UNION ALL SELECT qid, cand, CASE WHEN k <= 5 THEN 'hard' ELSE 'filler' END FROM dr""")
def change_pools(s, d):
    """Each order's parts and other parts of its customer, five as hard negatives and three to fill up."""
    return benchmarks.change_pools(changes(s, d))


@query(f"""WITH {CHANGES}, {drawn_sql("own", "own", "own", 15, 3)}
SELECT qid, cand, 'positive' AS kind FROM own WHERE qid IN (SELECT qid FROM dr WHERE k = 3) UNION ALL SELECT qid, cand, 'hard' FROM dr WHERE qid IN (SELECT qid FROM dr WHERE k = 3)""")
def sampled_change_pools(s, d):
    """Each order's parts and up to fifteen others of its customer; orders with fewer than three others are left out."""
    return benchmarks.change_pools(changes(s, d), hard=15, filler=0, least=3, seed=3)


SPLITS = "cs AS (SELECT c_custkey, CASE WHEN k <= floor(n * 0.6) THEN 'train' ELSE 'test' END AS split FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k, count(*) OVER () AS n FROM customer WHERE c_acctbal > 0))"


@query(f"""WITH {SPLITS} SELECT 'c' || c_custkey AS id, coalesce(split, 'train') AS split FROM customer LEFT JOIN cs USING (c_custkey)
UNION ALL SELECT 'o' || o_orderkey, coalesce(split, 'train') FROM orders LEFT JOIN cs ON c_custkey = o_custkey""")
def split_stamping(s, d):
    """Customers as queries with a split, which their orders inherit."""
    c = table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("record"), F.col("c_custkey").alias("qid"), "c_acctbal")
    split = benchmarks.numbered(c.where("c_acctbal > 0"), F.col("qid"), "qid").join(F.broadcast(c.where("c_acctbal > 0").agg(F.count("*").alias("n"))))
    queries = split.select("qid", "record", F.when(F.col("k") <= F.floor(F.col("n") * 0.6), "train").otherwise("test").alias("split"))
    o = table(s, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_custkey").alias("qid"))
    return benchmarks.inherited_split(c.select(F.col("record").alias("id")).union(o.select("id")), o, queries)


@query(f"""WITH {OVERLAP}, {GOLD}, tr AS (SELECT source FROM (SELECT source, row_number() OVER (ORDER BY source) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) WHERE k <= floor(n * 0.6)),
ig AS (SELECT DISTINCT qid, source FROM gold JOIN documents ON doc_id = cand JOIN tr USING (source)),
hn AS (SELECT qid, cand, score AS overlap, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cand) AS rank FROM ov JOIN documents ON doc_id = cand JOIN ig USING (qid, source)
  WHERE NOT EXISTS (SELECT 1 FROM gold g JOIN documents x ON x.doc_id = g.cand JOIN tr ON tr.source = x.source WHERE g.qid = ov.qid AND g.cand = ov.cand))
SELECT qid, cand, overlap FROM hn WHERE rank = 1""")
def mined_negatives(s, d):
    """The hardest training candidate of each training query."""
    g = groups(s, d)
    train = benchmarks.cross_group_split(g, "grp").where("split = 'train'").select("grp")
    return benchmarks.mined_negatives(lexical.overlap(items(s, d), texts(s, d)), gold(s, d), g, train)


@query(f"""WITH k AS (SELECT l_orderkey, l_partkey, row_number() OVER (ORDER BY {H32.format("'5|' || l_orderkey || '|' || l_partkey")}, l_orderkey, l_partkey) - 1 AS k FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) SELECT l_orderkey, l_partkey, k // 32 AS batch FROM k""")
def contrastive_batches(s, d):
    """Pairs dealt into random batches of 32."""
    return benchmarks.batches(table(s, d, "lineitem").select("l_orderkey", "l_partkey").distinct(), 32, 5, "l_orderkey", "l_partkey")


@query(f"""WITH k AS (SELECT p_brand, l_orderkey, l_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY {H32.format("'5|' || l_orderkey || '|' || l_partkey")}, l_orderkey, l_partkey) - 1 AS k FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey)
SELECT p_brand, l_orderkey, l_partkey, k // 32 AS batch FROM k""")
def homogeneous_batches(s, d):
    """Pairs dealt into batches of one brand each."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return benchmarks.batches(table(s, d, "lineitem").select("l_orderkey", "l_partkey").distinct().join(p, "l_partkey"), 32, 5, "l_orderkey", "l_partkey", group="p_brand").select("p_brand", "l_orderkey", "l_partkey", "batch")


@query("SELECT item_id AS qid, '2100-01-01T00:00:00Z' AS as_of FROM benchmark")
def stamped_queries(s, d):
    return benchmarks.stamped(items(s, d).select("qid"), "2100-01-01T00:00:00Z")


def _picks(what: str, pool: int, k: int, prefix: str) -> str:
    h = H32.format(f"'7|{what}|' || n || '|' || j")
    return f"list_transform(list_slice(list_sort(list_transform(range(0, {pool}), lambda j: {{'h': {h}, 'j': j}})), 1, {k}), lambda x: {prefix} || lpad(x.j::VARCHAR, 2, '0'))"


OWN = "'implc' || component || 'n'"


@query(f"""WITH n AS (SELECT n, n // 24 AS component FROM range(0, 240) t(n)) SELECT n, component, CASE WHEN {H32.format("'7|split|' || n")} < {int(0.6 * 2**32)} THEN 'train' ELSE 'test' END AS split,
array_to_string(list_concat({_picks('it', 40, 10, "'topic'")}, {_picks('ii', 12, 2, OWN)}), ' ') AS issue, array_to_string(list_concat({_picks('ci', 12, 8, OWN)}, {_picks('ct', 40, 6, "'topic'")}), ' ') AS change FROM n""")
def synthetic_components(s, d):
    """The synthetic benchmark: 240 pairs of ten components."""
    return synthetic.generate(s).select("n", "component", "split", F.array_join("issue", " ").alias("issue"), F.array_join("change", " ").alias("change"))


# -- lexical -----------------------------------------------------------------------------------------------------------------


@query(f"SELECT page_id, CASE WHEN page_id % 2 = 0 AND html IS NOT NULL AND html <> '' THEN sha256(html) ELSE sha256(array_to_string({TOK.format('url')}, ' ')) END AS h FROM pages")
def text_or_path(s, d):
    """The text of nodes that have a record, the path's tokens of others."""
    p = table(s, d, "pages")
    out = lexical.text_or_path(p.select(F.col("page_id").alias("cand"), F.col("url").alias("path")), p.where("page_id % 2 = 0").select(F.col("page_id").alias("cand"), F.col("html").alias("text")))
    return out.select(F.col("cand").alias("page_id"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))


@query(f"""WITH {BM25.replace("doc_id AS cand", "page_id AS cand").replace("FROM documents", "FROM pages").replace(TOK.format('text') + " AS ts FROM pages", TOK.format("url") + " AS ts FROM pages")} SELECT qid, cand, round(score, 6) AS score, rank FROM rk WHERE rank <= 5""")
def bm25_paths(s, d):
    """BM25 over the tokens of paths."""
    p = table(s, d, "pages").select(F.col("page_id").alias("cand"), F.col("url").alias("text"))
    return ranking.ranked(lexical.bm25(items(s, d), p), 5).select("qid", "cand", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


STOP = "[" + ", ".join(f"'{w}'" for w in T.PATH_STOPWORDS) + "]"
CORE = f"list_filter(list_distinct({TOK.format('url')}), lambda t: length(t) > 1 AND NOT list_contains({STOP}, t))"


@query(f"""WITH p AS (SELECT page_id, split_part(url, '/', 3) AS host, {CORE} AS ts FROM pages WHERE url IS NOT NULL),
c AS (SELECT q.page_id AS qid, q.host, x.ts FROM p q JOIN p x ON x.host = q.host AND x.page_id BETWEEN q.page_id AND q.page_id + 20 WHERE q.page_id % 100 = 0),
y AS (SELECT c.qid, p.page_id AS cand, len(list_intersect(c.ts, p.ts)) AS n, coalesce(len(list_intersect(c.ts, p.ts)) / nullif(len(list_distinct(list_concat(c.ts, p.ts))), 0), 0) AS j FROM c JOIN p USING (host) WHERE p.page_id NOT BETWEEN c.qid AND c.qid + 20),
b AS (SELECT qid, cand, max({{'n': n, 'j': j}}) AS x FROM y GROUP BY ALL), r AS (SELECT qid, cand, x.n AS n, x.j AS j, row_number() OVER (PARTITION BY qid ORDER BY x.n DESC, round(x.j, 9) DESC, cand) AS rank FROM b)
SELECT qid, cand, n, round(j, 6) AS j, rank FROM r WHERE rank <= 5""")
def path_proximity_of_changes(s, d):
    """Every hundredth page's neighbours as changed paths against the other pages of the host: the best path counts."""
    p = table(s, d, "pages").where("url IS NOT NULL").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), T.path_tokens("url").alias("tokens"))
    q = p.where("page_id % 100 = 0").select(F.col("page_id").alias("qid"), "host")
    near = F.col("page_id").between(F.col("qid"), F.col("qid") + 20)
    both = p.join(q, "host")
    out = lexical.path_proximity(both.where(near).select("qid", "tokens"), both.where(~near).select("qid", F.col("page_id").alias("cand"), "tokens"))
    w = Window.partitionBy("qid").orderBy(F.col("n").desc(), F.round("j", 9).desc(), "cand")
    return out.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select("qid", "cand", "n", F.round("j", 6).alias("j"), "rank")


@query(f"""WITH t AS (SELECT conv_id, turn, list_distinct({TOK.format('text')}) AS ts FROM conversations), p AS (SELECT a.ts AS x, b.ts AS y FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
j AS (SELECT round(coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0), 0), 12) AS j FROM p)
SELECT count(*) AS n, round(list_sort(list(j))[count(*) // 2 + 1], 9) AS median, round(count(*) FILTER (j > 0) / count(*), 9) AS share_above_0 FROM j""")
def similarity_profile(s, d):
    """Upper median and share above 0 of the Jaccard similarity of neighbouring turns."""
    t = table(s, d, "conversations").select("conv_id", "turn", F.array_distinct(T.tokens("text")).alias("x"))
    u = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y"))
    out = lexical.similarity_profile(t.join(u, ["conv_id", "turn"]).select(lexical.jaccard(F.col("x"), F.col("y")).alias("j")))
    return out.select("n", F.round("median", 9).alias("median"), F.round("share_above_0", 9).alias("share_above_0"))


@query(f"""WITH {GOLD} SELECT qid, cand FROM gold""")
def gold_pairs(s, d):
    """The items' texts found in documents, items of one token included."""
    return gold(s, d)


@query(f"""WITH g AS (SELECT source, CASE WHEN k <= floor(n * 0.6) THEN 'train' ELSE 'test' END AS split FROM (SELECT source, row_number() OVER (ORDER BY source) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)))
SELECT doc_id, split, sha256({scrub_sql("coalesce(text, '')")}) AS h FROM documents JOIN g USING (source)""")
def crossgroup_dataset(s, d):
    """Scrubbed texts with the split of their group: what an ablation loads."""
    docs = table(s, d, "documents").select("doc_id", F.col("source").alias("grp"), T.scrub_references("text").alias("t"))
    split = benchmarks.cross_group_split(docs, "grp")
    return docs.join(split, "grp").select("doc_id", "split", F.sha2(F.col("t").cast("binary"), 256).alias("h"))
