"""Named queries over the driver's tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relquill.functions import text as T
from relquill.operators import benchmarks, dense, graph, ingest, lexical, ranking, validation
from relquill.sources.tables import long_vectors, materialise, spread, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- inputs -----------------------------------------------------------------------------------------------------------


def items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def texts(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents").select(F.col("doc_id").alias("cand"), "text"))


def groups(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("cand"), F.col("source").alias("grp"))


def gold(s: SparkSession, d: str, postings: DataFrame | None = None) -> DataFrame:
    """(qid, cand): documents that hold an item's whole text.

    Items and documents meet on the rarest token that lies inside the item, which no neighbouring letter can change. Items that
    have none, being short, are compared with every text in blocks. ``postings``: those of the items' tokens, where at hand.
    """
    q = items(s, d).where("text IS NOT NULL").select("qid", F.col("text").alias("item"), T.tokens("text").alias("ts"))
    inner = q.select("qid", "item", F.array_distinct(F.slice("ts", 2, F.greatest(F.size("ts") - 2, F.lit(0)))).alias("ts"))
    wanted = lexical.bounded(inner.select(F.explode("ts").alias("tok")).distinct())
    doc = texts(s, d).where("text IS NOT NULL")
    held = lexical.query_postings(items(s, d), texts(s, d)) if postings is None else postings
    held = held.where("tok IS NOT NULL").select("cand", "tok").join(wanted, "tok", "left_semi")
    df = held.groupBy("tok").agg(F.count("*").alias("df"))
    key = inner.select("qid", F.explode("ts").alias("tok")).join(df, "tok").groupBy("qid").agg(F.min(F.struct("df", "tok"))["tok"].alias("tok"))
    near = held.join(key, "tok").select("qid", "cand")
    near = near.join(lexical.bounded(items(s, d).select("qid", F.col("text").alias("item")), 100_000, F.octet_length("item")), "qid").groupBy("cand").agg(F.collect_list(F.struct("qid", "item")).alias("x"))  # the items of one text
    near = materialise(near, "near")
    texts_of = table(s, d, "documents").select(F.col("doc_id").alias("cand"), "text")
    found = texts_of.join(lexical.bounded(near, 20_000, F.aggregate("x", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["item"]) + 16)), "cand").select("cand", F.explode(F.filter("x", lambda x: F.contains("text", x["item"]))["qid"]).alias("qid"))
    found = found.select("qid", "cand")
    short = inner.where("size(ts) = 0").select("qid", "item").withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(SHORT_BLOCKS)))
    for k in [r["block"] for r in short.select("block").distinct().collect()]:
        block = short.where(F.col("block") == k).agg(F.collect_list(F.struct("qid", "item")).alias("x"))  # one row
        found = found.union(doc.join(F.broadcast(block)).select(F.explode(F.filter("x", lambda x: F.contains("text", x["item"]))["qid"]).alias("qid"), "cand"))
    return materialise(found.distinct(), "gold")


#: Blocks that items without a token of their own are dealt into.
SHORT_BLOCKS = 8


TOK = "regexp_extract_all(lower(regexp_replace(coalesce({}, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+')"
GOLD = "gold AS (SELECT b.item_id AS qid, d.doc_id AS cand FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
BM25 = f"""
dt AS (SELECT doc_id AS cand, {TOK.format('text')} AS ts FROM documents), dl AS (SELECT cand, len(ts) AS dl FROM dt), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT cand, tok, count(*) AS tf FROM (SELECT cand, unnest(ts) AS tok FROM dt) GROUP BY ALL), df AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok),
qt AS (SELECT qid, tok, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({TOK.format('text')}) AS tok FROM benchmark) GROUP BY ALL),
bm AS (SELECT qid, cand, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM tf JOIN qt USING (tok) JOIN df USING (tok) JOIN dl USING (cand), st GROUP BY ALL),
rk AS (SELECT qid, cand, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, cand) AS rank FROM bm)"""


def bm25_ranks(s: SparkSession, d: str, top: int) -> DataFrame:
    return ranking.ranked(lexical.bm25(items(s, d), texts(s, d)), top)


def bm25_gold(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(gold; rank of each relevant document by BM25)."""
    held = lexical.query_postings(items(s, d), texts(s, d))
    g = gold(s, d, held)
    return g, ranking.gold_ranks(lexical.bm25(items(s, d), postings=held), g)


# -- lexical ranking ----------------------------------------------------------------------------------------------------


@query(f"WITH {BM25} SELECT qid, cand, round(score, 6) AS score, rank FROM rk WHERE rank <= 10")
def bm25_rank_topk(s, d):
    return bm25_ranks(s, d, 10).select("qid", "cand", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {GOLD}, pool AS (SELECT DISTINCT g.qid, x.doc_id AS cand FROM gold g JOIN documents p ON p.doc_id = g.cand JOIN documents x ON x.source = p.source),
dt AS (SELECT qid, doc_id AS cand, {TOK.format('text')} AS ts FROM pool JOIN documents ON doc_id = cand), st AS (SELECT qid, count(*) AS n, avg(len(ts)) AS avgdl FROM dt GROUP BY qid),
tf AS (SELECT qid, cand, dl, tok, count(*) AS tf FROM (SELECT qid, cand, len(ts) AS dl, unnest(ts) AS tok FROM dt) GROUP BY ALL),
df AS (SELECT qid, tok, count(*) AS df FROM tf GROUP BY ALL),
qt AS (SELECT qid, tok, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({TOK.format('text')}) AS tok FROM benchmark) GROUP BY ALL),
bm AS (SELECT qid, cand, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM tf JOIN qt USING (qid, tok) JOIN df USING (qid, tok) JOIN st USING (qid) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, cand) AS rank FROM bm)
SELECT qid, cand, round(score, 6) AS score, rank FROM rk WHERE rank <= 5""")
def bm25_pool_scope(s, d):
    """BM25 with document counts and lengths of each query's pool (the groups of its positives) alone."""
    held = lexical.query_postings(items(s, d), texts(s, d))
    scope = gold(s, d, held).join(groups(s, d), "cand").select("qid", "grp")
    out = ranking.ranked(lexical.bm25_in_groups(items(s, d), held, groups(s, d), scope), 5)
    return out.select("qid", "cand", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _tf_sql(weight: str, least: int) -> str:
    return f"""WITH dt AS (SELECT doc_id AS cand, unnest({TOK.format('text')}) AS tok FROM documents), tf AS (SELECT cand, tok, count(*) AS tf FROM dt GROUP BY ALL),
df AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok HAVING count(*) >= {least}), n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT tf.* FROM tf JOIN df USING (tok)), norm AS (SELECT cand, sqrt(sum(tf * tf)) AS norm FROM v GROUP BY cand),
q AS (SELECT qid, tok, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({TOK.format('text')}) AS tok FROM benchmark) JOIN df USING (tok) GROUP BY ALL),
qn AS (SELECT qid, sqrt(sum(qtf * qtf)) AS qnorm FROM q GROUP BY qid),
sc AS (SELECT qid, cand, sum({weight} * tf * qtf) AS dot FROM v JOIN q USING (tok) JOIN df USING (tok), n GROUP BY ALL),
rk AS (SELECT qid, cand, dot / norm / qnorm AS score FROM sc JOIN norm USING (cand) JOIN qn USING (qid)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, cand) AS rank FROM rk)
SELECT qid, cand, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""


def _top5(scores: DataFrame) -> DataFrame:
    return ranking.ranked(scores, 5).select("qid", "cand", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_tf_sql("1.0", 1))
def vanilla_tf_cosine(s, d):
    return _top5(lexical.tf_dot(items(s, d), texts(s, d)))


@query(_tf_sql("(ln((1 + n) / (1 + df)) + 1)", 2))
def idf_dot_rank(s, d):
    return _top5(lexical.tf_dot(items(s, d), texts(s, d), idf=True, min_df=2))


@query()
def hashed_log_tf_cosine(s, d):
    """Cosine of hashed log counts (crc32 buckets, which the SQL at hand has not)."""
    return _top5(lexical.hashed_cosine(items(s, d), texts(s, d), T.identifier_tokens))


OVERLAP = f"""ov AS (SELECT qid, cand, count(*) AS score FROM (SELECT DISTINCT item_id AS qid, unnest({TOK.format('text')}) AS tok FROM benchmark)
  JOIN (SELECT DISTINCT doc_id AS cand, unnest({TOK.format('text')}) AS tok FROM documents) USING (tok) GROUP BY ALL)"""


@query(f"WITH {OVERLAP}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cand) AS rank FROM ov) SELECT qid, cand, score, rank FROM r WHERE rank <= 10")
def token_overlap_rank(s, d):
    return ranking.ranked(lexical.overlap(items(s, d), texts(s, d)), 10).select("qid", "cand", "score", F.col("rank").cast("long").alias("rank"))


# -- metrics ------------------------------------------------------------------------------------------------------------

PERQ = f"""{BM25}, {GOLD}, pq AS (SELECT g.qid, count(*) AS n_rel, count(*) FILTER (rank <= 1) / count(*) AS recall_1, count(*) FILTER (rank <= 5) / count(*) AS recall_5, count(*) FILTER (rank <= 10) / count(*) AS recall_10,
  CASE WHEN min(rank) <= 1 THEN 1.0 ELSE 0.0 END AS hit_1, CASE WHEN min(rank) <= 5 THEN 1.0 ELSE 0.0 END AS hit_5, CASE WHEN min(rank) <= 10 THEN 1.0 ELSE 0.0 END AS hit_10, coalesce(1 / min(rank), 0) AS rr,
  coalesce(sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END), 0) / list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda k: 1 / log2(k + 1))) AS ndcg_10
  FROM gold g LEFT JOIN rk USING (qid, cand) GROUP BY g.qid)"""
METRICS = ("recall_1", "recall_5", "recall_10", "hit_1", "hit_5", "hit_10", "rr", "ndcg_10")


@query(f"WITH {PERQ} SELECT count(*) AS n_queries, " + ", ".join(f"round(avg({m}), 6)::DOUBLE AS {m}" for m in METRICS) + " FROM pq")
def retrieval_metrics(s, d):
    g, ranks = bm25_gold(s, d)
    pq = ranking.per_query(ranks, g)
    return pq.agg(F.count("*").alias("n_queries"), *(F.round(F.avg(m), 6).alias(m) for m in METRICS))


@query(f"WITH {PERQ} SELECT qid, n_rel, " + ", ".join(f"round({m}, 6)::DOUBLE AS {m}" for m in METRICS) + " FROM pq")
def ndcg_hits_suite(s, d):
    g, ranks = bm25_gold(s, d)
    return ranking.per_query(ranks, g).select("qid", "n_rel", *(F.round(m, 6).alias(m) for m in METRICS))


@query(f"""WITH {BM25}, {GOLD} SELECT source AS grp, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS top1
FROM gold JOIN documents ON doc_id = cand LEFT JOIN rk USING (qid, cand) GROUP BY ROLLUP (source)""")
def metrics_by_group_rollup(s, d):
    g, ranks = bm25_gold(s, d)
    g = g.join(groups(s, d), "cand").join(ranks, ["qid", "cand"], "left")
    return g.rollup("grp").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("rank") <= 1, 1.0).otherwise(0.0)), 6).alias("top1"))


HARD = f"""{OVERLAP}, {GOLD}, ig AS (SELECT DISTINCT qid, source FROM gold JOIN documents ON doc_id = cand),
hn AS (SELECT qid, cand, score AS overlap, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cand) AS rank FROM ov JOIN documents ON doc_id = cand JOIN ig USING (qid, source)
  WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.qid = ov.qid AND g.cand = ov.cand))"""


@query(f"WITH {HARD} SELECT qid, cand, overlap, rank FROM hn WHERE rank <= 8")
def hard_negative_mining(s, d):
    held = lexical.query_postings(items(s, d), texts(s, d))
    out = benchmarks.mine_hard_negatives(lexical.overlap(items(s, d), postings=held), gold(s, d, held), groups(s, d))
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {BM25}, {HARD}, a AS (SELECT g.qid, min(rk.rank) AS rel FROM gold g LEFT JOIN rk USING (qid, cand) GROUP BY g.qid),
b AS (SELECT h.qid, min(rk.rank) AS neg FROM hn h LEFT JOIN rk ON rk.qid = h.qid AND rk.cand = h.cand WHERE h.rank <= 8 GROUP BY h.qid)
SELECT count(*) AS n, round(avg(CASE WHEN rel IS NULL THEN 0.0 WHEN neg IS NULL OR rel < neg THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy FROM a JOIN b USING (qid)""")
def hard_negative_accuracy(s, d):
    held = lexical.query_postings(items(s, d), texts(s, d))
    g = gold(s, d, held)
    hard = benchmarks.mine_hard_negatives(lexical.overlap(items(s, d), postings=held), g, groups(s, d)).select("qid", "cand")
    hard = materialise(hard, "hard")
    ranks = ranking.gold_ranks(lexical.bm25(items(s, d), postings=held), g.union(hard))
    wins = ranking.hard_negative_wins(ranks, g, hard)
    return wins.agg(F.count("win").alias("n"), F.round(F.avg("win"), 6).alias("accuracy"))


H32 = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def drawn_sql(asked: str, members: str, excluded: str, size: int, seed: int) -> str:
    """``benchmarks.drawn`` as relations: ``dr`` holds (qid, cand, k)."""
    return f"""ak AS (SELECT DISTINCT qid, grp FROM {asked} WHERE grp IS NOT NULL), mb AS (SELECT DISTINCT grp, cand FROM {members} WHERE grp IS NOT NULL AND cand IS NOT NULL),
ex AS (SELECT DISTINCT qid, cand FROM {excluded}), ex_n AS (SELECT qid, count(*) AS n_out FROM ex GROUP BY qid), mk AS (SELECT *, grp <> min(grp) OVER (PARTITION BY cand) AS again FROM mb),
un AS (SELECT qid, grp, cand, again, row_number() OVER (PARTITION BY qid ORDER BY grp, {H32.format(f"'{seed}|' || grp || '|' || cand")}, cand) - 1 AS pos FROM ak JOIN mk USING (grp)),
tn AS (SELECT qid, count(*) AS n, CASE WHEN count(DISTINCT grp) > 1 THEN count(*) FILTER (again) ELSE 0 END AS again FROM un GROUP BY qid),
tm AS (SELECT qid, n, least(n, {size} + coalesce(n_out, 0) + again) AS m FROM tn LEFT JOIN ex_n USING (qid)), sj AS (SELECT qid, n, m, unnest(range(0, m)) AS j FROM tm),
sp AS (SELECT qid, j * n // m + {H32.format(f"'{seed}|' || qid || '|' || j")} % ((j + 1) * n // m - j * n // m) AS pos FROM sj),
fd AS (SELECT DISTINCT qid, cand FROM sp JOIN un USING (qid, pos) WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.qid = un.qid AND ex.cand = un.cand)),
dr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {H32.format(f"'{seed}|' || qid || '|' || cand")}, cand) AS k FROM fd) WHERE k <= {size})"""


IN_GROUP = "ig AS (SELECT DISTINCT qid, source AS grp FROM gold JOIN documents ON doc_id = cand), mg AS (SELECT source AS grp, doc_id AS cand FROM documents)"


@query(f"WITH {GOLD}, {IN_GROUP}, {drawn_sql('ig', 'mg', 'gold', 15, 7)} SELECT qid, cand, k FROM dr")
def hash_sampled_pool(s, d):
    return benchmarks.sampled_pool(items(s, d).select("qid"), groups(s, d), gold(s, d), 15, 7).withColumn("k", F.col("k").cast("long"))


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER () AS n FROM orders WHERE o_orderdate IS NOT NULL)
SELECT o_orderkey, CASE WHEN k <= floor(n * 0.6) THEN 'train' ELSE 'test' END AS split FROM r""")
def temporal_split(s, d):
    return benchmarks.temporal_split(table(s, d, "orders").where("o_orderdate IS NOT NULL").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query("""WITH g AS (SELECT source AS grp, row_number() OVER (ORDER BY source) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, CASE WHEN k <= floor(n * 0.6) THEN 'train' ELSE 'test' END AS split FROM documents JOIN g ON grp = source""")
def crossgroup_split(s, d):
    docs = table(s, d, "documents").select("doc_id", F.col("source").alias("grp"))
    return docs.join(benchmarks.cross_group_split(docs, "grp"), "grp").select("doc_id", "split")


@query(f"""WITH g AS (SELECT DISTINCT source FROM documents), k AS (SELECT s, source, row_number() OVER (PARTITION BY s ORDER BY {H32.format("s || '|' || source")}, source) AS k, count(*) OVER (PARTITION BY s) AS n FROM g, range(100, 105) t(s))
SELECT s AS seed, source AS grp, CASE WHEN k <= floor(n * 0.6) THEN 'train' ELSE 'test' END AS split FROM k""")
def multi_split(s, d):
    g = table(s, d, "documents").select(F.col("source").alias("grp")).distinct().where("grp IS NOT NULL").withColumn("seed", F.explode(F.sequence(F.lit(100).cast("long"), F.lit(104).cast("long"))))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "seed", "grp").cast("binary")), 1, 8), 16, 10).cast("long")
    w = Window.partitionBy("seed")
    k = g.withColumn("k", F.row_number().over(w.orderBy(h, "grp"))).withColumn("n", F.count("*").over(w))
    return k.select("seed", "grp", F.when(F.col("k") <= F.floor(F.col("n") * 0.6), "train").otherwise("test").alias("split"))


@query("""WITH x AS (SELECT doc_id, source, n_chars::DOUBLE AS x FROM documents)
SELECT doc_id, round(coalesce((x - avg(x) OVER (PARTITION BY source)) / nullif(round(stddev_pop(x) OVER (PARTITION BY source), 12), 0), 0), 6) AS z FROM x""")
def loro_folds_zscore(s, d):
    return table(s, d, "documents").select("doc_id", F.round(ranking.z_score(F.col("n_chars").cast("double"), "source"), 6).alias("z"))


# -- text ---------------------------------------------------------------------------------------------------------------


WS = r"[\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
W = r"[\pL\pN\pM\pPc]"


def scrub_sql(text: str) -> str:
    """The patterns without look-around: hash-like words of letters alone are marked first, and the mark is taken off again."""
    steps = [
        (rf"https?://(www\.)?github\.com/({W}|[.\-])+/({W}|[.\-])+/(issues|pull|commit)/{W}+", " ", "gi"), (rf"({W}|[.\-])+/({W}|[.\-])+#\pNd+", " ", "g"),
        (rf"(^|[^\pL\pN\pM\pPc])#\pNd+", r"\1 ", "g"), (r"\bgh-\d+\b", " ", "gi"), (r"\b([a-f]{7,40})\b", r"\1_q_", "gi"), (r"\b[0-9a-f]{7,40}\b", " ", "gi"), (r"_q_", "", "g"),
        (rf"\({WS}*[,;]?{WS}*\)", " ", "g"), (r"[ \t]{2,}", " ", "g"), (rf"{WS}+([.,;:!?])", r"\1", "g"), (rf"^{WS}+|{WS}+$", "", "g"),
    ]
    for pattern, by, flags in steps:
        text = f"regexp_replace({text}, '{pattern}', '{by}', '{flags}')".replace("\\pNd", "\\p{Nd}").replace("\\pPc", "\\p{Pc}")
    return text


@query(f"SELECT doc_id, length(s) AS n, sha256(s) AS h FROM (SELECT doc_id, {scrub_sql("coalesce(text, '') || ' see owner/repo#12 and #34 (gh-56) (, ) https://github.com/a/b.c/pull/9x 1a2b3c4 DEADBEE Beef123 .'")} AS s FROM documents)")
def scrub_references(s, d):
    """References are appended to each text first."""
    added = F.lit(" see owner/repo#12 and #34 (gh-56) (, ) https://github.com/a/b.c/pull/9x 1a2b3c4 DEADBEE Beef123 .")
    out = table(s, d, "documents").select("doc_id", T.scrub_references(F.concat(F.coalesce("text", F.lit("")), added)).alias("s"))
    return out.select("doc_id", F.length("s").cast("long").alias("n"), F.sha2(F.col("s").cast("binary"), 256).alias("h"))


@query("""SELECT doc_id, count(*) AS n, sha256(string_agg(lower(regexp_replace(r, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) || ' ' || lower(r), ' ' ORDER BY i)) AS h
FROM (SELECT doc_id, unnest(rs) AS r, unnest(range(0, len(rs))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS rs FROM documents)) GROUP BY doc_id""")
def tokenize_identifiers(s, d):
    """Identifiers of each text, and all their tokens in order as a digest."""
    t = table(s, d, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).cast("long").alias("n"), T.identifier_tokens("text").alias("ts"))
    return t.where("n > 0").select("doc_id", "n", F.sha2(F.array_join("ts", " ").cast("binary"), 256).alias("h"))


@query("""WITH b AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents),
c AS (SELECT doc_id, t, unnest(range(0, CASE WHEN length(t) <= 1024 THEN 1 ELSE length(t) END, 819)) AS p FROM b)
SELECT doc_id, count(*) AS n, sum(length(substr(t, p + 1, 1024)))::BIGINT AS chars FROM c WHERE length(t) <= 1024 OR regexp_matches(substr(t, p + 1, 1024), '\\S') GROUP BY doc_id""")
def chunk_windows(s, d):
    c = spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", T.chunks("text", 1024).alias("c"))
    return c.select("doc_id", F.size("c").cast("long").alias("n"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def json_props_extract(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT o_orderkey, 'sha256:' || sha256('{"o_custkey":' || coalesce(o_custkey::VARCHAR, 'null') || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":' || coalesce('"' || o_orderpriority || '"', 'null') || ',"o_orderstatus":' || coalesce('"' || o_orderstatus || '"', 'null') || '}') AS h FROM orders""")
def provenance_hash(s, d):
    return table(s, d, "orders").select("o_orderkey", T.canonical_hash("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").alias("h"))


@query("""WITH b AS (SELECT doc_id, 'Fixes:#' || (doc_id + 1) || ', closes owner/repo#00' || (doc_id + 2) || ' and see #5 ' || coalesce(text, '') AS body FROM documents),
e AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(body, '(?i)\\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\\b[:\\s]*(?:[a-z0-9_.-]+/[a-z0-9_.-]+)?(?:#|gh-)([0-9]+)', 1))::BIGINT AS n FROM b)
SELECT 'gh:o/r:pr:' || doc_id AS source, 'gh:o/r:issue:' || n AS target, 'fixes' AS relation, 0.95::DOUBLE AS confidence, '2024-01-01T00:00:00Z' AS valid_from, 'human_label' AS method,
  'sha256:' || sha256('{"relation":"fixes","source":"gh:o/r:pr:' || doc_id || '","target":"gh:o/r:issue:' || n || '"}') AS content_hash FROM e WHERE n IN (SELECT doc_id FROM documents) AND n <> doc_id""")
def ingest_extract_fixes(s, d):
    """Each document is a pull request's body, and an issue; titles close nothing, and times and licenses are filled in."""
    body = F.concat(F.lit("Fixes:#"), (F.col("doc_id") + 1).cast("string"), F.lit(", closes owner/repo#00"), (F.col("doc_id") + 2).cast("string"), F.lit(" and see #5 "), F.coalesce("text", F.lit("")))
    row = {"repo": F.lit("o/r"), "retrieved_at": F.lit("2024-01-01T00:00:00Z"), "issues": F.array(F.struct(F.col("doc_id").alias("number"))), "pulls": F.array(F.struct(F.col("doc_id").alias("number"), F.concat(F.lit("Fixes #"), (F.col("doc_id") + 3).cast("string")).alias("title"), body.alias("body")))}
    snapshots = table(s, d, "documents").select(F.from_json(F.to_json(F.struct(*(x.alias(k) for k, x in row.items()))), ingest.SNAPSHOT).alias("x")).select("x.*")
    return ingest.edges(snapshots).where("relation = 'fixes'").select("source", "target", "relation", "confidence", "valid_from", "provenance.method", "provenance.content_hash")


@query("""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f, role FROM conversations)
SELECT conv_id, string_agg(role || ': ' || CASE WHEN length(f) <= 60 THEN f ELSE rtrim(substr(f, 1, 59)) || '…' END, chr(10) ORDER BY turn, role, f) AS prompt FROM t GROUP BY conv_id""")
def pack_context(s, d):
    t = table(s, d, "conversations").select("conv_id", "turn", "role", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("f"))
    line = F.concat("role", F.lit(": "), T.truncated("f", 60))
    rows = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "f", line.alias("line")))).alias("x"))
    return rows.select("conv_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("prompt"))


# -- vectors ------------------------------------------------------------------------------------------------------------


@query("""SELECT q, cand, round(score, 5) AS score FROM (SELECT a.vec_id AS q, b.vec_id AS cand, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS k
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE k <= 5""")
def cosine_topk_vectors(s, d):
    """Every hundredth vector as a stated query set against all vectors."""
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("qv"))
    found = dense.searched_dot(q, e.withColumnRenamed("vec_id", "cand"), 5)
    return found.select(F.col("qid").alias("q"), "cand", F.round("score", 5).alias("score"))


@query("""SELECT label, dim, round(avg(x), 6) AS x FROM (SELECT label, unnest(range(0, len(embedding))) AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY ALL""")
def whole_doc_mean_vector(s, d):
    e = table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))


CHUNKS = rf"""WITH b AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents),
c AS (SELECT doc_id, t, unnest(range(0, CASE WHEN length(t) <= 512 THEN 1 ELSE length(t) END, 409)) AS i FROM b),
s AS (SELECT doc_id, i, len(list_distinct({TOK.format('substr(t, i + 1, 512)')})) AS v FROM c WHERE length(t) <= 512 OR regexp_matches(substr(t, i + 1, 512), '\S'))"""


@query(f"{CHUNKS} SELECT doc_id, max(v) AS maxp, max(v) FILTER (i = 0) AS firstp, sum(v)::BIGINT AS sump, round(avg(v), 6) AS meanp FROM s GROUP BY doc_id")
def chunk_maxp_firstp_sump_meanp(s, d):
    """Chunk aggregators over a lexical chunk score, the number of distinct tokens."""
    c = table(s, d, "documents").select("doc_id", F.transform(T.chunks("text", 512), lambda x: F.size(F.array_distinct(T.tokens(x))).cast("long")).alias("v"))
    total = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x)
    return c.select("doc_id", F.array_max("v").alias("maxp"), F.element_at("v", 1).alias("firstp"), total.alias("sump"), F.round(total / F.size("v"), 6).alias("meanp"))


# -- graph --------------------------------------------------------------------------------------------------------------


def modifies(s: SparkSession, d: str) -> DataFrame:
    """(source order, target part, time): the edges of the order-to-part graph."""
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_shipdate").alias("time"))


EDGES = "e AS (SELECT DISTINCT l_orderkey AS source, l_partkey AS target FROM lineitem)"


@query("""WITH e AS (SELECT DISTINCT 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM lineitem WHERE l_linenumber > 1),
x AS (SELECT DISTINCT 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM lineitem WHERE l_linenumber = 1), k AS (SELECT a, b FROM e EXCEPT SELECT a, b FROM x)
SELECT a, b, 'modifies' AS role FROM k UNION ALL SELECT b, a, 'modifies' FROM k""")
def typed_adjacency(s, d):
    li = table(s, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.lit("modifies").alias("role"), "l_linenumber")
    out = li.where("l_linenumber = 1").select(F.col("source").alias("a"), F.col("target").alias("b"))
    return graph.adjacency(li.where("l_linenumber > 1"), out)


@query(f"""WITH {EDGES}, v AS (SELECT vec_id, unnest(range(0, len(embedding))) AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings)
SELECT target AS node, dim, round(avg(x), 6) AS x FROM e JOIN v ON vec_id = source GROUP BY ALL""")
def graph_mean_hop1(s, d):
    v = long_vectors(table(s, d, "embeddings"), "vec_id", "embedding").withColumnRenamed("node", "source")
    e = modifies(s, d).select("source", "target").distinct()
    return e.join(v, "source").groupBy(F.col("target").alias("node"), F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg("x"), 6).alias("x"))


HOP2 = f"""WITH {EDGES}, v AS (SELECT vec_id AS source, unnest(range(0, len(embedding))) AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
p AS (SELECT target, dim, avg(x) AS x FROM e JOIN v USING (source) GROUP BY ALL), m AS (SELECT e.source, dim, avg(x) AS m FROM e JOIN p USING (target) GROUP BY ALL)"""


#: A vector in one row: its components, its norm, and a sum in which each component has a weight of its own.
DIGEST = "count(*) AS n_dims, round(sqrt(sum(x * x)), 6) AS norm, round(sum(x * (dim + 1)), 6) AS mixed"


def vector_digest(df: DataFrame, *keys: str) -> DataFrame:
    """``digest`` of whole vectors ``v``, without a row for each component."""
    total = lambda f: F.round(F.aggregate(F.transform("v", f), F.lit(0.0), lambda s, x: s + x), 6)
    return df.select(*keys, F.size("v").cast("long").alias("n_dims"), F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.coalesce(x * x, F.lit(0.0)))), 6).alias("norm"), total(lambda x, k: F.coalesce(x * (k + 1), F.lit(0.0))).alias("mixed"))


def digest(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_dims"), F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("norm"), F.round(F.sum(F.col("x") * (F.col("dim") + 1)), 6).alias("mixed"))


@query(f"{HOP2}, o AS (SELECT source AS node, dim, a.alpha, CASE WHEN v.x IS NULL THEN m ELSE a.alpha * v.x + (1 - a.alpha) * m END AS x FROM m LEFT JOIN v USING (source, dim), (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) a(alpha)) SELECT node, alpha, {DIGEST} FROM o GROUP BY ALL")
def graph_mean_hop2_alpha(s, d):
    """Two rounds over a grid of mixing weights."""
    v = table(s, d, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("v"))
    m = graph.there_and_back(modifies(s, d), v).withColumnRenamed("v", "m").join(v, "node", "left")
    m = m.withColumn("alpha", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    return vector_digest(m.select("node", "alpha", F.coalesce(graph.mixed_with("v", "m", F.col("alpha")), "m").alias("v")), "node", "alpha")


@query("""WITH q AS (SELECT DISTINCT o_orderkey AS qid, o_orderdate AS t, l_partkey AS target FROM orders JOIN lineitem ON l_orderkey = o_orderkey ),
p AS (SELECT DISTINCT qid, q.target, l_orderkey AS source FROM q JOIN lineitem ON l_partkey = q.target WHERE l_shipdate <= t AND l_orderkey <> qid)
SELECT qid, target, support, count(*) AS n_dims, round(sqrt(sum(x * x)), 6) AS norm, round(sum(x * (dim + 1)), 6) AS mixed FROM (SELECT qid, target, dim, avg(x) AS x, count(*) AS support FROM p JOIN (SELECT vec_id, unnest(range(0, len(embedding))) AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings) ON vec_id = source GROUP BY ALL) GROUP BY ALL""")
def asof_cochange_feature(s, d):
    """Every order's parts as they were known when it was placed."""
    li = modifies(s, d)
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("source"), F.col("o_orderdate").alias("t"))
    q = o.join(li.select("source", "target"), "source").select(F.col("source").alias("qid"), F.col("t").alias("time"), "target").distinct()
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("v"))
    return vector_digest(graph.as_of_mean(q, li, v), "qid", "target", "support")


@query(f"WITH {EDGES}, i AS (SELECT target, count(*) AS n FROM e GROUP BY target) SELECT source, count(*) AS n_targets, count(*) FILTER (n = 1) AS n_isolated, bool_or(n > 1) AS reachable FROM e JOIN i USING (target) GROUP BY source")
def isolation_reachability(s, d):
    e = modifies(s, d).select("source", "target").distinct()
    return e.join(graph.isolation(e), "target").groupBy("source").agg(F.count("*").alias("n_targets"), F.count_if("isolated").alias("n_isolated"), F.bool_or(~F.col("isolated")).alias("reachable"))


@query(f"WITH {EDGES}, k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY target) AS k FROM e) SELECT o_orderkey AS seed, count(target) AS n_targets, coalesce(string_agg(target::VARCHAR, ',' ORDER BY k) FILTER (k <= 12), '') AS path FROM orders LEFT JOIN k ON source = o_orderkey GROUP BY o_orderkey")
def subgraph_topk_expand(s, d):
    return graph.expand(table(s, d, "orders").select(F.col("o_orderkey").alias("seed")).distinct(), modifies(s, d))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def semi_anti_lean_snapshot(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey")
    used = table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(used, "o_orderkey", "left_semi").join(table(s, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


GRID = (0.25, 0.5, 0.75)


@query(f"""WITH e AS (SELECT DISTINCT l_orderkey AS source, l_partkey AS target FROM lineitem WHERE l_orderkey IN (SELECT vec_id FROM embeddings)), a(alpha) AS (VALUES {', '.join(f'({x}::DOUBLE)' for x in GRID)}),
b AS (SELECT alpha, vec_id AS source, unnest(range(0, len(embedding))) AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings, a),
t1 AS (SELECT alpha, target, dim, avg(x) AS x FROM e JOIN b USING (source) GROUP BY ALL), m1 AS (SELECT alpha, source, dim, avg(x) AS m FROM e JOIN t1 USING (target) GROUP BY ALL),
h1 AS (SELECT alpha, source, dim, CASE WHEN m IS NULL THEN x ELSE alpha * x + (1 - alpha) * m END AS x FROM b LEFT JOIN m1 USING (alpha, source, dim)),
t2 AS (SELECT alpha, target, dim, avg(x) AS x FROM e JOIN h1 USING (source) GROUP BY ALL), m2 AS (SELECT alpha, source, dim, avg(x) AS m FROM e JOIN t2 USING (target) GROUP BY ALL),
h2 AS (SELECT alpha, source, dim, CASE WHEN m IS NULL THEN x ELSE alpha * x + (1 - alpha) * m END AS x FROM b LEFT JOIN m2 USING (alpha, source, dim)),
w AS (SELECT alpha, hops, source, list(x ORDER BY dim) AS v FROM (SELECT *, 1 AS hops FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY ALL),
r AS (SELECT q.alpha, q.hops, q.source AS qid, c.source AS cand, row_number() OVER (PARTITION BY q.alpha, q.hops, q.source ORDER BY round(list_cosine_similarity(q.v, c.v), 9) DESC, c.source) AS k
  FROM w q JOIN w c ON q.alpha = c.alpha AND q.hops = c.hops AND q.source <> c.source WHERE q.source % 100 = 0),
g AS (SELECT alpha, hops, count(*) AS n, avg((x.label = y.label)::INTEGER) AS r1 FROM r JOIN embeddings x ON x.vec_id = qid JOIN embeddings y ON y.vec_id = cand WHERE k = 1 GROUP BY ALL)
SELECT alpha, hops, n, round(r1, 6) AS r1, alpha = first_value(alpha) OVER (PARTITION BY hops ORDER BY round(r1, 9) DESC, alpha) AS best FROM g""")
def experiment_grid(s, d):
    """Share of query vectors whose nearest neighbour has their label, for each mixing weight and number of rounds, and the best weight of each."""
    e = table(s, d, "embeddings")
    found = graph.nearest_vectors(graph.grid_vectors(modifies(s, d), e.where("embedding IS NOT NULL").select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("v")), list(GRID), 2), "node % 100 = 0", ["alpha", "hops"])
    found = found.join(e.select(F.col("vec_id").alias("qid"), F.col("label").alias("ql")), "qid").join(e.select(F.col("vec_id").alias("cand"), "label"), "cand")
    g = found.groupBy("alpha", "hops").agg(F.count("*").alias("n"), F.avg((F.col("ql") == F.col("label")).cast("int")).alias("r1"))
    first = F.first("alpha").over(Window.partitionBy("hops").orderBy(F.round("r1", 9).desc(), "alpha"))
    return g.select("alpha", "hops", "n", F.round("r1", 6).alias("r1"), (F.col("alpha") == first).alias("best"))


# -- validation ---------------------------------------------------------------------------------------------------------


@query("""SELECT 'error' AS severity, 'id.duplicate' AS code, location FROM (SELECT l_orderkey || ':' || l_linenumber || ':' || lpad(l_partkey::VARCHAR, 9, '0') AS location, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY lpad(l_partkey::VARCHAR, 9, '0')) AS k FROM lineitem) WHERE k > 1""")
def validate_duplicates(s, d):
    """Every line after the first with the same order and number."""
    li = table(s, d, "lineitem").withColumn("location", F.concat_ws(":", "l_orderkey", "l_linenumber", F.lpad("l_partkey", 9, "0")))
    return validation.duplicate_ids(li, ["l_orderkey", "l_linenumber"], "location")


def _dangling(s, d):
    return validation.dangling(table(s, d, "lineitem").select("l_partkey"), "l_partkey", table(s, d, "part").where("p_size > 5"), "p_partkey")


def _temporal(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return validation.temporal(table(s, d, "lineitem").select("l_orderkey", "l_shipdate").join(o, "l_orderkey"), "l_shipdate", "o_orderdate", "l_orderkey")


DANGLING = "SELECT 'error' AS severity, 'ref.dangling' AS code, l_partkey::VARCHAR AS location FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)"
TEMPORAL = "SELECT 'warning' AS severity, 'temporal.inconsistent' AS code, l_orderkey::VARCHAR AS location FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate"


@query(DANGLING)
def validate_dangling(s, d):
    return _dangling(s, d)


@query(TEMPORAL)
def validate_temporal(s, d):
    return _temporal(s, d)


@query("""SELECT 'error' AS severity, 'schema' AS code, event_id::VARCHAR AS location, rule FROM (
SELECT event_id, unnest(list_filter([CASE WHEN user_id IS NULL THEN 'required:user_id' END, CASE WHEN event_type NOT IN ('click', 'view') THEN 'enum:event_type' END, CASE WHEN value NOT BETWEEN 1 AND 50 THEN 'range:value' END,
  CASE WHEN NOT regexp_matches(props, '^[{]"k": *[0-9]{1,2}[}]$') THEN 'pattern:props' END, CASE WHEN len(list_filter(json_keys(props::JSON), lambda k: k <> 'k')) > 0 THEN 'keys:props' END], lambda r: r IS NOT NULL)) AS rule FROM events)""")
def validate_schema(s, d):
    """Events against required fields, allowed values, ranges, patterns and keys."""
    rules = [("user_id", "required", None), ("event_type", "enum", ("click", "view")), ("value", "range", (1, 50)), ("props", "pattern", '^[{]"k": *[0-9]{1,2}[}]$'), ("props", "keys", ("k",))]
    return validation.conformance(table(s, d, "events"), rules, "event_id")


@query("""WITH l AS (SELECT event_id, CASE WHEN event_type = 'click' THEN '[' || props || ']' WHEN value > 50 THEN substr(props, 2) ELSE props END AS line FROM events)
SELECT 'error' AS severity, CASE WHEN line IS NULL OR NOT json_valid(line) THEN 'json' ELSE 'shape' END AS code, event_id::VARCHAR AS location FROM l WHERE line IS NULL OR NOT json_valid(line) OR json_type(CASE WHEN json_valid(line) THEN line END) <> 'OBJECT'""")
def validate_json_shape(s, d):
    """Lines made of the events' properties: arrays for clicks, cut ones for large values."""
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("["), "props", F.lit("]"))).when(F.col("value") > 50, F.expr("substr(props, 2)")).otherwise(F.col("props"))
    return validation.json_shape(table(s, d, "events").withColumn("line", line), "line", "event_id")


@query("""SELECT 'error' AS severity, CASE WHEN r IS NULL THEN 'card.type' ELSE 'schema' END AS code, o_orderkey::VARCHAR AS location, r AS rule FROM (SELECT *, CASE
WHEN o_orderstatus = 'F' AND o_totalprice NOT BETWEEN 1000 AND 200000 THEN 'range:o_totalprice' WHEN o_orderstatus = 'O' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'enum:o_orderpriority' END AS r FROM orders)
WHERE r IS NOT NULL OR o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O')""")
def validate_dispatch(s, d):
    """Orders judged by the rules of their status."""
    rules = {"F": [("o_totalprice", "range", (1000, 200000))], "O": [("o_orderpriority", "enum", ("1-URGENT", "2-HIGH"))]}
    return validation.dispatched(table(s, d, "orders"), "o_orderstatus", rules, "o_orderkey")


@query(f"SELECT severity, code, count(*) AS n FROM ({DANGLING} UNION ALL {TEMPORAL}) GROUP BY ROLLUP (severity, code)")
def findings_rollup(s, d):
    return validation.rollup(_dangling(s, d).union(_temporal(s, d)))


@query("""SELECT user_id, event_id AS query_event, n_future FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) - count(*) OVER (PARTITION BY user_id ORDER BY ts) AS n_future FROM events WHERE ts IS NOT NULL) WHERE n_future > 0""")
def leakage_violations(s, d):
    """For every event as a query: the number of events of its user that lie after it, from running counts by time."""
    e = table(s, d, "events").where("ts IS NOT NULL").select("event_id", "user_id", "ts")
    return e.join(running(e), ["user_id", "ts"]).select("user_id", F.col("event_id").alias("query_event"), (F.col("n_all") - F.col("n_upto")).alias("n_future")).where("n_future > 0")


def running(events: DataFrame, value: str | None = None) -> DataFrame:
    """(user_id, ts, n_upto, n_all[, sum_upto, sum_all]): counts and sums of a user's events up to each time, and of all."""
    x = F.coalesce(F.col(value), F.lit(0.0)) if value else F.lit(0.0)
    at = events.groupBy("user_id", "ts").agg(F.count("*").alias("n"), F.sum(x).alias("x"))
    w = Window.partitionBy("user_id")
    upto = w.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return at.select("user_id", "ts", F.sum("n").over(upto).alias("n_upto"), F.sum("n").over(w).alias("n_all"), F.sum("x").over(upto).alias("sum_upto"), F.sum("x").over(w).alias("sum_all"))


@query("""WITH g AS (SELECT source AS grp, avg(length(text)) AS value, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY source),
r AS (SELECT *, sum(bytes) OVER (ORDER BY value DESC, grp)::BIGINT AS running FROM g) SELECT grp, bytes, running FROM r WHERE running <= (SELECT sum(bytes) * 0.5 FROM g)""")
def size_budget_trim(s, d):
    g = table(s, d, "documents").groupBy(F.col("source").alias("grp")).agg(F.avg(F.length("text")).alias("value"), F.sum(F.octet_length("text")).alias("bytes"))
    half = g.agg((F.sum("bytes") * 0.5).alias("half")).first()["half"]
    return benchmarks.size_budget(g, float(half or 0)).select("grp", "bytes", "running")


# -- fusion and statistics ------------------------------------------------------------------------------------------------

FUSED = f"""{BM25}, {OVERLAP}, f AS (SELECT bm.qid, bm.cand, bm.score AS a, ov.score::DOUBLE AS b FROM bm JOIN ov ON ov.qid = bm.qid AND ov.cand = bm.cand),
z AS (SELECT qid, cand, a, b, coalesce((a - avg(a) OVER w) / nullif(round(stddev_pop(a) OVER w, 12), 0), 0) + coalesce((b - avg(b) OVER w) / nullif(round(stddev_pop(b) OVER w, 12), 0), 0) AS f FROM f WINDOW w AS (PARTITION BY qid))"""


def scored(s: SparkSession, d: str, postings: DataFrame | None = None) -> DataFrame:
    """(qid, cand, a, b): BM25 and overlap of the pairs that share a token, from one pass over the postings, dealt by candidate; neither is written or joined."""
    held = lexical.query_postings(items(s, d), texts(s, d)) if postings is None else postings
    return lexical.bm25(items(s, d), postings=held, shared=True).select("qid", "cand", F.col("score").alias("a"), F.col("shared").cast("double").alias("b"))


def of_candidates(s: SparkSession, d: str) -> DataFrame:
    """``groups`` for a join with pairs that are dealt by candidate: a task has the few candidates of its pairs, so these are hashed and the pairs not sorted."""
    return groups(s, d).hint("shuffle_hash")


def fused(s: SparkSession, d: str, postings: DataFrame | None = None) -> DataFrame:
    held = lexical.query_postings(items(s, d), texts(s, d)) if postings is None else postings
    a = lexical.bm25(items(s, d), postings=held).withColumnRenamed("score", "a")
    b = lexical.overlap(items(s, d), postings=held).select("qid", "cand", F.col("score").cast("double").alias("b"))
    return ranking.late_fusion(a, b)


@query(f"WITH {FUSED}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(f, 9) DESC, cand) AS rank FROM z) SELECT qid, cand, round(f, 5) AS score, rank FROM r WHERE rank <= 5")
def late_fusion_zscore(s, d):
    return ranking.ranked(fused(s, d), 5, by="f").select("qid", "cand", F.round("f", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


HITS = f"""{FUSED}, {GOLD}, ra AS (SELECT qid, cand FROM (SELECT qid, cand, row_number() OVER (PARTITION BY qid ORDER BY round(a, 9) DESC, cand) AS k FROM z) WHERE k = 1),
rb AS (SELECT qid, cand FROM (SELECT qid, cand, row_number() OVER (PARTITION BY qid ORDER BY round(b, 9) DESC, cand) AS k FROM z) WHERE k = 1),
h AS (SELECT qid, max(CASE WHEN ra.cand IS NULL THEN 0 ELSE 1 END) AS ha, max(CASE WHEN rb.cand IS NULL THEN 0 ELSE 1 END) AS hb FROM gold LEFT JOIN ra USING (qid, cand) LEFT JOIN rb USING (qid, cand) GROUP BY qid)"""


def hits_and_gold(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(qid, ha, hb): whether BM25's and the overlap's first candidate is relevant; and the relevant ones.

    Both score the same pairs in one pass, and only the first of a query is wanted, so neither scores nor their fusion are written or sorted.
    """
    held = lexical.query_postings(items(s, d), texts(s, d))
    g = gold(s, d, held)
    top = materialise(ranking.first(lexical.bm25(items(s, d), postings=held, shared=True), "score", "shared"), "first")
    hit = lambda c: F.max(F.coalesce((F.col("cand") == F.col(c)).cast("int"), F.lit(0)))
    return g.join(lexical.bounded(top), "qid", "left").groupBy("qid").agg(hit("score").alias("ha"), hit("shared").alias("hb")), g


def hits(s: SparkSession, d: str) -> DataFrame:
    return hits_and_gold(s, d)[0]


@query(f"WITH {HITS} SELECT count(*) FILTER (ha = 1 AND hb = 1) AS both, count(*) FILTER (ha = 1 AND hb = 0) AS bm25_only, count(*) FILTER (ha = 0 AND hb = 1) AS overlap_only, count(*) FILTER (ha = 0 AND hb = 0) AS neither FROM h")
def complementarity(s, d):
    return hits(s, d).agg(*(F.count_if(F.expr(c)).alias(n) for n, c in (("both", "ha = 1 AND hb = 1"), ("bm25_only", "ha = 1 AND hb = 0"), ("overlap_only", "ha = 0 AND hb = 1"), ("neither", "ha = 0 AND hb = 0"))))


DRAW = H32.format("'11|' || b || '|' || i")


@query(f"""WITH {HITS}, x AS (SELECT row_number() OVER (ORDER BY qid) - 1 AS ix, (ha - hb)::DOUBLE AS delta FROM h), n AS (SELECT count(*) AS n FROM x),
m AS (SELECT b, avg(delta) AS m FROM (SELECT b, {DRAW} % n AS ix FROM range(0, 10000) t(b), n, range(0, 100000) r(i) WHERE i < n) JOIN x USING (ix) GROUP BY b)
SELECT round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi, round(avg(CASE WHEN round(m, 9) <= 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS p_le_0, round(avg(CASE WHEN round(m, 9) > 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS frac_positive FROM m""")
def bootstrap_ci_query(s, d):
    x = hits(s, d).select((F.row_number().over(Window.orderBy("qid")) - 1).cast("long").alias("ix"), (F.col("ha") - F.col("hb")).cast("double").alias("delta"))  # a row for each benchmark query
    return ranking.bootstrap(materialise(x, "x"), 10_000, 11).select(*(F.round(c, 6).alias(c) for c in ("lo", "hi", "p_le_0", "frac_positive")))


@query(f"WITH {HITS} SELECT count(*) AS n, count(*) FILTER (ha > hb) AS gains, count(*) FILTER (ha < hb) AS losses, round(1.96 * coalesce(stddev_samp(ha - hb), 0) / sqrt(count(*)) + 0.8416 * coalesce(stddev_samp(ha - hb), 0) / sqrt(count(*)), 6) AS mde FROM h")
def sign_test_mde(s, d):
    """Flips between two systems and the minimum detectable effect of their paired difference."""
    diff = F.col("ha") - F.col("hb")
    sd = F.coalesce(F.stddev_samp(diff), F.lit(0.0)) / F.sqrt(F.count("*"))
    return hits(s, d).agg(F.count("*").alias("n"), F.count_if(diff > 0).alias("gains"), F.count_if(diff < 0).alias("losses"), F.round(1.96 * sd + 0.8416 * sd, 6).alias("mde"))


@query(f"""WITH {HITS}, flips AS (SELECT count(*) FILTER (ha > hb) AS gains, count(*) FILTER (ha < hb) AS losses FROM h)
SELECT gains, losses, round(least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, least(gains, losses) + 1), lambda k: exp(lgamma(gains + losses + 1.0) - lgamma(k + 1.0) - lgamma(gains + losses - k + 1.0) - (gains + losses) * ln(2))))), 6) AS p FROM flips""")
def sign_test_flips(s, d):
    """Exact two-sided sign test of the flips between two systems."""
    out = hits(s, d).agg(F.count_if(F.col("ha") > F.col("hb")).alias("gains"), F.count_if(F.col("ha") < F.col("hb")).alias("losses"))
    return out.select("gains", "losses", F.round(ranking.sign_test(F.col("gains"), F.col("losses")), 6).alias("p"))


@query("SELECT source AS grp, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY source")
def label_precision_audit(s, d):
    j = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "source"), "doc_id")
    return j.groupBy(F.col("source").alias("grp")).agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling_daily(s, d):
    """Extension: a tumbling window."""
    w = table(s, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("day"), "event_type", "n", "total")


# -- more rankings and statistics ---------------------------------------------------------------------------------------------


@query(f"""WITH {OVERLAP}, a AS (SELECT item_id AS qid, len(list_distinct({TOK.format('text')})) AS na FROM benchmark), b AS (SELECT doc_id AS cand, len(list_distinct({TOK.format('text')})) AS nb FROM documents),
j AS (SELECT qid, cand, score / (na + nb - score) AS j FROM ov JOIN a USING (qid) JOIN b USING (cand)), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(j, 9) DESC, cand) AS rank FROM j)
SELECT qid, cand, round(j, 6) AS score, rank FROM r WHERE rank <= 5""")
def jaccard_rank(s, d):
    a = items(s, d).select("qid", F.size(F.array_distinct(T.tokens("text"))).alias("na"))
    b = texts(s, d).select("cand", F.size(F.array_distinct(T.tokens("text"))).alias("nb"))
    j = lexical.overlap(items(s, d), texts(s, d)).join(lexical.bounded(a), "qid").join(b, "cand")
    return _top5(j.select("qid", "cand", (F.col("score") / (F.col("na") + F.col("nb") - F.col("score"))).alias("score")))


@query(f"""WITH {BM25}, {OVERLAP}, a AS (SELECT item_id AS qid, len(list_distinct({TOK.format('text')})) AS na FROM benchmark), b AS (SELECT doc_id AS cand, len(list_distinct({TOK.format('text')})) AS nb FROM documents),
j AS (SELECT qid, cand, ov.score AS n, ov.score / (na + nb - ov.score) + 0.001 * bm.score AS c FROM ov JOIN bm USING (qid, cand) JOIN a USING (qid) JOIN b USING (cand)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, round(c, 9) DESC, cand) AS rank FROM j) SELECT qid, cand, n, round(c, 6) AS score, rank FROM r WHERE rank <= 5""")
def static_combo(s, d):
    """Ranks by shared tokens, then by Jaccard similarity and a thousandth of BM25."""
    a = items(s, d).select("qid", F.size(F.array_distinct(T.tokens("text"))).alias("na"))
    b = texts(s, d).select("cand", F.size(F.array_distinct(T.tokens("text"))).alias("nb"))
    held = lexical.query_postings(items(s, d), texts(s, d))
    j = lexical.overlap(items(s, d), postings=held).withColumnRenamed("score", "n").join(lexical.bm25(items(s, d), postings=held), ["qid", "cand"]).join(a, "qid").join(b, "cand")
    j = j.withColumn("c", F.col("n") / (F.col("na") + F.col("nb") - F.col("n")) + 0.001 * F.col("score"))
    w = Window.partitionBy("qid").orderBy(F.col("n").desc(), F.round("c", 9).desc(), "cand")
    return j.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select("qid", "cand", "n", F.round("c", 6).alias("score"), "rank")


STOP = "[" + ", ".join(f"'{w}'" for w in T.PATH_STOPWORDS) + "]"
PATH = f"list_filter(list_distinct({TOK.format('url')}), lambda t: length(t) > 1 AND NOT list_contains({STOP}, t))"


@query(f"""WITH p AS (SELECT page_id, split_part(url, '/', 3) AS host, {PATH} AS ts FROM pages WHERE url IS NOT NULL),
x AS (SELECT a.page_id AS qid, b.page_id AS cand, len(list_intersect(a.ts, b.ts)) AS n, len(list_intersect(a.ts, b.ts)) / nullif(len(list_distinct(list_concat(a.ts, b.ts))), 0) AS j
  FROM p a JOIN p b ON a.host = b.host AND a.page_id <> b.page_id WHERE a.page_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, round(j, 9) DESC, cand) AS rank FROM x) SELECT qid, cand, n, round(j, 6) AS j, rank FROM r WHERE rank <= 5""")
def path_proximity(s, d):
    """Every hundredth page as a stated query set against all pages of its host: by shared path tokens, then Jaccard."""
    p = table(s, d, "pages").where("url IS NOT NULL").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), T.path_tokens("url").alias("ts"))
    q = p.where("page_id % 100 = 0").select(F.col("page_id").alias("qid"), "host", F.col("ts").alias("qs"))
    x = p.join(q, "host").where("page_id <> qid").select("qid", F.col("page_id").alias("cand"), F.size(F.array_intersect("ts", "qs")).cast("long").alias("n"), F.size(F.array_union("ts", "qs")).alias("u"))
    x = x.withColumn("j", F.try_divide("n", "u"))
    w = Window.partitionBy("qid").orderBy(F.col("n").desc(), F.round("j", 9).desc(), "cand")
    return x.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select("qid", "cand", "n", F.round("j", 6).alias("j"), "rank")


CDRAW = H32.format("'13|' || b || '|' || i")


@query(f"""WITH {HITS}, c AS (SELECT source, sum(ha - hb)::DOUBLE AS sd, count(*) AS nq FROM h JOIN (SELECT qid, min(source) AS source FROM gold JOIN documents ON doc_id = cand GROUP BY qid) USING (qid) GROUP BY source),
x AS (SELECT row_number() OVER (ORDER BY source) - 1 AS ix, sd, nq FROM c), n AS (SELECT count(*) AS n FROM x),
m AS (SELECT b, sum(sd) / sum(nq) AS m FROM (SELECT b, {CDRAW} % n AS ix FROM range(0, 10000) t(b), n, range(0, 100000) r(i) WHERE i < n) JOIN x USING (ix) GROUP BY b)
SELECT round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m""")
def bootstrap_ci_cluster(s, d):
    """Resamples groups instead of queries."""
    h, g = hits_and_gold(s, d)
    grp = g.join(groups(s, d), "cand").groupBy("qid").agg(F.min("grp").alias("grp"))
    c = h.join(grp, "qid").groupBy("grp").agg(F.sum(F.col("ha") - F.col("hb")).cast("double").alias("sd"), F.count("*").alias("nq"))
    x = materialise(c.select((F.row_number().over(Window.orderBy("grp")) - 1).cast("long").alias("ix"), "sd", "nq"), "x")  # a row for each group
    n = x.count()
    draws = s.range(10_000).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("i")).select("b", F.pmod(T.hash_order(13, "b", "i"), F.lit(max(n, 1))).alias("ix"))
    m = draws.join(x, "ix").groupBy("b").agg((F.sum("sd") / F.sum("nq")).alias("m"))
    return m.agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("lo"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("hi"))


@query(f"""WITH {EDGES}, v AS (SELECT vec_id FROM embeddings), c AS (SELECT DISTINCT target FROM e WHERE source IN (SELECT vec_id FROM v))
SELECT o_orderkey % 10 AS bucket, count(*) AS n_edges, count(c.target) AS n_covered, round(count(c.target) / count(*), 6) AS coverage FROM orders JOIN e ON e.source = o_orderkey LEFT JOIN c ON c.target = e.target GROUP BY 1""")
def coverage_fair_rank(s, d):
    """Share of each bucket's edges whose target has a feature from any embedded source."""
    e = modifies(s, d).select("source", "target").distinct()
    c = e.join(table(s, d, "embeddings").select(F.col("vec_id").alias("source")), "source", "left_semi").select("target").distinct().withColumn("has", F.lit(1))
    x = table(s, d, "orders").select(F.col("o_orderkey").alias("source")).join(e, "source").join(c, "target", "left")
    return x.groupBy((F.col("source") % 10).alias("bucket")).agg(F.count("*").alias("n_edges"), F.count("has").alias("n_covered"), F.round(F.count("has") / F.count("*"), 6).alias("coverage"))


@query("""WITH w AS (SELECT event_id, value, count(*) OVER u AS n_all, count(*) OVER p AS n_asof, sum(value) OVER u AS s_all, sum(value) OVER p AS s_asof FROM events WHERE ts IS NOT NULL AND value IS NOT NULL
  WINDOW u AS (PARTITION BY user_id), p AS (PARTITION BY user_id ORDER BY ts))
SELECT event_id AS qid, n_all - 1 AS n_all, n_asof - 1 AS n_asof, round(coalesce((s_asof - value) / nullif(n_asof - 1, 0), 0), 9) AS mean_asof, round((s_all - value) / (n_all - 1), 9) AS mean_leaky FROM w WHERE n_all > 1""")
def asof_vs_leaky_metrics(s, d):
    """A feature from earlier evidence alone, and the same with leakage, for every event as a query."""
    e = table(s, d, "events").where("ts IS NOT NULL AND value IS NOT NULL").select("event_id", "user_id", "ts", "value")
    x = e.join(running(e, "value"), ["user_id", "ts"]).where("n_all > 1")
    asof = F.coalesce(F.try_divide(F.col("sum_upto") - F.col("value"), F.col("n_upto") - 1), F.lit(0.0))
    return x.select(F.col("event_id").alias("qid"), (F.col("n_all") - 1).alias("n_all"), (F.col("n_upto") - 1).alias("n_asof"), F.round(asof, 9).alias("mean_asof"), F.round((F.col("sum_all") - F.col("value")) / (F.col("n_all") - 1), 9).alias("mean_leaky"))


@query()
def lr_rerank_loro(s, d):
    """BM25 and overlap reranked by logistic regression with groups held out."""
    from relquill.operators.learned import leave_one_group_out

    held = lexical.query_postings(items(s, d), texts(s, d))
    relevant = lexical.bounded(gold(s, d, held).withColumn("y", F.lit(1)))
    x = scored(s, d, held).join(of_candidates(s, d), "cand").join(relevant, ["qid", "cand"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    return ranking.ranked(leave_one_group_out(x, ["a", "b"]), 5, by="p").select("qid", "cand", "y", F.round("p", 6).alias("p"), "rank")


@query()
def relation_metric_train(s, d):
    """Weights of tokens that tell positives from hard negatives."""
    from relquill.operators.learned import relation_metric

    held = lexical.query_postings(items(s, d), texts(s, d), norms=True)
    relevant = gold(s, d, held)
    hard = benchmarks.mine_hard_negatives(lexical.overlap(items(s, d), postings=held), relevant, groups(s, d)).select("qid", F.col("cand").alias("neg"))
    pairs = materialise(relevant.withColumnRenamed("cand", "pos").join(hard, "qid"), "pairs")
    q = lexical.terms(items(s, d))
    q = q.join(q.groupBy("qid").agg(F.sqrt(F.sum(F.col("qtf") * F.col("qtf"))).alias("norm")), "qid").select("qid", "tok", (F.col("qtf") / F.col("norm")).alias("u"))
    v = held.where("tok IS NOT NULL").select("cand", "tok", (F.col("tf") / F.sqrt("square")).alias("x"))
    trip = F.concat_ws("|", "qid", "pos", "neg").alias("trip")
    one = lambda side, sign: pairs.join(q, "qid").join(v.withColumnRenamed("cand", side), [side, "tok"]).select(trip, "tok", (sign * F.col("u") * F.col("x")).alias("x"))
    both = one("pos", 1).union(one("neg", -1)).groupBy("trip", "tok").agg(F.sum("x").alias("diff"))
    return relation_metric(both)
