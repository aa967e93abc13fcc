"""Queries on paired outcomes, splits and learned rankers, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from relquill.operators import dense, learned, lexical, ranking, synthetic
from relquill.plans.catalogue import H32, HITS, groups, hits, hits_and_gold, of_candidates, query, scored
from relquill.sources.tables import materialise, table

FIRST = f"{HITS}, gs AS (SELECT qid, min(source) AS source FROM gold JOIN documents ON doc_id = cand GROUP BY qid)"
CDF = "CASE WHEN {x} >= 0 THEN 1 - {p} / 2 ELSE {p} / 2 END"


def _tail(x: str) -> str:
    """The complement of the error function at |x| / sqrt(2), by the same approximation."""
    z, t = f"(abs({x}) / sqrt(2))", f"(1 / (1 + 0.3275911 * abs({x}) / sqrt(2)))"
    return f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-{z} * {z}))"


X = "(abs(delta) * sqrt(n) / sd - 1.959963985)"


@query(f"""WITH {HITS}, a AS (SELECT count(*) AS n, avg(ha - hb) AS delta, coalesce(stddev_samp(ha - hb), 0) AS sd, count(*) FILTER (ha > hb) AS gains, count(*) FILTER (ha < hb) AS losses FROM h)
SELECT n, round(delta, 6) AS delta, round(sd, 6) AS sd, round(CASE WHEN sd > 0 THEN 2.801585219 * sd / sqrt(n) ELSE 0 END, 6)::DOUBLE AS mde, round(CASE WHEN sd > 0 THEN {CDF.format(x=X, p=_tail(X))} ELSE 1 END, 5)::DOUBLE AS power, gains, losses,
abs(delta) >= CASE WHEN sd > 0 THEN 2.801585219 * sd / sqrt(n) ELSE 0 END AS detectable FROM a""")
def paired_power(s, d):
    """Minimum detectable effect and achieved power of the difference of two systems."""
    out = ranking.power(hits(s, d), "ha", "hb")
    return out.select("n", F.round("delta", 6).alias("delta"), F.round("sd", 6).alias("sd"), F.round("mde", 6).alias("mde"), F.round("power", 5).alias("power"), "gains", "losses", "detectable")


def grouped_hits(s, d):
    h, g = hits_and_gold(s, d)
    grp = g.join(groups(s, d), "cand").groupBy("qid").agg(F.min("grp").alias("grp"))
    return h.join(grp, "qid")


@query(f"""WITH {FIRST} SELECT source AS grp, count(*) AS n, round(avg(ha), 6) AS mean_a, round(avg(hb), 6) AS mean_b, round(avg(ha - hb), 6) AS delta, CASE WHEN round(avg(ha - hb), 12) > 0 THEN 'improved' WHEN round(avg(ha - hb), 12) < 0 THEN 'regressed' ELSE 'equal' END AS verdict
FROM h JOIN gs USING (qid) GROUP BY source""")
def group_deltas(s, d):
    """Both systems by group, and which groups improved."""
    out = ranking.group_deltas(grouped_hits(s, d), "grp", "ha", "hb")
    return out.select("grp", "n", *(F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "delta")), "verdict")


@query(f"WITH {HITS} SELECT round(avg(hb) FILTER (ha = 0), 6) AS recovered, count(*) FILTER (ha = 0) AS n_wrong, round(avg(ha) FILTER (hb = 0), 6) AS kept FROM h")
def fallback_recovery(s, d):
    """How often the second system is right where the first is wrong."""
    return hits(s, d).agg(F.round(F.avg(F.when(F.col("ha") == 0, F.col("hb"))), 6).alias("recovered"), F.count_if(F.col("ha") == 0).alias("n_wrong"), F.round(F.avg(F.when(F.col("hb") == 0, F.col("ha"))), 6).alias("kept"))


SPLIT = f"""sp AS (SELECT s AS seed, source FROM (SELECT s, source, row_number() OVER (PARTITION BY s ORDER BY {H32.format("s || '|' || source")}, source) AS k, count(*) OVER (PARTITION BY s) AS n FROM (SELECT DISTINCT source FROM documents), range(100, 105) t(s)) WHERE k > floor(n * 0.6)),
by_seed AS (SELECT seed, config, avg(v) AS v FROM (SELECT seed, unnest(['bm25', 'overlap', 'either']) AS config, unnest([ha, hb, greatest(ha, hb)]) AS v FROM h JOIN gs USING (qid) JOIN sp USING (source)) GROUP BY ALL)"""


def by_seed(s, d):
    """(seed, config, v): R@1 of three systems over the test groups of five random splits."""
    from relquill.plans.catalogue import multi_split

    split = multi_split(s, d).where("split = 'test'").select("seed", "grp")
    x = grouped_hits(s, d).join(split, "grp")
    config = F.create_map(F.lit("bm25"), F.col("ha"), F.lit("overlap"), F.col("hb"), F.lit("either"), F.greatest("ha", "hb"))
    return materialise(x.select("seed", F.explode(config).alias("config", "v")).groupBy("seed", "config").agg(F.avg("v").alias("v")), "seeds")


@query(f"""WITH {FIRST}, {SPLIT}, g AS (SELECT a.*, a.v - b.v AS gap FROM by_seed a LEFT JOIN by_seed b ON b.seed = a.seed AND b.config = 'bm25')
SELECT config, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(avg(gap), 6) AS gap, round(stddev_pop(gap), 6) AS gap_sd, coalesce(bool_and(round(gap, 12) > 0), false) AS all_positive FROM g GROUP BY config""")
def multi_split_summary(s, d):
    """Mean and deviation over splits, and the paired gap to a control."""
    out = ranking.across_splits(by_seed(s, d), "seed", "config", "v", "bm25")
    return out.select("config", "n", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "gap", "gap_sd")), "all_positive")


@query(f"""WITH {FIRST}, {SPLIT}, m AS (SELECT config, avg(v) AS r1, max(v) AS best FROM by_seed GROUP BY config) SELECT m.config, round(m.r1 - c.r1, 6) AS lift_r1, round(m.best - c.best, 6) AS lift_best FROM m, m c WHERE c.config = 'overlap'""")
def system_lifts(s, d):
    """Metrics of each system less those of a control."""
    m = by_seed(s, d).groupBy("config").agg(F.avg("v").alias("r1"), F.max("v").alias("best"))
    return ranking.lifts(m, "config", "overlap", "r1", "best").select("config", F.round("lift_r1", 6).alias("lift_r1"), F.round("lift_best", 6).alias("lift_best"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20")
def first_in_order(s, d):
    """The first twenty rows in a stable order, for rating by hand."""
    return table(s, d, "orders").orderBy("o_orderdate", "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("SELECT 'type' AS part, event_type AS key, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL UNION ALL SELECT 'relation', l_returnflag, count(*) FROM lineitem GROUP BY ALL")
def dataset_counts(s, d):
    """Frequency maps of a dataset card: by type, source and relation."""
    one = lambda name, key, part: table(s, d, name).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "key", "n")
    return one("events", "event_type", "type").union(one("documents", "source", "source")).union(one("lineitem", "l_returnflag", "relation"))


# -- learned rankers ------------------------------------------------------------------------------------------------------------


def labelled_triplets(s, d):
    """Triplets of vectors: even numbers as queries, the next vector of their label as positive, and the next two of other labels as pool."""
    v = dense_vectors(s, d)
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("node"), "label")
    q = e.where("node % 2 = 0").withColumnRenamed("node", "qid")
    block = F.floor(F.col("node") / 40)  # the next forty numbers lie in two blocks
    asked = q.withColumn("first", F.floor((F.col("qid") + 1) / 40)).withColumn("block", F.explode(F.array("first", F.col("first") + 1)))
    near = asked.join(e.withColumnRenamed("label", "other").withColumn("block", block), "block").where(F.col("node").between(F.col("qid") + 1, F.col("qid") + 40))
    pos = near.where("label = other").groupBy("qid").agg(F.min("node").alias("pos"))
    pool = near.where("label <> other").groupBy("qid").agg(F.slice(F.array_sort(F.collect_list("node")), 1, 2).alias("c")).select("qid", F.explode("c").alias("cand"))
    return learned.triplets(pos, pool, v), v


def dense_vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("node"), dense.unit(F.col("embedding").cast("array<double>")).alias("v"))


def nearest_label(s, d, queries, cands):
    """Share of the stated query set (every hundredth vector) whose nearest other vector has their label."""
    top = dense.searched_dot(queries.where("node % 100 = 0").select(F.col("node").alias("qid"), F.col("v").alias("qv")), cands.select(F.col("node").alias("cand"), "v"), 1)
    e = table(s, d, "embeddings")
    out = top.join(e.select(F.col("vec_id").alias("qid"), F.col("label").alias("ql")), "qid").join(e.select(F.col("vec_id").alias("cand"), "label"), "cand")
    return out.agg(F.count("*").alias("n"), F.round(F.avg((F.col("ql") == F.col("label")).cast("int")), 6).alias("r1"))


@query()
def tower_ablation(s, d):
    """Plain cosine, two trained projections and a trained map, on the same query set."""
    trip, v = labelled_triplets(s, d)
    left, right = learned.train_tower(trip, out=16, epochs=100)
    own = learned.train_relation_map(trip, epochs=100)
    project = lambda m: v.select("node", dense.projected(F.col("v"), m.tolist()).alias("v"))
    runs = {"cosine": (v, v), "tower": (project(left), project(right)), "relation_map": (project(own), v)}
    out = None
    for name, (q, c) in runs.items():
        part = nearest_label(s, d, q, c).select(F.lit(name).alias("system"), "n", "r1")
        out = part if out is None else out.union(part)
    return out


@query()
def synthetic_ablation(s, d):
    """The synthetic benchmark's test issues: R@1 of plain cosine, of inverse document frequencies and of a trained metric."""
    return ablation(synthetic.generate(s))


def ablation(data):
    """The same on synthetic ``data``."""
    data = materialise(data, "synthetic")
    pools = materialise(synthetic.pools(data), "pools")
    test = data.where("split = 'test'").select(F.col("n").alias("qid"), F.array_join("issue", " ").alias("text"))
    changes = data.select(F.col("n").alias("cand"), F.array_join("change", " ").alias("text"))
    scores = {"vanilla": lexical.tf_dot(test, changes), "idf": lexical.tf_dot(test, changes, idf=True)}
    unit_tokens = lambda c: data.select("n", F.explode(c).alias("tok"), (1 / F.sqrt(F.size(c))).alias("x"))
    q, p = unit_tokens("issue"), unit_tokens("change")
    train = pools.join(data.where("split = 'train'").select("n"), "n", "left_semi").where("kind <> 'positive'")
    signed = lambda node, sign: train.join(q, "n").join(p.select(F.col("n").alias(node), "tok", F.col("x").alias("y")), [node, "tok"]).select(F.concat_ws("|", "n", "cand").alias("trip"), "tok", (sign * F.col("x") * F.col("y")).alias("diff"))
    positive = train.withColumn("pos", F.col("n")).join(q, "n").join(p.select(F.col("n").alias("pos"), "tok", F.col("x").alias("y")), ["pos", "tok"]).select(F.concat_ws("|", "n", "cand").alias("trip"), "tok", (F.col("x") * F.col("y")).alias("diff"))
    both = positive.union(signed("cand", -1)).groupBy("trip", "tok").agg(F.sum("diff").alias("diff"))
    weight = learned.relation_metric(both)
    own = q.select(F.col("n").alias("qid"), "tok", "x").join(p.select(F.col("n").alias("cand"), "tok", F.col("x").alias("y")), "tok").join(F.broadcast(weight), "tok", "left")
    scores["metric"] = own.groupBy("qid", "cand").agg(F.sum(F.col("x") * F.col("y") * F.coalesce("weight", F.lit(1.0))).alias("score"))
    out = None
    for name, score in scores.items():
        pool = pools.join(data.where("split = 'test'").select("n"), "n", "left_semi").withColumnRenamed("n", "qid")
        first = ranking.ranked(lexical.pooled(score, pool), 1)
        part = first.agg(F.lit(name).alias("system"), F.count("*").alias("n"), F.round(F.avg((F.col("qid") == F.col("cand")).cast("int")), 6).alias("r1"))
        out = part if out is None else out.union(part)
    return out


@query()
def metric_weights(s, d):
    """Weights of a metric trained on the benchmark, by the letters that begin their tokens."""
    from relquill.plans.catalogue import relation_metric_train

    out = learned.weight_summary(relation_metric_train(s, d).withColumn("tok", F.substring("tok", 1, 1)))
    return out.select("prefix", "n", F.round("mean", 6).alias("mean"))


@query(f"""WITH {HITS.replace('f AS (SELECT', 'f AS (SELECT', 1)} SELECT qid, cand, round(a, 6) AS bm25, b::DOUBLE AS overlap, round(ln(1 + count(*) OVER (PARTITION BY cand)), 6) AS log_support, d.source IS NOT NULL AS covered FROM z JOIN documents d ON doc_id = cand""")
def feature_rows(s, d):
    """The reranker's features of each scored pair: both scores, the logarithm of the candidate's support, whether it has a group."""
    support = F.log1p(F.count("*").over(Window.partitionBy("cand")))  # pairs are dealt by candidate already
    return scored(s, d).withColumn("log_support", support).join(of_candidates(s, d), "cand").select("qid", "cand", F.round("a", 6).alias("bm25"), F.col("b").alias("overlap"), F.round("log_support", 6).alias("log_support"), F.col("grp").isNotNull().alias("covered"))


@query(f"""WITH {HITS} SELECT '# bm25 and overlap' || chr(10) || chr(10) || '| metric | value |' || chr(10) || '|-|-|' || chr(10) || '| bm25 R@1 | ' || printf('%.4f', avg(ha)) || ' |' || chr(10) || '| overlap R@1 | ' || printf('%.4f', avg(hb)) || ' |' AS card FROM h""")
def experiment_card(s, d):
    """A card of an experiment's metrics as text."""
    m = hits(s, d).agg(F.avg("ha").alias("a"), F.avg("hb").alias("b"))
    line = lambda name, c: F.concat(F.lit(f"| {name} | "), F.format_string("%.4f", c), F.lit(" |"))
    return m.select(F.concat_ws("\n", F.lit("# bm25 and overlap\n"), F.lit("| metric | value |"), F.lit("|-|-|"), line("bm25 R@1", "a"), line("overlap R@1", "b")).alias("card"))
