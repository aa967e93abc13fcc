"""Steps whose rows must not grow faster than the input, against plain ways to the same results."""

import random

from pyspark.sql import functions as F

from relquill.operators import dense


def test_products_in_tiles_equal_all_pairs(spark, monkeypatch):
    """Several tiles; ties, repeated, null and shorter vectors; a query without candidates of its key."""
    rng = random.Random(5)
    monkeypatch.setattr(dense, "TILE_CANDIDATES", 7)
    monkeypatch.setattr(dense, "TILE_QUERIES", 3)
    monkeypatch.setattr(dense, "TILE_ROWS", 2)
    vectors = [(k, [float(rng.randint(-2, 2)) for _ in range(4)]) for k in range(30)] + [(30, None), (31, [1.0, None, 0.0, 1.0]), (32, [1.0, 2.0])]
    rows = [(g, k, v) for g in (1, 2) for k, v in vectors if g == 1 or k % 2]
    v = spark.createDataFrame(rows, "g int, cand int, v array<double>")
    q = v.where("cand % 4 = 0 OR cand = 31").select("g", F.col("cand").alias("qid"), F.col("v").alias("qv")).union(spark.createDataFrame([(3, 1, [0.0] * 4)], "g int, qid int, qv array<double>"))
    got = {(r["g"], r["qid"], r["rank"]): (r["cand"], r["score"]) for r in dense.searched_dot(q, v, 29, ("g",)).collect()}
    want = {}
    for g, qid, a in {(r["g"], r["qid"], tuple(r["qv"] or ())) for r in q.where("g < 3").collect()}:
        fits = lambda b: a and b and len(a) == len(b) and None not in (*a, *b)  # noqa: B023, E731
        scored = [(sum(x * y for x, y in zip(a, b, strict=True)) if fits(b) else None, k) for h, k, b in rows if h == g and k != qid]
        for rank, (s, k) in enumerate(sorted(scored, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))[:29], 1):
            want[g, qid, rank] = (k, s)
    assert got == want


def test_chunks_in_tiles_equal_scores_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(dense, "TILE_CANDIDATES", 3)
    monkeypatch.setattr(dense, "TILE_ROWS", 2)
    rng = random.Random(6)
    unit = lambda: [float(rng.randint(-3, 3)) / 4 for _ in range(3)]
    chunks = spark.createDataFrame([(d, k, unit()) for d in range(12) for k in range(d % 4 + 1)] + [(12, None, None), (13, 0, [0.0] * 3), (14, 0, None), (14, 1, unit())], "cand int, chunk_ix int, v array<double>")
    queries = spark.createDataFrame([(k, unit(), k if k % 2 else None) for k in range(5)], "qid int, q array<double>, own int")
    got = {(r["qid"], r["by"], r["rank"]): (r["cand"], *(round(r[a], 9) for a in dense.AGGREGATORS)) for r in dense.chunks_searched(queries, chunks, 4).collect()}
    pairs = chunks.join(queries, F.coalesce("own", F.lit(-1)) != F.col("cand"))
    rows = [(r["qid"], (r["cand"], *(round(r[a], 9) for a in dense.AGGREGATORS))) for r in dense.chunk_scores(pairs).collect()]
    want = {}
    for qid in range(5):
        for n, a in enumerate(dense.AGGREGATORS, 1):
            for rank, x in enumerate(sorted((x for k, x in rows if k == qid), key=lambda x: (-x[n], x[0]))[:4], 1):
                want[qid, a, rank] = x
    assert got == want


def test_ranks_of_relevant_by_bands(spark):
    """Many relevant candidates, ties across them, a query of equal scores; the plan has no pair of a candidate and each relevant one."""
    from relquill.operators import ranking

    rng = random.Random(7)
    scores = [(q, c, float(rng.randint(0, 30)) / 3 if q else 1.0) for q in range(4) for c in range(200)]
    relevant = [(q, c) for q in range(4) for c in range(200) if rng.random() < 0.5] + [(9, 1)]
    df = spark.createDataFrame(scores, "qid int, cand int, score double")
    out = ranking.gold_ranks(df, spark.createDataFrame(relevant, "qid int, cand int"))
    want = {(q, c): k for p in range(4) for k, (_, q, c) in enumerate(sorted((-s, q, c) for q, c, s in scores if q == p), 1)}
    assert {(r["qid"], r["cand"]): r["rank"] for r in out.collect()} == {x: want[x] for x in relevant if x in want}
    assert "relevant" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["qid"]: r["score"] for r in ranking.first(df, "score").collect()} == {q: min((-s, c) for p, c, s in scores if p == q)[1] for q in range(4)}


def test_products_are_dealt_by_their_pairs(spark, monkeypatch):
    """The partitions of a pair's products grow with documents and queries, and a text's counts need no shuffle after it is dealt."""
    from relquill.operators import lexical

    monkeypatch.setattr(lexical, "TASK_PAIRS", 10)
    q = spark.createDataFrame([(k, f"a{k} b") for k in range(5)], "qid int, text string")
    d = spark.createDataFrame([(k, f"a{k % 5} b c") for k in range(40)], "cand int, text string")
    held = lexical.query_postings(q, d)
    assert lexical.dealt(held, q).rdd.getNumPartitions() == 20
    rows = {(r["qid"], r["cand"]): (r["score"], r["shared"]) for r in lexical.bm25(q, postings=held, shared=True).collect()}
    assert {k: n for k, (_, n) in rows.items()} == {(r["qid"], r["cand"]): r["score"] for r in lexical.overlap(q, postings=held).collect()}
    assert {k: round(x, 9) for k, (x, _) in rows.items()} == {(r["qid"], r["cand"]): round(r["score"], 9) for r in lexical.bm25(q, d).collect()}


def test_edges_without_vectors_are_left_before_any_shuffle(spark):
    """Nodes that no vector reaches have no row; the graph's rows meet the few nodes with vectors first, as whole vectors."""
    from relquill.operators import graph

    edges = [("o1", "c1", "x"), ("o2", "c1", "x"), ("o2", "p1", "y"), ("o8", "c8", "x"), ("o8", "p8", "y")]
    e = spark.createDataFrame(edges + edges[:2], "source string, target string, role string")
    base = spark.createDataFrame([("o1", [2.0, 4.0]), ("o9", [1.0])], "node string, v array<double>")
    got = {r["node"]: r["v"] for r in graph.seeded(e, base).collect()}
    assert got == {"o1": [2.0, 4.0], "o9": [1.0], "c1": [2.0, 4.0], "o2": [2.0, 4.0], "p1": [2.0, 4.0]}
    near = graph.near(e, base)
    assert {tuple(r) for r in near.collect()} == {("c1", "o1", "x")}
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_grid_of_weights_takes_its_rounds_once(spark, monkeypatch):
    """Against plain rounds for each weight; nodes without edges or neighbours, repeated nodes, null and missing components."""
    from relquill.operators import graph

    edges = [(0, 7), (1, 7), (1, 8), (2, 8), (2, 8), (3, 9), (None, 7), (4, None), (5, 7)]
    base = [(0, [1.0, 2.0, 4.0]), (1, [3.0, None, 5.0]), (2, [-1.0, 6.0]), (3, [2.0, 2.0, 2.0]), (4, [1.0, 1.0, 1.0]), (5, [0.5, 7.0, 1.0]), (5, [2.5, None, 9.0]), (6, [8.0, 8.0, 8.0])]
    calls, there_and_back = [], graph.there_and_back
    monkeypatch.setattr(graph, "there_and_back", lambda *a: calls.append(1) or there_and_back(*a))
    e, b = spark.createDataFrame(edges, "source int, target int"), spark.createDataFrame(base, "node int, v array<double>")
    out = graph.grid_vectors(e, b, [0.25, 0.5, 1.0], 3)
    got = sorted(((r["alpha"], r["hops"], r["node"], r["v"]) for r in out.collect()), key=repr)
    assert len(calls) == 3
    own = {x for x in edges if None not in x}
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    over = lambda vs: [mean([v[k] for v in vs if k < len(v) and v[k] is not None]) for k in range(3)]
    want = []
    for alpha in (0.25, 0.5, 1.0):
        now = base
        for k in (1, 2, 3):
            there = {t: over([v for n, v in now if (n, t) in own]) for _, t in own}
            back = {n: over([there[t] for m, t in own if m == n]) for n, _ in base if any(m == n for m, _ in own)}
            now = [(n, [x if n not in back or x is None else alpha * x + (1 - alpha) * m for x, m in zip(v, back.get(n, v), strict=False)]) for n, v in base]
            want += [(alpha, k, n, v) for n, v in now]
    near = lambda rows: sorted(((*x[:3], tuple(y if y is None else round(y, 9) for y in x[3])) for x in rows), key=repr)
    assert near(got) == near(want)


def test_norms_are_computed_once_for_a_vector(spark):
    """A vector of 30,000 components takes as many steps, not their square; a projection reads its vector once, not for each row."""
    import time

    rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda k: k.cast("double")).alias("v"))
    begun = time.monotonic()
    got = rows.select(dense.unit(F.col("v")).alias("v")).select(F.size("v").alias("n"), dense.dot(F.col("v"), F.col("v")).alias("square")).first()
    assert got["n"] == 30_000 and abs(got["square"] - 1) < 1e-9 and time.monotonic() - begun < 8
    odd = spark.createDataFrame([(0, [0.0, 0.0]), (1, None), (2, [3.0, None]), (3, [3.0, 4.0]), (4, [])], "k int, v array<double>").select("k", dense.unit(F.col("v")).alias("v"))
    assert {r["k"]: r["v"] for r in odd.collect()} == {0: [0.0, 0.0], 1: None, 2: [0.0, 0.0], 3: [0.6, 0.8], 4: []}


def test_a_projection_reads_its_vector_once(spark):
    """The vector, which may be an expression, stands once and outside what runs for each row of the matrix."""
    text = str(dense.projected(F.col("vec"), [[1.0, 2.0], [0.0, 1.0], [1.0, 1.0]]))
    assert text.count("vec") == 1 and "array(vec)" in text
    rows = spark.createDataFrame([(0, [3.0, 4.0]), (1, None), (2, [0.0, 0.0])], "k int, vec array<double>")
    got = {r["k"]: r["v"] for r in rows.select("k", dense.projected(dense.unit(F.col("vec")), [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]).alias("v")).collect()}
    assert [round(x, 12) for x in got[0]] == [0.6, 0.8, 0.0] and got[2] == [0.0, 0.0, 0.0]
    assert got[1] == [0.0, 0.0, 0.0]  # products with null count as 0


def test_found_changes_meet_the_edges_before_any_shuffle(spark):
    """Edges of changes that weren't found go in the scan; the search is made once, however often its result is read."""
    from relquill.operators import graph
    from relquill.plans import structure

    ranked = spark.createDataFrame([(1, 1, 5, 0.5), (1, 2, 6, 0.25), (2, 1, 5, 1.0)], "qid int, rank int, cand int, score double")
    edges = spark.createDataFrame([(5, "b", False), (5, "a", False), (5, "a", False), (5, "t", True), (7, "c", False)], "cand int, path string, is_test boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = graph.subgraph(ranked, edges, 1)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert {(r["qid"], r["cand"], *r["files"], "|", *r["tests"]) for r in out.collect()} == {(1, 5, "a", "|", "t"), (1, 6, "|"), (2, 5, "a", "|", "t")}
        found = structure.found_subgraph(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    semi = [line for p in (plan, found) for line in p.splitlines() if "LeftSemi" in line]
    assert semi and all("BroadcastHashJoin" in line for line in semi)
    assert "CoGroups" not in found


def test_drawn_pools_hash_each_stratum_once(spark):
    """No condition computes a hash again; repeated and excluded candidates go, and the rest is numbered, after one shuffle of the drawn rows."""
    from relquill.functions.text import hash_order, hash_text
    from relquill.operators import benchmarks

    own = spark.createDataFrame([(g, q, c) for q in range(40) for g in {q % 5, q % 3} for c in range(q % 7, 60, 3)], "grp int, qid int, cand int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = benchmarks.drawn(own, own, own, 8, 2)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        physical = out._jdf.queryExecution().executedPlan().toString().splitlines()
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows and not [line for line in plan.splitlines() if "Filter" in line and "md5" in line]
    last = next(k for k, line in enumerate(physical) if "Join" in line)
    above = next(k for k, line in enumerate(physical) if "Union" in line)
    assert above < last and sum("Exchange" in line for line in physical[:above]) == 1
    same = spark.range(3000).select(hash_order(5, "id").alias("n"), hash_text(5, "id").alias("t"))
    assert [r["n"] for r in same.orderBy("t").collect()] == [r["n"] for r in same.orderBy("n").collect()]
