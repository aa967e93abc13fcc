"""Hand-computed cases of the operators."""

import pytest
from pyspark.sql import functions as F

from relquill.functions import text as T
from relquill.operators import benchmarks, graph, ranking, validation
from relquill.sources.tables import located_lines, read_json_lines, write_json_lines


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.identifier_tokens(F.lit("normalize_range parseTZ UTC-3"))) == ["normalize", "normalize", "range", "range", "parse", "tz", "parsetz", "utc", "utc", "3", "3"]
    assert one(spark, T.tokens(F.lit("parseTZ date"))) == ["parse", "tz", "date"]
    assert one(spark, T.tokens(F.lit(None).cast("string"))) == []


def test_scrub(spark):
    text = "see #123, gh-7 and owner/repo#9 at https://github.com/o/r/issues/4 (#5) (, ) A1B2C3D4E5F6 deface . x#9 https://other.org/o/r/issues/4"
    assert one(spark, T.scrub_references(F.lit(text))) == "see, and at deface. x#9 https://other.org/o/r/issues/4"
    import re

    texts = [text, "", " \u2003a\u2003. b", "#1#2 é#3 #4é", "v1.2/x#5", "GH-12 gh-1x", "abcdef0 abcdefé1 1234567", "(;) ( , )", "tab\t\tx  y", "\x1cx\x1c"] + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r["text"]]
    got = {r["k"]: r["s"] for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.scrub_references("t").alias("s")).collect()}
    for k, t in enumerate(texts):
        for pattern in T.REFERENCES:
            t = re.sub(re.sub(r"^[(][?](i?)U[)]", r"(?\1u)", pattern), " ", t)
        for pattern, by in ((r"\(\s*[,;]?\s*\)", " "), (r"[ \t]{2,}", " "), (r"\s+([.,;:!?])", r"\1")):
            t = re.sub(pattern, by, t)
        assert got[k] == t.strip()
    assert one(spark, T.scrubbed_record(F.lit("fix #1"), F.lit(None).cast("string"))) == "fix"


def test_chunks(spark):
    assert [len(c) for c in one(spark, T.chunks(F.lit("x" * 1000), 256))] == [256, 256, 256, 256, 184]
    assert one(spark, T.chunks(F.lit("short"), 256)) == ["short"]
    assert one(spark, T.chunks(F.lit(""), 256)) == [""]
    assert [len(c) for c in one(spark, T.chunks(F.lit("x" * 820), 256))] == [256, 256, 256, 208, 4]
    assert one(spark, T.chunks(F.lit("ab" + " " * 8 + "cd"), 4, 0.0)) == ["ab  ", "  cd"]


def test_closing_references(spark):
    assert one(spark, T.closing_references(F.lit("Closes: #18, fixes o/r#9, see #5, resolved gh-7, prefixes #2, Fixes:#6 closes#8"))) == ["18", "9", "7", "6", "8"]
    assert one(spark, T.closing_references(F.lit("Fixes 4, closes: gh-5, fixed#6, resolves o/r#7"), T.AUDITED)) == ["4", "5"]


def test_records(spark):
    content = '{"zeta": "z", "body": "b", "title": "t", "number": 3, "alpha": "a", "code": "", "labels": ["x"], "text": null}'
    assert one(spark, T.record_text(F.lit(content), F.lit("id1"), F.lit("issue"))) == "id1\nissue\nt\nb\na\nz"
    assert one(spark, T.record_text(F.lit("[1]"), F.lit("id1"))) == one(spark, T.record_text(F.lit("{"), F.lit("id1"))) == "id1"
    assert one(spark, T.path_tokens(F.lit("src/dataParser/test_the-mod_x.py"))) == ["data", "parser"]
    assert [str(one(spark, T.iso_time(F.lit(x)))) for x in ("2024-01-02T03:04:05Z", "2024-01-02", "x", "2024-13-01T00:00:00Z")] == ["2024-01-02 03:04:05", "2024-01-02 00:00:00", "None", "None"]
    assert tuple(one(spark, T.identifier_parts(F.lit("gh:o/r:file:a/b:c.py")))) == ("gh", "o/r", "file", "a/b:c.py")
    assert one(spark, T.identifier("pr", F.lit("o/r"), F.lit(7))) == "gh:o/r:pr:7"
    assert [one(spark, T.renamed_space(F.lit(x), "gh", "gh-t2")) for x in ("gh:o/r:pr:1", "ghx:1")] == ["gh-t2:o/r:pr:1", "ghx:1"]
    assert [one(spark, T.kind_of(F.lit(x))) for x in ('{"card_type": 1}', '{"relation": 1}', '{"query_record": 1}', "{}", "[")] == ["card", "edge", "benchmark", "record", None]
    assert [one(spark, T.license_allowed(F.lit(x).cast("string"), ("MIT",), F.lit(c))) for x, c in (("MIT", False), (None, True), ("NOASSERTION", False), ("GPL", True))] == [True, True, False, False]
    import hashlib
    import json

    row = {"a": "é\n\"\U0001f600", "b": None, "c": 3, "d": "plain/|~"}
    want = "sha256:" + hashlib.sha256(json.dumps(row, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert spark.createDataFrame([tuple(row.values())], "a string, b string, c int, d string").select(T.canonical_hash("d", "a", "c", "b").alias("h")).first()["h"] == want


def test_is_test_path(spark):
    for path, strict in (("tests/slider.test.js", True), ("src/latest.py", False), ("src/testing/foo.py", True), ("testdata.json", True), ("a/b_test.go", True), ("a/x.spec.ts", True), ("a/contest/b.py", False)):
        assert one(spark, T.is_test_path(F.lit(path))) == strict
    assert one(spark, T.is_test_path(F.lit("src/latest.py"), strict=False))


def test_metrics(spark):
    ranks = spark.createDataFrame([(1, c, k) for k, c in enumerate("abcd", 1)] + [(2, "z", 1)], "qid int, cand string, rank int")
    gold = spark.createDataFrame([(1, "a"), (1, "d"), (2, "y")], "qid int, cand string")
    rows = {r["qid"]: r for r in ranking.per_query(ranks, gold, (1, 2, 4)).collect()}
    assert (rows[1]["recall_1"], rows[1]["recall_2"], rows[1]["recall_4"], rows[1]["rr"]) == (0.5, 0.5, 1.0, 1.0)
    assert (rows[2]["rr"], rows[2]["hit_4"], rows[2]["ndcg_10"]) == (0.0, 0.0, 0.0)
    hard = spark.createDataFrame([(1, "b"), (2, "z")], "qid int, cand string")
    assert {r["qid"]: r["win"] for r in ranking.hard_negative_wins(ranks, gold, hard).collect()} == {1: 1.0, 2: 0.0}


def test_tie_break(spark):
    scores = spark.createDataFrame([(1, "b", 0.0), (1, "a", 0.0)], "qid int, cand string, score double")
    assert [r["cand"] for r in ranking.ranked(scores).orderBy("rank").collect()] == ["a", "b"]


def test_adjacency_guard_and_hop(spark):
    edges = spark.createDataFrame([("pr0", "f", "m"), ("pr1", "f", "m"), ("pr1", "g", "m")], "source string, target string, role string")
    adj = graph.adjacency(edges, spark.createDataFrame([("g", "pr1")], "a string, b string"))
    assert {(r["a"], r["b"]) for r in adj.collect()} == {("pr0", "f"), ("f", "pr0"), ("pr1", "f"), ("f", "pr1")}
    base = spark.createDataFrame([("pr0", 0, 1.0), ("pr0", 1, 0.0), ("pr1", 0, 0.0), ("pr1", 1, 1.0)], "node string, dim int, x double")
    unit = {(r["node"], r["dim"]): r["x"] for r in graph.augmented(edges, base, 0.5, 1, spark.createDataFrame([("g", "pr1")], "a string, b string")).collect()}
    assert abs(unit["f", 0] - 0.5**0.5) < 1e-12 and abs(unit["f", 1] - 0.5**0.5) < 1e-12 and ("g", 0) not in unit


def slow_aggregate(edges, base, alpha, hops):
    """Typed mean aggregation with dictionaries, nodes without a vector seeded in the order of their ids."""
    adj = {}
    for a, b, role in edges:
        adj.setdefault(a, {}).setdefault(role, set()).add(b)
        adj.setdefault(b, {}).setdefault(role, set()).add(a)
    mean = lambda vs: [sum(x) / len(vs) for x in zip(*vs)]

    def around(n, cur):
        roles = [mean([cur[m] for m in sorted(ms) if m in cur]) for _, ms in sorted(adj.get(n, {}).items()) if any(m in cur for m in ms)]
        return mean(roles) if roles else None

    cur = dict(base)
    for n in sorted(set(adj) | set(base)):
        if n not in base and (v := around(n, cur)):
            cur[n] = v
    for _ in range(hops):
        nxt = {}
        for n in sorted(set(adj) | set(base)):
            v, own = around(n, cur), base.get(n)
            mixed = [alpha * x + (1 - alpha) * y for x, y in zip(own, v)] if own and v else own or v or cur.get(n)
            if mixed:
                nxt[n] = mixed
        cur = nxt
    norm = lambda v: sum(x * x for x in v) ** 0.5 or 1.0
    return {n: [x / norm(v) for x in v] for n, v in cur.items()}


@pytest.mark.parametrize("hops", [1, 2])
def test_aggregation_against_plain_python(spark, hops):
    import random

    r = random.Random(hops)
    nodes = [f"n{k:02d}" for k in range(30)]
    edges = [(*r.sample(nodes, 2), r.choice(["fixes", "modifies"])) for _ in range(35)]
    base = {n: [r.random(), r.random() - 0.5] for n in r.sample(nodes, 6)}
    long = spark.createDataFrame([(n, k, x) for n, v in base.items() for k, x in enumerate(v)], "node string, dim int, x double")
    got = {}
    for row in graph.augmented(spark.createDataFrame(edges, "source string, target string, role string"), long, 0.3, hops).collect():
        got.setdefault(row["node"], {})[row["dim"]] = row["x"]
    want = slow_aggregate(edges, base, 0.3, hops)
    assert got.keys() == want.keys() and all(abs(got[n][k] - want[n][k]) < 1e-9 for n in want for k in (0, 1))


def test_as_of_excludes_own_and_later(spark):
    """Mean vectors of earlier sources against all pairs: ties in time, sources twice, a target with most edges, own sources, nulls."""
    from datetime import datetime, timedelta

    import random

    r = random.Random(4)
    day = lambda: datetime(2024, 1, 1) + timedelta(days=r.randint(0, 6), hours=r.choice([0, 0, 5, 9]))
    edges = [(r.randint(0, 40), r.choice(["hot", "hot", "hot", "a", "b"]), day()) for _ in range(150)] + [(3, "a", None), (99, "b", day())]
    queries = [(r.randint(0, 45), r.choice(["hot", "a", "b", "never"]), day()) for _ in range(120)]
    queries += queries[:5] + [(7, "hot", datetime(2023, 1, 1)), (8, "hot", datetime(2025, 1, 1))]
    vectors = {k: [r.uniform(-1, 1) for _ in range(3)] for k in range(41)}
    want = set()
    for q, t, at in set(queries):
        own = {}
        for s, x, when in edges:
            if x == t and s != q and s in vectors and when is not None and when <= at:
                own[s] = vectors[s]
        if own:
            want.add((q, t, len(own), tuple(round(sum(c) / len(own), 9) for c in zip(*own.values()))))
    q = spark.createDataFrame(queries, "qid long, target string, time timestamp")
    e = spark.createDataFrame(edges, "source long, target string, time timestamp")
    v = spark.createDataFrame(list(vectors.items()), "node long, v array<double>")
    assert {(x["qid"], x["target"], x["support"], tuple(round(c, 9) + 0.0 for c in x["v"])) for x in graph.as_of_mean(q, e, v).collect()} == want and len(want) > 60
    assert graph.as_of_mean(q, e, v.limit(0)).count() == graph.as_of_mean(q.limit(0), e, v).count() == 0


def test_numbered_by_ranges(spark):
    """Small raw ids spread over several ranges, equal orders are told apart by the ties."""
    from relquill.operators import benchmarks

    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id"), (F.col("id") % 3).alias("same"))
    for order, ties in ((F.col("id"), ["id"]), (F.col("same"), ["same", "id"]), (-F.col("id"), ["id"])):
        rows = benchmarks.numbered(df, order, *ties, buckets=7).collect()
        key = {"id": lambda r: r["id"], "same": lambda r: (r["same"], r["id"])}[ties[0]]
        rows.sort(key=lambda r: r["k"])
        got = [key(r) for r in rows]
        assert [r["k"] for r in rows] == list(range(1, 1001)) and got == sorted(got, reverse=got[0] == 999)
    assert benchmarks.numbered(df.limit(0), F.col("id"), "id").count() == 0


def test_triplets_meet_by_blocks(spark):
    """The triplets of neighbours that all pairs of numbers give."""
    from relquill.plans import evaluation

    rows = sorted((r["vec_id"], r["label"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect())
    want = 0
    for q, label in rows:
        near = [(n, x) for n, x in rows if q < n <= q + 40]
        same, other = [n for n, x in near if x == label], [n for n, x in near if x != label]
        want += min(2, len(other)) if q % 2 == 0 and same else 0
    assert want > 10 and len(evaluation.labelled_triplets(spark, "/root/testdata/sf0.001")[0][0]) == want


def test_temporal_split_equals_a_sort(spark):
    df = spark.createDataFrame([(k, f"2024-01-0{1 + k % 3} 0{k % 10}:00:00") for k in range(11)], "id long, t string").withColumn("t", F.to_timestamp("t"))
    train = {r["id"] for r in benchmarks.temporal_split(df, "t", "id").where("split = 'train'").collect()}
    assert train == {r["id"] for r in df.orderBy("t", "id").limit(6).collect()}


def test_validation(spark):
    rows = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "id long, loc long")
    assert [r["location"] for r in validation.duplicate_ids(rows, ["id"], "loc").collect()] == ["11"]
    assert [r["location"] for r in validation.dangling(rows, "id", rows.where("id = 1"), "id").collect()] == ["2"]


def test_conformance_shape_and_dispatch(spark):
    rows = spark.createDataFrame([(1, "a", 5.0, '{"k": 1}'), (2, None, 50.0, '{"k": 1, "z": 2}'), (3, "q", None, "[1]"), (4, "b", 5.0, "{")], "id long, kind string, v double, js string")
    rules = [("kind", "required", None), ("kind", "enum", ("a", "b")), ("v", "range", (0, 10)), ("js", "pattern", "^[{]"), ("js", "keys", ("k",))]
    found = {(r["location"], r["rule"]) for r in validation.conformance(rows, rules, "id").collect()}
    assert found == {("2", "required:kind"), ("2", "range:v"), ("2", "keys:js"), ("3", "enum:kind"), ("3", "pattern:js")}
    assert {(r["location"], r["code"]) for r in validation.json_shape(rows, "js", "id").collect()} == {("3", "shape"), ("4", "json")}
    odd = ['"k": 1}', "1, 2", "1], [2", '1}, {"w": 2', "", " ", None, " {} ", "null", "3"]
    odd = spark.createDataFrame(list(enumerate(odd)), "id int, js string")
    assert {(int(r["location"]), r["code"]) for r in validation.json_shape(odd, "js", "id").collect()} == {(k, "json") for k in range(7)} | {(8, "shape"), (9, "shape")}
    got = validation.dispatched(rows, "kind", {"a": [("v", "range", (6, 9))], "b": []}, "id").collect()
    assert {(r["location"], r["code"], r["rule"]) for r in got} == {("1", "schema", "range:v"), ("2", "card.type", None), ("3", "card.type", None)}
    assert validation.conformance(rows.limit(0), rules, "id").count() == 0


def test_grid_mixes_and_nearest_breaks_ties(spark):
    edges = spark.createDataFrame([(0, 9), (1, 9), (0, 9)], "source long, target long")
    base = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 1.0), (2, 0, 1.0), (2, 1, 0.0), (3, 0, 2.0), (3, 1, 0.0)], "node long, dim int, x double")
    found = {(r["hops"], r["node"], r["dim"]): r["x"] for r in graph.grid(edges, base, [0.5], 2).collect()}
    assert found[1, 0, 0] == 0.75 and found[1, 1, 0] == 0.25 and found[2, 0, 0] == 0.75 and found[2, 2, 0] == 1.0  # 2 has no edge
    best = graph.nearest(base.withColumn("g", F.lit(1)), "node in (0, 2)", ["g"]).collect()
    assert {(r["qid"], r["cand"]) for r in best} == {(0, 2), (2, 0)}


def test_json_lines_split_at_line_feeds_only(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": "x y\u0085z"}\n\n{"a": null, "b": 1}\n')
    assert read_json_lines(spark, str(path), "a string, b int").where("a is not null or b is not null").count() == 2
    assert [r["line"] for r in located_lines(spark, str(path)).orderBy("line").collect()] == [1, 3]
    write_json_lines(spark.createDataFrame([(None, 1)], "b string, a int"), str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":1,"b":null}']


def test_bootstrap_of_a_constant(spark):
    values = spark.createDataFrame([(k, 1.0) for k in range(5)], "ix long, delta double")
    row = ranking.bootstrap(values, 20, 1).first()
    assert (row["lo"], row["hi"], row["p_le_0"]) == (1.0, 1.0, 0.0)


def test_entry_lists_oracles_of_queries_only():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


SLOW = ("graph_mean_hop2_alpha", "asof_cochange_feature", "graph_augmented", "graph_seeding", "bootstrap_ci_query", "bootstrap_ci_cluster")


def test_queries_equal_their_sql(spark):
    """All queries of the catalogue but the slowest, on the smallest tables."""
    import math

    import duckdb

    import __spark_entry__
    from relquill.plans import catalogue

    con, folder = duckdb.connect(), "/root/testdata/sf0.001"
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else "%.9g" % (v + 0.0) if isinstance(v, float) else str(int(v)) if isinstance(v, (int,)) and not isinstance(v, bool) else str(v)
    assert set(catalogue.ORACLES) <= set(__spark_entry__.queries())
    for name in sorted(set(catalogue.ORACLES) - set(SLOW)):
        rel = con.sql(catalogue.ORACLES[name])
        mine = catalogue.QUERIES[name](spark, folder)
        assert sorted(mine.columns) == sorted(rel.columns), name
        rows = [[float(v) if type(v).__name__ == "Decimal" else v for v in r] for r in rel.fetchall()]
        assert sorted(map(tuple, (map(plain, r) for r in mine.select(*rel.columns).collect()))) == sorted(map(tuple, (map(plain, r) for r in rows))), name


def test_ingest(spark):
    import json

    from relquill.operators import ingest

    issues = [{"number": n, "title": f"t{n}", "body": None, "created_at": "2024-01-01", "labels": [{"name": "b"}, {"name": "a"}]} for n in (12, 18, 20)] + [{"number": 21, "pull_request": {"url": "u"}}]
    pulls = [{"number": 34, "body": "Fixes #12", "created_at": "2024-02-01"}, {"number": 40, "body": "Closes: #18 and fixes #99"}, {"number": 50, "body": "none"}]
    files = {"34": [{"filename": "src/a.js"}, {"filename": "tests/slider.test.js"}], "40": [{"filename": "src/a.js"}, {"filename": "b.js"}], "50": [{"filename": "c.js"}]}
    snap = {"repo": "o/r", "issues": issues, "pulls": pulls, "commits": [{"sha": "abc", "commit": {"message": "m", "author": {"name": "x", "date": "2024"}}}], "pull_files": files}
    df = spark.createDataFrame([(json.dumps(snap),)], "j string").select(F.from_json("j", ingest.SNAPSHOT).alias("s")).select("s.*")
    assert {r["type"]: r["count"] for r in ingest.records(df).groupBy("type").count().collect()} == {"issue": 3, "pull_request": 3, "commit": 1, "file": 3, "test": 1}
    found = {(r["source"], r["relation"], r["target"]) for r in ingest.edges(df).collect()}
    assert len(found) == 7
    assert {x for x in found if x[1] == "fixes"} == {("gh:o/r:pr:34", "fixes", "gh:o/r:issue:12"), ("gh:o/r:pr:40", "fixes", "gh:o/r:issue:18")}


def test_streaming(spark, tmp_path):
    from relquill.streaming import events

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    for k in range(2):
        events.append_new(stream(), str(tmp_path / "out"), ["event_id"], str(tmp_path / f"c{k}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == source.select("event_id").distinct().count()
    run = events.windowed(stream(), "1 day").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, spark.table("w").select("start", "event_type", "n").collect())) == sorted(map(tuple, events.windowed(source, "1 day").select("start", "event_type", "n").collect()))
    assert events.sessions(source).agg(F.sum("n")).first()[0] == source.count()


def test_relation_metric_raises_what_tells_apart(spark):
    from relquill.operators.learned import relation_metric

    rows = spark.createDataFrame([(k, t, x) for k in range(20) for t, x in (("good", 0.05), ("bad", -0.05))], "trip int, tok string, diff double")
    weight = {r["tok"]: r["weight"] for r in relation_metric(rows).collect()}
    assert weight["good"] > 1 > weight["bad"]
    assert relation_metric(rows.limit(0)).count() == 0
    # a triplet that is never late: its weights are drawn to 0 in every epoch
    far = relation_metric(spark.createDataFrame([(1, "a", 5.0)], "trip int, tok string, diff double"), rate=0.5, epochs=40, decay=1e-3).first()
    assert abs(far["weight"] - (1 - 0.5e-3) ** 80) < 1e-12


def test_reranker_is_drawn_to_zero_by_its_rows():
    """One step from 0 has no regularisation; the second has ``l2`` over the number of rows."""
    import numpy as np

    from relquill.operators.learned import fit_lr

    x, y = np.array([[1.0], [2.0], [-1.0]]), np.array([1.0, 1.0, 0.0])
    balance = np.array([0.75, 0.75, 1.5])
    w, b = 0.0, 0.0
    for _ in range(2):
        e = balance * (1 / (1 + np.exp(-(x[:, 0] * w + b))) - y) / 3
        w, b = w - 0.3 * ((x[:, 0] * e).sum() + 2.0 * w / 3), b - 0.3 * e.sum()
    got = fit_lr(x, y, epochs=2, l2=2.0)
    assert abs(got[0][0] - w) < 1e-12 and abs(got[1] - b) < 1e-12


def test_cosines_and_group_scores_against_plain_python(spark):
    """Cosines at each floor of document counts, and BM25 with the counts of a query's groups."""
    import math
    import random
    from collections import Counter

    from relquill.operators import lexical

    r = random.Random(4)
    words = [f"w{k}" for k in range(30)]
    docs = {k: " ".join(r.choices(words, [1 / (i + 1) for i in range(30)], k=r.randint(0, 25))) for k in range(25)} | {50: "", 51: None, 52: "lone lone w0"}
    asked = {0: "w0 w1 w1 w29 w28 lone", 1: "w2 unseen", 2: "", 3: None}
    q, d = spark.createDataFrame(list(asked.items()), "qid int, text string"), spark.createDataFrame(list(docs.items()), "cand int, text string")
    tf = {k: Counter((t or "").split()) for k, t in docs.items()}
    df = Counter(t for c in tf.values() for t in c)
    for least in (1, 2, 4):
        for idf in (False, True):
            got = {(x["qid"], x["cand"]): x["score"] for x in lexical.tf_dot(q, d, idf, least).collect()}
            want = {}
            for i, text in asked.items():
                own = Counter(t for t in (text or "").split() if df[t] >= least)
                for k, c in tf.items():
                    c = {t: n for t, n in c.items() if df[t] >= least}
                    if own.keys() & c.keys():
                        dot = sum(n * c.get(t, 0) * (math.log((1 + len(docs)) / (1 + df[t])) + 1 if idf else 1) for t, n in own.items())
                        want[i, k] = dot / math.sqrt(sum(n * n for n in own.values()) * sum(n * n for n in c.values()))
            assert got.keys() == want.keys() and all(abs(got[x] - v) < 1e-9 for x, v in want.items()) and want, (least, idf)
    group = {k: "abc"[k % 3] if k % 7 else None for k in docs}
    scope = [(0, "a"), (0, "b"), (1, "c"), (2, "a")]
    got = lexical.bm25_in_groups(q, lexical.query_postings(q, d), spark.createDataFrame(list(group.items()), "cand int, grp string"), spark.createDataFrame(scope, "qid int, grp string")).collect()
    want = {}
    for i, text in asked.items():
        pool = [k for k in docs if (i, group[k]) in scope]
        mean = sum(sum(tf[k].values()) for k in pool) / max(1, len(pool))
        for k in pool:
            hit = [t for t in (text or "").split() if t in tf[k]]
            seen = {t: sum(t in tf[x] for x in pool) for t in hit}
            if hit:
                want[i, k] = sum(math.log(1 + (len(pool) - seen[t] + 0.5) / (seen[t] + 0.5)) * tf[k][t] * 2.5 / (tf[k][t] + 1.5 * (0.25 + 0.75 * sum(tf[k].values()) / mean)) for t in hit)
    assert {(x["qid"], x["cand"]): round(x["score"], 9) for x in got} == {x: round(v, 9) for x, v in want.items()} and len(want) > 10


def test_sign_test_is_exact(spark):
    from math import comb

    rows = [(0, 0), (5, 0), (3, 7), (40, 41), (900, 1000)]
    found = spark.createDataFrame(rows, "g long, l long").select("g", "l", ranking.sign_test(F.col("g"), F.col("l")).alias("p")).collect()
    for g, n, p in ((r["g"], r["g"] + r["l"], r["p"]) for r in found):
        assert abs(p - min(1, 2 * sum(comb(n, k) for k in range(min(g, n - g) + 1)) / 2**n)) < 1e-9


def test_sources_and_schemas(spark, tmp_path):
    import json

    from relquill.operators import ingest
    from relquill.operators.schemas import all_schemas, load_schema
    from relquill.sources import tables

    for name, text in {"a.jsonl": '{"id": 1}\n\n{"id": 2}\n[3', "b.json": '[{"id": 3}, {"id": 4}]', "sub/c.json": '{"id": 5}', "split.json": "{}", "x-results.json": "{}", "templates/t.json": "{}", "d.txt": ""}.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    paths = sorted(r["path"] for r in tables.discover(spark, str(tmp_path / "in")).collect())
    assert [p.rpartition("/")[2] for p in paths] == ["a.jsonl", "b.json", "c.json"]
    found = {(r["location"], r["id"]) for r in tables.located_objects(spark, paths).select("location", F.try_variant_get("value", "$.id", "int").alias("id")).collect()}
    assert found == {("a.jsonl:1", 1), ("a.jsonl:3", 2), ("a.jsonl:4", None), ("b.json[0]", 3), ("b.json[1]", 4), ("c.json", 5)}
    snap = {"repo": "o/r", "license": "MIT", "retrieved_at": "t", "issues": [{"number": 1, "title": "old"}, {"number": 1, "title": "new"}], "pulls": [{"number": 2, "body": "fixes #1", "created_at": "c"}], "pull_files": {"2": [{"filename": "a.py"}]}}
    whole, parts = tmp_path / "whole", tmp_path / "parts"
    for folder in (whole, parts):
        folder.mkdir()
    (whole / "snapshot.json").write_text(json.dumps(snap))
    (parts / "meta.json").write_text(json.dumps({k: snap[k] for k in ("repo", "license", "retrieved_at")}))
    for k in ("issues", "pulls", "pull_files"):
        (parts / f"{k}.json").write_text(json.dumps(snap[k]))
    a, b = (tables.load_snapshot(spark, str(f), ingest.SNAPSHOT) for f in (whole, parts))
    assert a.columns == b.columns and a.collect() == b.collect()
    assert {r["t"] for r in ingest.records(a).where("type = 'issue'").select(F.try_variant_get("content", "$.title", "string").alias("t")).collect()} == {"new"}
    with pytest.raises(FileNotFoundError):
        tables.load_snapshot(spark, str(tmp_path), ingest.SNAPSHOT)
    tables.write_json({"b": 1, "a": ["é"]}, str(tmp_path / "card.json"))
    assert json.loads((tmp_path / "card.json").read_text()) == {"a": ["é"], "b": 1}
    assert "license" in load_schema("record")["properties"]["provenance"]["required"] and set(all_schemas()) >= {"record", "edge"}
    rules = [("id", "required", None), ("type", "enum", ("issue",)), ("provenance.license", "required", None), ("provenance.content_hash", "pattern", "^(sha256:[0-9a-f]{64}|TODO)$")]
    rows = spark.createDataFrame([("r", "issue", "train", ("u", "t", None, "TODO")), (None, "x", "dev", ("u", "t", "MIT", "md5:1"))], "id string, type string, split string, provenance struct<source_url:string,retrieved_at:string,license:string,content_hash:string>")
    got = [r["rule"] for r in validation.conformance(rows.withColumn("loc", F.lit(1)), rules, "loc").collect()]
    assert sorted(got) == sorted(["required:provenance.license", "required:id", "enum:type", "pattern:provenance.content_hash"])


def test_hashed_cosine_against_plain_python(spark):
    import math
    import zlib
    from collections import Counter

    from relquill.operators import lexical

    texts = ["parse tz data", "data frame parse parse", "", "zeta", "Éa b parseTZ"]
    tok = lambda t: [x for x in __import__("re").findall("[A-Za-z0-9]+", t) for x in [*__import__("re").sub("([a-z0-9])([A-Z])", r"\1 \2", x).lower().split(" "), x.lower()]]

    def vector(t):
        out = Counter()
        for w, n in Counter(tok(t)).items():
            out[zlib.crc32(w.encode()) % 64] += 1 + math.log(n)
        return out

    q = spark.createDataFrame([(0, "parse data"), (1, "none")], "qid int, text string")
    d = spark.createDataFrame(list(enumerate(texts)), "cand int, text string")
    got = {(r["qid"], r["cand"]): r["score"] for r in lexical.hashed_cosine(q, d, T.identifier_tokens, 64).collect()}
    for i, a in enumerate(["parse data", "none"]):
        for j, b in enumerate(texts):
            x, y = vector(a), vector(b)
            dot = sum(v * y[k] for k, v in x.items())
            want = dot / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())) if dot else None
            assert (got.get((i, j)) is None) == (want is None) and (want is None or abs(got[i, j] - want) < 1e-12)
    zero = lexical.pooled(spark.createDataFrame([(0, 1, 0.5)], "qid int, cand int, score double"), q.select("qid").crossJoin(d.select("cand")))
    assert zero.count() == 10 and zero.where("score = 0").count() == 9


def test_augmented_vectors_are_not_written(spark, monkeypatch):
    """Vectors as sums of first vectors are those of means of whole vectors, and neither means nor the last round are written as vectors."""
    import numpy as np

    from relquill.operators import graph

    r = np.random.default_rng(2)
    pairs = {(f"o{a:03}", f"{kind}{b}", role) for a, kind, b, role in zip(r.integers(0, 60, 300), r.choice(["c", "p", "z"], 300), r.integers(0, 20, 300), r.choice(["x", "y"], 300), strict=True)}
    edges = spark.createDataFrame(sorted(pairs), "source string, target string, role string")
    base = spark.createDataFrame([(f"o{k:03}", r.normal(size=32).tolist()) for k in range(25)] + [("alone", [1.0] * 32)], "node string, v array<double>")
    written, write = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: (written.append((name, dict(df.dtypes))), write(df, name))[1])
    run = lambda: {x["node"]: np.array(x["v"]) for x in graph.augmented_vectors(edges, base, 0.3, 1).collect()}
    got = run()
    assert [name for name, types in written if "array<double>" == types.get("v")] == ["base"]
    monkeypatch.setattr(graph.Combinations, "short", lambda self, current: False)  # turns to whole vectors after a round
    late = run()
    monkeypatch.setattr(graph.Combinations, "of", staticmethod(lambda base: None))
    want = run()
    assert set(got) == set(late) == set(want) and len(got) > 60
    assert all(abs(got[k] - want[k]).max() < 1e-12 and abs(late[k] - want[k]).max() < 1e-12 for k in want)


@pytest.mark.parametrize("name, pairs", [("feature_rows", "fused"), ("lr_rerank_loro", "rows")])
def test_scored_pairs_are_neither_written_nor_shuffled(spark, name, pairs):
    """Scores of pairs stay in the task that has their candidate: what is written and dealt grows with postings, not with pairs."""
    import os
    import re

    import __spark_entry__
    from relquill.sources.tables import shared_dir

    at = shared_dir(spark).removeprefix("file:")
    old = set(os.listdir(at))
    out = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    assert out.count() > 0
    new = {x.rsplit("-", 1)[0] for x in set(os.listdir(at)) - old}
    assert "postings" in new and pairs not in new
    if name == "feature_rows":
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning\(qid#\w+, cand", plan)


def test_small_groups_are_drawn_in_rows(spark, monkeypatch):
    """Pools of small groups are those of places, and nothing that is drawn is written; large groups, nulls and queries of two groups are mixed in."""
    own = [(g, 10 * g + q, (7 * g + 3 * q + 5 * c) % 23) for g in range(6) for q in range(5) for c in range(4)] + [(1, 0, 99), (None, 77, 1), (2, 78, None), (2, None, 3)]
    own += [(50, 900 + q, c) for q in range(4) for c in range(q, q + 9)]
    df = spark.createDataFrame(own, "grp long, qid long, cand long")
    run = lambda df: sorted(map(tuple, benchmarks.change_pools(df, 3, 2, 2).collect()), key=str)
    written, write = [], benchmarks.materialise
    monkeypatch.setattr(benchmarks, "materialise", lambda df, name: (written.append(name), write(df, name))[1])
    plain = df.where("grp < 50 AND qid > 0 AND qid < 70 AND cand IS NOT NULL")
    got = run(plain)
    assert "ranked" not in written and "placed" not in written
    both = []
    for most in (30, 0):
        monkeypatch.setattr(benchmarks, "ROW_CHANGES", most)
        both.append((run(plain), run(df)))
    assert both[0] == both[1] and both[0][0] == got and len(both[0][1]) > len(got) > 100


def test_relation_metric_trains_on_all_triplets(spark, monkeypatch):
    """Beyond 60,000 triplets each still counts, and blocks on the executors give what the driver gives."""
    import numpy as np

    from relquill.operators import learned

    own = spark.range(60_500).select(F.col("id").alias("trip"), F.concat(F.lit("t"), "id").alias("tok"), F.lit(0.1).alias("diff"))
    got = learned.relation_metric(own, epochs=1, decay=0.0)
    assert got.count() == 60_500 and got.where("weight <= 1").count() == 0  # each is late and raises its own token

    r = np.random.default_rng(1)
    rows = [(f"{t}", f"w{w}", float(x)) for t in range(300) for w, x in zip(r.choice(30, 5, replace=False), r.normal(0, 0.2, 5), strict=True)]
    df = spark.createDataFrame(rows, "trip string, tok string, diff double")
    theta, names = np.ones(30), sorted({x[1] for x in rows})
    dense = np.zeros((300, 30))
    for t, w, x in rows:
        dense[int(t), names.index(w)] = x
    for _ in range(10):
        late = dense @ theta**2 < 0.15
        theta = np.maximum(theta - 0.5 * (-dense[late].sum(axis=0) * 2 * theta / 300 + 1e-4 * theta), 0)
    for most in (learned.DRIVER_ENTRIES, 0):
        monkeypatch.setattr(learned, "DRIVER_ENTRIES", most)
        got = {x["tok"]: x["weight"] for x in learned.relation_metric(df, epochs=10).collect()}
        assert sorted(got) == names and all(abs(got[t] - w) < 1e-9 for t, w in zip(names, theta**2, strict=True))


def test_leave_one_group_out_fits_on_all_others(spark):
    import numpy as np

    from relquill.operators import learned

    r = np.random.default_rng(3)
    rows = [(k, k, f"g{k % 5}" if k % 7 else None, int(x > 0), float(x), float(z)) for k, (x, z) in enumerate(r.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "qid long, cand long, grp string, y int, a double, b double")
    got = {x["qid"]: x["p"] for x in learned.leave_one_group_out(df, ["a", "b"]).collect()}
    for name in {x[2] for x in rows}:
        train = [x for x in rows if x[2] != name]
        x, y = np.array([t[4:] for t in train]), np.array([t[3] for t in train], float)
        w, b = learned.fit_lr((x - x.mean(axis=0)) / x.std(axis=0), y)
        for t in rows:
            if t[2] == name:
                want = 1 / (1 + np.exp(-(((np.array(t[4:]) - x.mean(axis=0)) / x.std(axis=0)) @ w + b)))
                assert abs(got[t[0]] - want) < 1e-9
    assert len(got) == 200 and sum((p > 0.5) == (rows[k][3] == 1) for k, p in got.items()) > 190
    assert {x["p"] for x in learned.leave_one_group_out(df.withColumn("y", F.lit(0)), ["a"]).collect()} == {0.5}


def test_towers_learn_what_tells_apart():
    import numpy as np

    from relquill.operators import learned

    r = np.random.default_rng(0)
    q = r.normal(size=(200, 8))
    p, n = np.c_[q[:, :4], -q[:, 4:]], np.c_[-q[:, :4], q[:, 4:]]  # one half agrees with the query, the other is reversed
    left, right = learned.train_tower((q, p, n), out=8, epochs=200)
    gap = ((q @ left.T) * ((p - n) @ right.T)).sum(axis=1)
    assert (gap > 0).mean() > 0.95
    own = learned.train_relation_map((q, p, n))
    assert ((q @ own.T) * (p - n)).sum(axis=1).mean() > (q * (p - n)).sum(axis=1).mean()
    empty = learned.train_relation_map((np.zeros((0, 3)),) * 3)
    assert (empty == np.eye(3)).all()


def test_synthetic_order(spark):
    import __spark_entry__  # noqa: F401
    from relquill.plans.catalogue import QUERIES

    r1 = {r["system"]: r["r1"] for r in QUERIES["synthetic_ablation"](spark, "").collect()}
    assert r1["metric"] >= r1["idf"] > r1["vanilla"]


def test_normal_cdf_and_numbers(spark):
    import math

    xs = [-3.0, -1.0, 0.0, 0.5, 2.0]
    got = [r["p"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", ranking.normal_cdf(F.col("x")).alias("p")).orderBy("x").collect()]
    assert all(abs(p - 0.5 * (1 + math.erf(x / math.sqrt(2)))) < 2e-7 for x, p in zip(xs, got, strict=True))
    df = spark.createDataFrame([(k,) for k in range(500)], "id long")
    rows = benchmarks.numbered(df, T.hash_order(4, "id"), "id", buckets=8).collect()
    order = spark.createDataFrame([(r["id"],) for r in rows], "id long").select("id", T.hash_order(4, "id").alias("h")).collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["k"])] == [r["id"] for r in sorted(order, key=lambda r: (r["h"], r["id"]))]


def test_chunk_scores_and_density(spark):
    from relquill.operators import dense

    pairs = [(0, 1, k, [1.0, 0.0], v) for k, v in enumerate([[0.0, 1.0], [1.0, 0.0], [0.5**0.5] * 2])] + [(0, 2, None, [1.0, 0.0], None), (0, 3, 0, [1.0, 0.0], [0.0, 0.0])]
    got = {r["cand"]: r for r in dense.chunk_scores(spark.createDataFrame(pairs, "qid int, cand int, chunk_ix int, q array<double>, v array<double>")).collect()}
    assert [round(got[1][k], 4) for k in ("maxp", "firstp", "sump", "meanp")] == [1.0, 0.0, 1.7071, 0.569] and abs(got[1]["whole_doc_mean"] - 0.5**0.5) < 1e-9
    assert {got[2][k] for k in ("maxp", "firstp", "sump", "meanp", "whole_doc_mean")} == {-1.0} and got[3]["whole_doc_mean"] == -1.0 and got[3]["maxp"] == 0.0
    commits = spark.createDataFrame([("t1", "d1"), ("t1", "d2"), ("t2", "d1")], "target string, date string")
    gold = spark.createDataFrame([(1, "t1", "d1"), (2, "t2", "d1"), (2, "t3", "d1")], "qid int, target string, date string")
    assert graph.density(commits, gold).first().asDict() == {"pairs": 3, "isolated": 2, "single": 2, "queries": 2, "queries_isolated": 1, "median_commits": 1, "most_commits": 2}
    sane = dense.sanity(spark.createDataFrame([([1.0, 0.0], 0), ([1.0, 0.1], 0), ([0.0, 1.0], 1), ([0.1, 1.0], 1)], "v array<double>, g int"), "g").first()
    assert sane["usable"] and sane["related"] > 0.9


def test_command_line(spark, tmp_path, capsys):
    import json

    from relquill.__main__ import main

    assert main([]) == 2 and main(["run", "no such query", "x"]) == 2
    assert main(["queries"]) == 0 and "bm25_rank_topk" in capsys.readouterr().out.split()
    assert main(["schemas"]) == 0 and "record" in json.loads(capsys.readouterr().out)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.jsonl").write_text(json.dumps({"relation": "fixes", "source": "a", "target": "b"}))
    assert main(["validate", str(tmp_path / "in")]) == 1
    assert "ERROR: ref.dangling: a [e.jsonl:1]" in capsys.readouterr().out
    assert main(["ablation", "--seed", "3"]) == 0 and "metric" in capsys.readouterr().out
    (tmp_path / "snapshot.json").write_text(json.dumps({"repo": "o/r", "issues": [{"number": 1}], "pulls": [{"number": 2, "body": "fixes #1"}], "commits": [], "pull_files": {}}))
    assert main(["ingest", str(tmp_path), str(tmp_path / "out")]) == 0
    assert spark.read.text(str(tmp_path / "out" / "edges.jsonl")).count() == 1 and spark.read.text(str(tmp_path / "out" / "records.jsonl")).count() == 2


def test_archives_and_merges(spark, tmp_path):
    import numpy as np

    from relquill.sources import tables

    np.savez(tmp_path / "e.npz", ids=np.array(["a", "b"]), vectors=np.array([[1, 2], [3, 4]], np.float16))
    np.savez(tmp_path / "c.npz", ids=np.array(["a", "b", "c"]), offsets=np.array([0, 2, 2, 3]), vectors=np.array([[1, 0], [0, 1], [2, 2]], np.float16))
    assert sorted((r["id"], r["v"]) for r in tables.read_npz(spark, str(tmp_path / "e.npz")).collect()) == [("a", [1.0, 2.0]), ("b", [3.0, 4.0])]
    assert sorted((r["id"], r["chunk_ix"], r["v"]) for r in tables.read_npz(spark, str(tmp_path / "c.npz"), offsets="offsets").collect()) == [("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 1.0]), ("c", 0, [2.0, 2.0])]
    edges = spark.createDataFrame([("r1", "a", "b"), ("r1", "a", "b"), ("r2", "c", "d")], "repo string, source string, target string")
    path = str(tmp_path / "edges")
    assert tables.merge_new(edges, path, ["source", "target"], spark.createDataFrame([("r2",)], "repo string"), "repo") == 1
    assert tables.merge_new(edges, path, ["source", "target"]) == 1 and tables.merge_new(edges, path, ["source", "target"]) == 0
    assert spark.read.parquet(path).count() == 2


def test_pools_against_all_pairs(spark):
    """``drawn`` and the pools built on it, by their definition over whole pools in plain Python."""
    import hashlib
    import random

    h = lambda *x: int(hashlib.md5("|".join(map(str, x)).encode()).hexdigest()[:8], 16)
    rng = random.Random(5)
    members = {(g, c) for c in range(120) for g in rng.sample("abcd", rng.choice((1, 1, 1, 2)))} | {("e", 200)}
    asked = [(q, g) for q in range(12) for g in rng.sample("abcde", 1 + q % 3)] + [(20, "e"), (21, "none")]
    gold = {(q, c) for q, g in asked for c in rng.sample(sorted(c for m, c in members if m == g) or [0], 1)} | {(20, 200)}
    smallest = {c: min(g for g, x in members if x == c) for _, c in members}

    def draw(q, own, excluded, size, seed):
        places = [(g, c) for g in sorted(own) for c in sorted((c for m, c in members if m == g), key=lambda c: (h(seed, g, c), c))]
        again = sum(smallest[c] != g for g, c in places) if len({g for g, _ in places}) > 1 else 0
        n = len(places)
        m = min(n, size + len(excluded) + again)
        cut = [(j * n // m, (j + 1) * n // m) for j in range(m)]
        return {places[a + h(seed, q, j) % (b - a)][1] for j, (a, b) in enumerate(cut)} - excluded, {c for _, c in places} - excluded

    frames = lambda rows, names: spark.createDataFrame(sorted(rows), names)
    held, pairs = frames(members, "grp string, cand int").union(spark.createDataFrame([(None, 7), ("a", None)], "grp string, cand int")), frames(gold, "qid int, cand int")
    got = benchmarks.drawn(frames(set(asked), "qid int, grp string"), held.union(held), pairs, 9, 3).collect()
    for q in {q for q, _ in asked}:
        excluded = {c for x, c in gold if x == q}
        drawn, pool = draw(q, {g for x, g in asked if x == q}, excluded, 9, 3)
        want = sorted(drawn, key=lambda c: (h(3, q, c), c))[:9]
        assert [r["cand"] for r in sorted(got, key=lambda r: r["k"]) if r["qid"] == q] == want and len(want) == min(9, len(pool)), q

    overlaps = {(q, c): rng.randint(1, 4) for q in range(12) for c in rng.sample(range(120), 3 * q)}
    cands = frames(members, "cand_grp string, cand int").select("cand", F.col("cand_grp").alias("grp"))
    found = {tuple(r) for r in benchmarks.retrieval_pools(frames([(*k, v) for k, v in overlaps.items()], "qid int, cand int, score long"), pairs, cands, 8, 4, 5, 1).collect()}
    want = set()
    for q in {q for q, _ in gold}:
        own = {c for x, c in gold if x == q}
        groups = {g for g, c in members if c in own}
        pool = {c for g, c in members if g in groups} - own
        if len(pool) >= 5:
            best = sorted(pool, key=lambda c: (-overlaps.get((q, c), 0), c))[:8]
            drawn, _ = draw(q, groups, own | set(best), 5, 1)
            want |= {(q, c, "positive") for c in own} | {(q, c, "hard") for c in best} | {(q, c, "random") for c in sorted(drawn, key=lambda c: (h(1, q, c), c))[:4]}
    assert found == want and {k for _, _, k in want} == {"positive", "hard", "random"}
    none = spark.createDataFrame([], "grp string, qid int, cand int")
    assert benchmarks.change_pools(none).count() == benchmarks.sampled_pool(pairs, held.limit(0), pairs, 3, 1).count() == 0
    one = spark.createDataFrame([("g", q, c) for q, c in ((1, 1), (1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 1), (3, 2))], "grp string, qid int, cand int")
    assert {tuple(r) for r in benchmarks.change_pools(one, 1, 1).collect()} == {(1, 1, "positive"), (1, 2, "positive"), (1, 3, "hard"), (2, 2, "positive"), (2, 3, "positive"), (2, 1, "hard")}
