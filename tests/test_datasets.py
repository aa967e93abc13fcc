"""JSON datasets: compiled shapes against a plain checker, every finding from one folder, ingest against written-out records, candidate lists."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from relquill.operators import candidates, datasets, ingest, schemas

SHA = "sha256:" + "0" * 64
ORIGIN = {"source_url": "u", "retrieved_at": "2024-01-01T00:00:00Z", "license": "MIT", "content_hash": SHA, "method": "review"}


def slow_violations(value, schema, path=()):
    """The rules of a schema that a value breaks, by recursion over plain objects."""
    kinds = {str: "string", bool: "boolean", type(None): "null", dict: "object", list: "array"}
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    own = {kinds.get(type(value), "number")} | ({"integer"} if number and value == math.floor(value) else set())
    out, where = [], "/".join(path)
    for part in schema.get("allOf", ()):
        out += slow_violations(value, part, path)
    if "type" in schema and not own & set([schema["type"]] if isinstance(schema["type"], str) else schema["type"]):
        out.append((where, "type"))
    if "const" in schema and value != schema["const"]:
        out.append((where, "const"))
    if "enum" in schema and value not in schema["enum"]:
        out.append((where, "enum"))
    if isinstance(value, str):
        out += [(where, "minLength")] * (len(value) < schema.get("minLength", 0)) + [(where, "pattern")] * (not re.search(schema.get("pattern", ""), value))
    if number:
        out += [(where, "minimum")] * (value < schema.get("minimum", -math.inf)) + [(where, "maximum")] * (value > schema.get("maximum", math.inf))
    if isinstance(value, list):
        out += [(where, "minItems")] * (len(value) < schema.get("minItems", 0))
        for k, x in enumerate(value):
            out += slow_violations(x, schema.get("items", {}), (*path, str(k)))
    if isinstance(value, dict):
        out += [(where, f"required:{k}") for k in schema.get("required", ()) if k not in value]
        known, other = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [(where, "additionalProperties")] * (other is False and bool(set(value) - set(known)))
        for k, x in value.items():
            if k in known or isinstance(other, dict):
                out += slow_violations(x, known.get(k, other), (*path, k))
    return out


def test_compiled_shapes_against_a_plain_checker(spark):
    """Every shape over objects that are right but for random changes at any depth."""
    good = {
        "record": {"id": "r", "type": "issue", "content": {"title": "t", "n": [1, {}]}, "provenance": ORIGIN, "valid_from": "2024", "valid_until": None, "split": "dev", "attributes": {}},
        "edge": {"source": "a", "relation": "fixes", "target": "b", "confidence": 0.5, "provenance": {**ORIGIN, "observed": True}},
        "benchmark-query": {"query_id": "q", "task": "pr_to_missing_test", "query_record": "r", "candidates": ["a", "b"], "relevant": [], "hard_negatives": ["b"], "as_of": ""},
        "source-card": {"card_type": "source", "id": "s", "name": "n", "source_url": "u", "retrieved_at": "t", "license": "MIT", "record_types": ["issue", "test"], "redistribution": "full_text"},
        "dataset-card": {"card_type": "dataset", "id": "s", "name": "n", "version": "1", "created_at": "t", "sources": ["x"], "record_counts": {"issue": 3, "é f": 1.0}, "edge_counts": {}, "relation_types": ["fixes"], "split_policy": {"frozen": True, "method": "m", "seed": None}, "redistribution": "mixed"},
        "experiment-card": {"card_type": "experiment", "id": "e", "name": "n", "created_at": "t", "hypothesis": "h", "task": "issue_to_fixing_pr", "dataset_version": "d", "code_version": "c", "seed": 7, "command": "x", "system": "s", "metrics": {"recall_at_k": {"1": 0.5, "5": 1}, "mrr": 0.2, "n_queries": 3}, "exploratory": False},
    }
    r = random.Random(3)
    junk = ["", "x", 0, -1, 1.5, 2.0, True, None, [], ["", 3], {}, {"a": 1}, SHA, "TODO", 1e300]

    def places(x, path=()):
        found = [path] if path else []
        for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
            found += places(v, (*path, k))
        return found

    for name, start in good.items():
        schema, rows = schemas.load_schema(name), [start, [], "text", None, 3]
        for _ in range(60):
            own = json.loads(json.dumps(start))
            for _ in range(r.randint(1, 3)):
                path = r.choice(places(own))
                holder = own
                for k in path[:-1]:
                    holder = holder[k]
                if r.random() < 0.3 and isinstance(holder, dict):
                    del holder[path[-1]]
                elif r.random() < 0.3 and isinstance(holder, dict):
                    holder["extra"] = r.choice(junk)
                else:
                    holder[path[-1]] = r.choice(junk)
                if not places(own):
                    break
            rows.append(own)
        df = spark.createDataFrame([(k, json.dumps(x, ensure_ascii=False)) for k, x in enumerate(rows)], "k int, j string")
        got = {x["k"]: sorted((v["path"], v["rule"]) for v in x["found"]) for x in df.select("k", schemas.violations(F.parse_json("j"), schema).alias("found")).collect()}
        assert got == {k: sorted(slow_violations(x, schema)) for k, x in enumerate(rows)}
        assert got[0] == [] and sum(map(bool, got.values())) > 40


def folder_of_findings(root):
    edge = {"source": "a", "relation": "fixes", "target": "b", "confidence": 0.5, "valid_from": "2024-03-01T00:00:00Z", "provenance": ORIGIN}
    record = lambda i, since=None, **more: {"id": i, "type": "issue", "provenance": {**ORIGIN, **more}} | ({"valid_from": since} if since else {})
    query = {"query_id": "q", "task": "issue_to_fixing_pr", "query_record": "a", "candidates": ["a", "gone"], "relevant": ["b"], "hard_negatives": ["c"]}
    lines = lambda *x: "\n".join(json.dumps(v) for v in x) + "\n"
    files = {
        "records.jsonl": lines(record("a", "2024-02-01T00:00:00Z"), record("b", "2024-06-01T00:00:00Z"), record("c", content_hash="TODO"), record("d", retrieved_at="soon"), {"id": "e", "type": "poem", "provenance": ORIGIN}, record("a")) + '"text"\n\n' + lines(record("late")),
        "sub/edges.json": json.dumps([edge, {**edge, "target": "nowhere"}, {**edge, "confidence": 0.95, "provenance": {k: v for k, v in ORIGIN.items() if k != "method"} | {"observed": False, "content_hash": "TODO"}}]),
        "benchmark/q.jsonl": lines(query),
        "cards/c.json": json.dumps({"card_type": "other"}), "cards/s.json": json.dumps({"card_type": "source", "id": ""}),
        "broken.jsonl": lines(record("x")) + "{oops\n",
        "templates/t.json": "{oops", "a.schema.json": "{oops", "split.json": "{oops", "my-results.json": "{oops",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")


def test_every_finding_from_one_folder(spark, tmp_path, capsys):
    folder_of_findings(tmp_path)
    found, counts = datasets.validate_folder(spark, str(tmp_path))
    got = Counter((r["severity"], r["code"], r["location"], r["detail"]) for r in found.collect())
    e, w = "error", "warning"
    card = [(e, "schema", "s.json", f"required:{k}") for k in ("name", "source_url", "retrieved_at", "license", "record_types", "redistribution")] + [(e, "schema", "s.json:id", "minLength")]
    want = [
        (e, "provenance.todo", "records.jsonl:3", None), (e, "provenance.timestamp", "records.jsonl:4", None), (e, "schema", "records.jsonl:5:type", "enum"), (e, "id.duplicate", "records.jsonl:6", "a"),
        (e, "shape", "records.jsonl:7", None), (w, "temporal.inconsistent", "edges.json[0]", "b"), (e, "ref.dangling", "edges.json[1]", "nowhere"), (e, "provenance.method", "edges.json[2]", None),
        (e, "provenance.todo", "edges.json[2]", None), (w, "confidence.inferred", "edges.json[2]", None), (w, "temporal.inconsistent", "edges.json[2]", "b"), (e, "benchmark.relevant", "q.jsonl:1", "b"),
        (w, "benchmark.hardneg", "q.jsonl:1", "c"), (e, "ref.dangling", "q.jsonl:1", "gone"), (e, "card.type", "c.json", None), (e, "json", "broken.jsonl", None), *card,
    ]
    assert got == Counter(want)
    assert {r["kind"]: r["count"] for r in counts.collect()} == {"record": 7, "edge": 3, "benchmark": 1, "card": 2}
    from relquill.__main__ import main

    assert main(["validate", str(tmp_path), "--json"]) == 1
    shown = json.loads(capsys.readouterr().out)
    assert (shown["ok"], shown["counts"], shown["errors"], shown["warnings"]) == (False, {"records": 7, "edges": 3, "cards": 2, "benchmarks": 1}, len(want) - 4, 4)
    assert Counter((f["severity"], f["code"], f["location"], f.get("detail")) for f in shown["findings"]) == got
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.txt").write_text("")
    assert main(["validate", str(tmp_path / "none")]) == 0


def sha(x):
    return "sha256:" + hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_ingest_against_written_out_records(spark, tmp_path):
    """Bodies alone close issues, numbers are integers, times fall back to when the snapshot was read."""
    from relquill.__main__ import main

    at = "2024-05-01T00:00:00Z"
    snap = {
        "repo": "o/r", "retrieved_at": at,
        "issues": [{"number": 7, "title": "é", "body": None, "state": "open", "labels": [{"name": "b"}, {"name": "a"}], "html_url": "h7", "created_at": "2024-01-01T00:00:00Z"}, {"number": 8, "title": "x"}, {"number": 9, "pull_request": {"url": "u"}}],
        "pulls": [
            {"number": 9, "title": "Fixes #8", "body": "closes #007, fixes #7 and resolves #9, fixed #99", "state": "closed", "merged_at": "t", "merge_commit_sha": "s"},
            {"number": 10, "title": "y", "body": "see #7", "created_at": "2024-02-01T00:00:00Z", "html_url": "h10"},
        ],
        "commits": [{"sha": "abc", "commit": {"message": "m", "author": None}}],
        "pull_files": {"9": [{"filename": "a.py"}, {"filename": ""}], "10": [{"filename": "a.py"}, {"filename": "tests/b.py"}], "11": [{"filename": "c.py"}]},
    }
    (tmp_path / "snapshot.json").write_text(json.dumps(snap))
    assert main(["ingest", str(tmp_path), str(tmp_path / "out")]) == 0
    read = lambda name: [json.loads(x) for p in sorted((tmp_path / "out" / name).glob("part-*")) for x in p.read_text().splitlines()]
    origin = lambda url, content, method: {"source_url": url, "retrieved_at": at, "license": "unknown", "content_hash": sha(content), "transform": "relquill.operators.ingest", "method": method, "observed": True}
    api = "https://api.github.com/repos/o/r/"

    def record(ident, kind, content, url, since=None):
        return {"id": f"gh:o/r:{ident}", "type": kind, "content": content, "provenance": origin(url, content, "git_history")} | ({"valid_from": since} if since else {})

    want = [
        record("issue:7", "issue", {"number": 7, "title": "é", "body": "", "state": "open", "labels": ["a", "b"]}, "h7", "2024-01-01T00:00:00Z"),
        record("issue:8", "issue", {"number": 8, "title": "x", "body": "", "state": "", "labels": []}, api + "issues/8", at),
        record("pr:9", "pull_request", {"number": 9, "title": "Fixes #8", "body": snap["pulls"][0]["body"], "state": "closed", "merged": True, "merge_commit_sha": "s"}, api + "pulls/9", at),
        record("pr:10", "pull_request", {"number": 10, "title": "y", "body": "see #7", "state": "", "merged": False, "merge_commit_sha": None}, "h10", "2024-02-01T00:00:00Z"),
        record("commit:abc", "commit", {"sha": "abc", "message": "m", "author": ""}, api + "commits/abc", at),
        record("file:a.py", "file", {"path": "a.py"}, "https://github.com/o/r/blob/HEAD/a.py"),
        record("file:tests/b.py", "test", {"path": "tests/b.py"}, "https://github.com/o/r/blob/HEAD/tests/b.py"),
    ]
    assert sorted(read("records.jsonl"), key=lambda r: r["id"]) == sorted(want, key=lambda r: r["id"])

    def edge(pr, relation, target, confidence, url, since, method):
        key = {"source": f"gh:o/r:pr:{pr}", "relation": relation, "target": f"gh:o/r:{target}"}
        return {**key, "confidence": confidence, "valid_from": since, "provenance": origin(url, key, method)}

    late = "2024-02-01T00:00:00Z"
    want = [
        edge(9, "modifies", "file:a.py", 1.0, api + "pulls/9/files", at, "git_history"), edge(9, "fixes", "issue:7", 0.95, api + "pulls/9", at, "human_label"),
        edge(10, "modifies", "file:a.py", 1.0, "h10", late, "git_history"), edge(10, "modifies", "file:tests/b.py", 1.0, "h10", late, "git_history"),
    ]
    key = lambda e: (e["source"], e["target"])
    assert sorted(read("edges.jsonl"), key=key) == sorted(want, key=key)


def test_candidate_lists(spark, tmp_path, capsys):
    """Metrics by task against plain Python, for the plain scorer and another; a leak ends with exit code 1."""
    from relquill.__main__ import main

    r = random.Random(9)
    words = ["parse", "tz", "normalizeRange", "data", "frame", "fix", "UTC-3", "é"]
    text = {f"r{k}": " ".join(r.choices(words, k=r.randint(0, 6))) for k in range(30)}
    records = [{"id": k, "type": "issue", "content": {"title": t, "n": 3}, "valid_from": "2024-01-02T00:00:00Z"} for k, t in text.items()]
    queries = []
    for k in range(14):
        pool = r.sample(sorted(text), r.randint(1, 9)) + ["lost"] * (k % 3 == 0)
        queries.append({"query_id": f"q{k}", "task": ["a", "b"][k % 2], "query_record": f"r{k}", "candidates": pool, "relevant": pool[:2] if k % 5 else [], "hard_negatives": pool[2:4] if k % 4 else None, "as_of": "2024-01-03T00:00:00Z"})
    queries.append({"query_id": "late", "task": "a", "query_record": "gone", "candidates": ["r1", "r2"], "relevant": ["r3"], "as_of": "2024-01-01T00:00:00Z"})
    (tmp_path / "benchmark").mkdir()
    (tmp_path / "records.jsonl").write_text("\n".join(map(json.dumps, records)) + "\n\n")
    for name in "ab":
        (tmp_path / "benchmark" / f"{name}.jsonl").write_text("\n".join(json.dumps(q) for q in queries if q["task"] == name))

    def tokens(t):
        return re.findall("[a-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", t).lower())

    def cosine(a, b):
        u, v = (Counter(zlib.crc32(w.encode()) % 1024 for w in tokens(t)) for t in (a, b))
        n = math.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values()))
        return sum(x * v[k] for k, x in u.items()) / n if n else 0.0

    whole = lambda k: f"{k}\nissue\n{text[k]}" if k in text else ""

    def metrics(task, score, ks):
        own, wins, rr, recall = [q for q in queries if q["task"] == task], [], [], {k: [] for k in ks}
        for q in own:
            ranked = sorted(set(q["candidates"]), key=lambda c: (-round(score(whole(q["query_record"]), whole(c)), 9), c))
            place = {c: n for n, c in enumerate(ranked, 1)}
            rel, hard = set(q["relevant"]), set(q.get("hard_negatives") or ())
            first = min((place[c] for c in rel if c in place), default=None)
            neg = min((place[c] for c in hard if c in place), default=None)
            rr.append(1 / first if first else 0)
            for k in ks:
                recall[k].append(len(rel & set(ranked[:k])) / len(rel) if rel else 0)
            if rel and hard:
                wins.append(float(first is not None and (neg is None or first < neg)))
        mean = lambda x: sum(x) / len(x) if x else 0.0
        return {"n_queries": len(own), **{f"recall_{k}": mean(recall[k]) for k in ks}, "mrr": mean(rr), "hard_negative_accuracy": mean(wins)}

    close = lambda got, want: got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert main(["bench", str(tmp_path), "--json"]) == 1
    shown = json.loads(capsys.readouterr().out)
    assert shown["leakage"] == ["late:r1", "late:r2", "late:r3"] and sorted(shown["tasks"]) == ["a", "b"]
    assert all(close(shown["tasks"][t], metrics(t, cosine, (1, 5, 10))) for t in "ab")
    assert main(["bench", str(tmp_path), "--task", "b"]) == 0
    length = lambda p: p.where("text <> ''").select("query_id", "cand", F.length("text").cast("double").alias("score"))
    result, _ = candidates.bench_folder(spark, str(tmp_path), scorer=length, ks=(2, 3))
    got = {x.pop("task"): x for x in (row.asDict() for row in result.collect())}
    assert all(close(got[t], metrics(t, lambda _, c: float(len(c)), (2, 3))) for t in "ab")
