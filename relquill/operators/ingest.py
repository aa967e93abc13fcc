"""From raw repository snapshots to typed records and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relquill.functions.text import canonical_hash, canonical_json, closing_references, is_test_path

#: Shape of a snapshot: one row for each repository.
SNAPSHOT = (
    "repo string, license string, retrieved_at string, "
    "issues array<struct<number:int,title:string,body:string,state:string,html_url:string,created_at:string,labels:array<struct<name:string>>,pull_request:struct<url:string>>>, "
    "pulls array<struct<number:int,title:string,body:string,state:string,merged_at:string,merge_commit_sha:string,html_url:string,created_at:string>>, "
    "commits array<struct<sha:string,html_url:string,commit:struct<message:string,author:struct<name:string,date:string>>>>, "
    "pull_files map<string,array<struct<filename:string,status:string,additions:int,deletions:int>>>"
)
#: Where records and edges come from that state no page of their own.
API, PAGES = "https://api.github.com/repos/", "https://github.com/"


def identifier(kind: str, suffix) -> F.Column:
    return F.concat(F.lit("gh:"), "repo", F.lit(f":{kind}:"), suffix.cast("string"))


def _entries(snapshots: DataFrame, column: str) -> DataFrame:
    """(repo, license, retrieved_at, at, x): the entries of one feed; an unknown license and time are filled in."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return snapshots.select("repo", F.coalesce("license", F.lit("unknown")).alias("license"), F.coalesce("retrieved_at", now).alias("retrieved_at"), F.posexplode(column).alias("at", "x"))


def _page(path: F.Column, *suffix) -> F.Column:
    """An entry's own page, or its address in the service's interface."""
    return F.coalesce(F.nullif("x.html_url", F.lit("")), F.concat(F.lit(API), "repo", path, *suffix))


def _filled(column: str) -> F.Column:
    return F.coalesce(F.nullif(column, F.lit("")), "retrieved_at")


def _origin(url: F.Column, content: F.Column, method: str) -> F.Column:
    fields = {"source_url": url, "retrieved_at": F.col("retrieved_at"), "license": F.col("license"), "content_hash": F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256)), "transform": F.lit("relquill.operators.ingest"), "method": F.lit(method), "observed": F.lit(True)}
    return F.struct(*(x.alias(k) for k, x in fields.items()))


def records(snapshots: DataFrame) -> DataFrame:
    """(id, type, content, valid_from, provenance): issues (without the pull requests in their feed), pull requests, commits and changed files.

    The content is a variant with the fields of the type; its hash is that of its canonical JSON. Issues, pull requests and commits begin when
    they were made, or else when they were read; files have no begin. Of equal ids the last of the feed stays.
    """
    issue = _entries(snapshots, "issues").where("x.pull_request IS NULL")
    pull, commit = _entries(snapshots, "pulls"), _entries(snapshots, "commits")
    names = F.array_sort(F.filter(F.transform(F.coalesce("x.labels", F.array().cast("array<struct<name:string>>")), lambda v: v["name"]), lambda n: F.coalesce(n, F.lit("")) != ""))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = F.col("x.number")

    def of(df: DataFrame, kind: str, ident: F.Column, kinds: F.Column, since: F.Column, url: F.Column, **content: F.Column) -> DataFrame:
        held = canonical_json(**content)
        return df.select("at", identifier(kind, ident).alias("id"), kinds.alias("type"), held.alias("content"), since.alias("valid_from"), _origin(url, held, "git_history").alias("provenance"))

    shared = {"number": number, "title": text("x.title"), "body": text("x.body"), "state": text("x.state")}
    out = of(issue, "issue", number, F.lit("issue"), _filled("x.created_at"), _page(F.lit("/issues/"), number), **shared, labels=names)
    merged = F.coalesce(F.col("x.merged_at") != "", F.lit(False))
    out = out.unionByName(of(pull, "pr", number, F.lit("pull_request"), _filled("x.created_at"), _page(F.lit("/pulls/"), number), **shared, merged=merged, merge_commit_sha=F.col("x.merge_commit_sha")))
    out = out.unionByName(of(commit, "commit", F.col("x.sha"), F.lit("commit"), _filled("x.commit.author.date"), _page(F.lit("/commits/"), "x.sha"), sha=F.col("x.sha"), message=text("x.commit.message"), author=text("x.commit.author.name")))
    path = F.col("filename")
    changed = files(snapshots).withColumn("at", F.lit(0))
    file = of(changed, "file", path, F.when(is_test_path("filename"), "test").otherwise("file"), F.lit(None).cast("string"), F.concat(F.lit(PAGES), "repo", F.lit("/blob/HEAD/"), path), path=path)
    last = out.unionByName(file).groupBy("id").agg(F.max_by(F.struct("type", "content", "valid_from", "provenance"), "at").alias("r"))
    return last.select("id", "r.type", F.parse_json("r.content").alias("content"), "r.valid_from", "r.provenance")


def files(snapshots: DataFrame) -> DataFrame:
    """(repo, license, retrieved_at, number, filename, since, url): the changed files of the pull requests that the snapshot holds."""
    changed = snapshots.select("repo", F.explode("pull_files").alias("number", "fs")).select("repo", F.expr("try_cast(number AS int)").alias("number"), F.explode("fs").alias("f"))
    changed = changed.select("repo", "number", F.col("f.filename").alias("filename")).where("filename <> ''")
    pulls = _entries(snapshots, "pulls").select("repo", "license", "retrieved_at", F.col("x.number").alias("number"), _filled("x.created_at").alias("since"), _page(F.lit("/pulls/"), "x.number", F.lit("/files")).alias("url"))
    return changed.join(pulls, ["repo", "number"])


def closing_numbers(body: F.Column | str) -> F.Column:
    """The distinct numbers that a text closes, as integers: 007 is 7."""
    return F.array_distinct(F.filter(F.transform(closing_references(body), lambda n: n.try_cast("long")), lambda n: n.isNotNull()))


def edges(snapshots: DataFrame) -> DataFrame:
    """(source, relation, target, confidence, valid_from, provenance): ``modifies`` from pull requests to changed files, and ``fixes`` to the issues
    of the snapshot that a pull request's body closes, itself left out.

    Edges begin when the pull request was made, or else when it was read.
    """
    source = identifier("pr", F.col("number"))

    def of(df: DataFrame, relation: str, target: F.Column, confidence: float, method: str) -> DataFrame:
        named = df.select("*", source.alias("source"), F.lit(relation).alias("relation"), target.alias("target"))
        key = canonical_json(source=F.col("source"), relation=F.col("relation"), target=F.col("target"))
        return named.select("source", "relation", "target", F.lit(confidence).alias("confidence"), F.col("since").alias("valid_from"), _origin(F.col("url"), key, method).alias("provenance"))

    modifies = of(files(snapshots), "modifies", identifier("file", F.col("filename")), 1.0, "git_history")
    pulls = _entries(snapshots, "pulls").select("repo", "license", "retrieved_at", F.col("x.number").alias("number"), _filled("x.created_at").alias("since"), _page(F.lit("/pulls/"), "x.number").alias("url"), F.explode(closing_numbers("x.body")).alias("n"))
    fixes = of(pulls.where("n <> number"), "fixes", identifier("issue", F.col("n")), 0.95, "human_label")
    known = _entries(snapshots, "issues").where("x.pull_request IS NULL").select(identifier("issue", F.col("x.number")).alias("target")).distinct()
    return modifies.unionByName(fixes.join(known, "target", "left_semi").select(*modifies.columns))


def provenance(url, retrieved_at, license, method, *hashed: str) -> F.Column:
    """A record's origin: where and when it was read, its license, how it was made, and a hash of its content."""
    fields = {"source_url": url, "retrieved_at": retrieved_at, "license": license, "content_hash": canonical_hash(*hashed), "transform": F.lit("relquill.operators.ingest"), "method": method, "observed": F.lit(True)}
    return F.struct(*(x.alias(k) for k, x in fields.items()))


def source_card(records: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts of records by type and of edges by relation, as maps in order of their keys."""
    counted = lambda df, key, name: df.groupBy(key).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "count")))).alias(name))  # noqa: E731  a row for each kind
    return counted(records, "type", "record_counts").join(counted(edges, "relation", "edge_counts"))


def enriched(modifies: DataFrame, fixing: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (source, target) of the ``fixing`` sources to known targets, valid from the later of both ends' times.

    ``nodes``: id, valid_from.
    """
    at = lambda end: nodes.select(F.col("id").alias(end), F.col("valid_from").alias(f"{end}_from"))
    own = modifies.join(fixing.select("source").distinct(), "source", "left_semi").select("source", "target").distinct()
    return own.join(at("source"), "source").join(at("target"), "target").select("source", "target", F.greatest("source_from", "target_from").alias("valid_from"))


def densified(changes: DataFrame, is_test: F.Column, known: DataFrame) -> DataFrame:
    """(source, target): changed tests of the sources that change any, as far as the edge isn't ``known``."""
    return changes.where(is_test).select("source", "target").distinct().join(known, ["source", "target"], "left_anti")
