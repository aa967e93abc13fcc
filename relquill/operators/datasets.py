"""Validation of whole datasets of JSON objects: records, edges, benchmark queries and cards, from one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.functions.text import iso_time
from relquill.operators.schemas import load_schema, member, violations
from relquill.sources.tables import discover, located_rows, materialise

#: The shape of each type of card, and above which confidence an inferred edge is a warning.
CARDS = {"source": "source-card", "dataset": "dataset-card", "experiment": "experiment-card"}
INFERRED = 0.9
FINDING = "struct<severity:string,code:string,location:string,detail:string>"


def kind(value: Column) -> Column:
    """card, edge, benchmark or record by the keys of a variant; shape where it is no object, json where it is null."""
    has = lambda key: member(value, key).isNotNull()
    known = F.when(has("card_type"), "card").when(has("relation"), "edge").when(has("query_record"), "benchmark").otherwise("record")
    return F.when(value.isNull(), "json").when(~F.schema_of_variant(value).startswith("OBJECT"), "shape").otherwise(known)


def checked(objects: DataFrame) -> DataFrame:
    """One row for each object (path, at, location, value): its kind, its own findings, and what is compared across objects.

    Findings are (severity, code, location, detail); a schema's are located below the object, and their detail is the rule.
    """
    v, here = F.col("value"), F.col("location")
    text = lambda path: F.try_variant_get(v, f"$.{path}", "string")
    ids = lambda key: F.coalesce(F.try_variant_get(v, f"$.{key}", "array<string>"), F.array().cast("array<string>"))
    finding = lambda severity, code, detail=None: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), here.alias("location"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))
    when = lambda broken, severity, code: F.when(F.coalesce(broken, F.lit(False)), F.array(finding(severity, code))).otherwise(F.array().cast(f"array<{FINDING}>"))

    def schema(name: str) -> Column:
        located = lambda x: F.when(x["path"] == "", here).otherwise(F.concat(here, F.lit(":"), x["path"]))
        return F.transform(violations(v, load_schema(name)), lambda x: F.struct(F.lit("error").alias("severity"), F.lit("schema").alias("code"), located(x).alias("location"), x["rule"].alias("detail")))

    def lacking(key: str, severity: str, code: str) -> Column:
        return F.transform(F.array_except(ids(key), ids("candidates")), lambda x: finding(severity, code, x))

    todo = when(text("provenance.content_hash") == "TODO", "error", "provenance.todo")
    unread = F.coalesce(text("provenance.retrieved_at"), F.lit("")) != ""
    record = F.concat(schema("record"), todo, when(unread & iso_time(text("provenance.retrieved_at")).isNull(), "error", "provenance.timestamp"))
    inferred = (F.try_variant_get(v, "$.provenance.observed", "boolean") == F.lit(False)) & (F.try_variant_get(v, "$.confidence", "double") > INFERRED)
    edge = F.concat(schema("edge"), when(F.coalesce(text("provenance.method"), F.lit("")) == "", "error", "provenance.method"), todo, when(inferred, "warning", "confidence.inferred"))
    benchmark = F.concat(schema("benchmark-query"), lacking("relevant", "error", "benchmark.relevant"), lacking("hard_negatives", "warning", "benchmark.hardneg"))
    card = when(~F.coalesce(text("card_type").isin(*CARDS), F.lit(False)), "error", "card.type")
    for name, shape in CARDS.items():
        card = F.when(text("card_type") == name, schema(shape)).otherwise(card)
    k = F.col("kind")
    found = F.when(k == "record", record).when(k == "edge", edge).when(k == "benchmark", benchmark).when(k == "card", card).when(k == "shape", F.array(finding("error", "shape")))
    refs = F.when(k == "edge", F.array(text("source"), text("target"))).when(k == "benchmark", F.concat(F.array(text("query_record")), ids("candidates")))
    rows = objects.withColumn("kind", kind(v))
    order = F.struct(F.col("path").endswith(".jsonl").alias("lines"), "path", "at")
    return rows.select("path", order.alias("order"), "location", "kind", F.coalesce(found, F.array().cast(f"array<{FINDING}>")).alias("found"), text("id").alias("id"), iso_time(text("valid_from")).alias("since"), refs.alias("refs"))


def validate(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, number of objects by kind) of (path, file, at, location, value).

    A file with an object that is no JSON counts as one finding, and its other objects play no part. Then: ids that an earlier
    record has (in the order of files and places), ends of edges and ids of queries that name no record, and edges that begin before an end does.
    """
    rows = materialise(checked(objects), "checked")
    bad = rows.where("kind = 'json'").select("path").distinct()
    rows = rows.join(bad, "path", "left_anti")
    null = F.lit(None).cast("string")
    broken = bad.select(F.lit("error").alias("severity"), F.lit("json").alias("code"), F.element_at(F.split("path", "/"), -1).alias("location"), null.alias("detail"))
    own = rows.select(F.explode("found").alias("f")).select("f.*")
    records = rows.where("kind = 'record' AND id IS NOT NULL")
    by_id = records.groupBy("id").agg(F.min("order").alias("first"), F.count("*").alias("n"), F.max_by("since", F.when(F.col("since").isNotNull(), F.col("order"))).alias("began"))
    twice = records.join(by_id.where("n > 1").select("id", "first"), "id").where("order <> first").select(F.lit("error").alias("severity"), F.lit("id.duplicate").alias("code"), "location", F.col("id").alias("detail"))
    refs = rows.where("refs IS NOT NULL").select("kind", "location", "since", F.explode("refs").alias("id")).where("id IS NOT NULL")
    ends = refs.join(by_id.select("id", "n", "began"), "id", "left")
    dangling = ends.where("n IS NULL").select(F.lit("error").alias("severity"), F.lit("ref.dangling").alias("code"), "location", F.col("id").alias("detail"))
    early = ends.where("kind = 'edge' AND since < began").select(F.lit("warning").alias("severity"), F.lit("temporal.inconsistent").alias("code"), "location", F.col("id").alias("detail"))
    findings = own.unionByName(broken).unionByName(twice).unionByName(dangling).unionByName(early)
    return findings, rows.where("kind <> 'shape'").groupBy("kind").count()


def validate_folder(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``validate`` over the JSON and JSON-lines files below ``root``, without schemas, templates and results."""
    paths = [r["path"] for r in discover(spark, root).where("NOT endswith(path, '.schema.json')").collect()]  # a row for each file
    return validate(located_rows(spark, paths))
