"""Data-quality checks; each gives findings (severity, code, location)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relquill.functions.text import iso_time


def _finding(df: DataFrame, severity: str, code: str, location) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), location.cast("string").alias("location"))


def duplicate_ids(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Every row after the first with the same key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return _finding(df.withColumn("_n", F.row_number().over(w)).where("_n > 1"), "error", "id.duplicate", F.col(order))


def dangling(refs: DataFrame, ref: str, known: DataFrame, key: str) -> DataFrame:
    """References that name no known row."""
    return _finding(refs.join(known.select(F.col(key).alias("_k")).distinct(), F.col(ref) == F.col("_k"), "left_anti"), "error", "ref.dangling", F.col(ref))


def temporal(edges: DataFrame, edge_time: str, node_time: str, location: str) -> DataFrame:
    """Edges that begin before their endpoint; null times pass."""
    return _finding(edges.where(F.col(edge_time) < F.col(node_time)), "warning", "temporal.inconsistent", F.col(location))


def _broken(value: Column, kind: str, arg) -> Column:
    """True where ``value`` breaks the rule; a null breaks ``required`` alone."""
    if kind == "required":
        return value.isNull()
    fits = {"enum": lambda: value.isin(*arg), "range": lambda: value.between(*arg), "pattern": lambda: value.rlike(arg), "keys": lambda: F.size(F.array_except(F.json_object_keys(value), F.array(*map(F.lit, arg)))) <= 0}
    return F.coalesce(~fits[kind](), F.lit(False))


def conformance(df: DataFrame, rules: list[tuple[str, str, object]], location: str) -> DataFrame:
    """Each broken rule of each row, in one scan.

    ``rules``: (column, kind, argument) with kind ``required``, ``enum`` (values), ``range`` (least, most), ``pattern``
    (regular expression found in the text) or ``keys`` (the only keys that a JSON object may have).
    """
    broken = F.array_compact(F.array(*(F.when(_broken(F.col(c), kind, arg), F.lit(f"{kind}:{c}")) for c, kind, arg in rules)))
    return df.withColumn("_rule", F.explode(broken)).select(F.lit("error").alias("severity"), F.lit("schema").alias("code"), F.col(location).cast("string").alias("location"), F.col("_rule").alias("rule"))


def json_shape(df: DataFrame, text: str, location: str) -> DataFrame:
    """Texts that aren't JSON (json) or are JSON but no object (shape). A null, or an object that repeats a key, isn't JSON.

    The parser stops after the first value. So the text must be the one element of an array, and the value of an object, too:
    a text that closes the one early doesn't fit in the other.
    """
    wrap = lambda a, b: F.try_parse_json(F.concat(F.lit(a), F.col(text), F.lit(b)))
    inside = F.try_variant_get(wrap("[", "]"), "$", "array<variant>")
    whole = F.coalesce((F.size(inside) == 1) & wrap('{"v":', "}").isNotNull(), F.lit(False))
    code = F.when(~whole, "json").when(~F.schema_of_variant(F.element_at(inside, 1)).startswith("OBJECT"), "shape")
    return df.withColumn("_code", code).where("_code IS NOT NULL").select(F.lit("error").alias("severity"), F.col("_code").alias("code"), F.col(location).cast("string").alias("location"))


def dispatched(df: DataFrame, kind: str, rules: dict[str, list[tuple[str, str, object]]], location: str) -> DataFrame:
    """Rows judged by the rules of their kind; a kind that has none, or a null, is a finding of its own (card.type)."""
    known = F.coalesce(F.col(kind).isin(*rules), F.lit(False))
    out = df.where(~known).select(F.lit("error").alias("severity"), F.lit("card.type").alias("code"), F.col(location).cast("string").alias("location"), F.lit(None).cast("string").alias("rule"))
    for k, own in rules.items():
        out = out.unionByName(conformance(df.where(F.col(kind) == k), own, location))
    return out


def _findings(df: DataFrame, rules: list[tuple[str, str, Column]], location: str) -> DataFrame:
    """A finding for each rule (severity, code, condition) that holds, in one scan; null conditions don't hold."""
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(k).alias("code"))) for s, k, c in rules)))
    return df.select(F.col(location).cast("string").alias("location"), F.explode(found).alias("f")).select("f.severity", "f.code", "location")


def record_provenance(df: DataFrame, location: str, content_hash: str, retrieved_at: str) -> DataFrame:
    """Records whose hash is a placeholder (provenance.todo) or whose time can't be read (provenance.timestamp)."""
    unread = (F.col(retrieved_at) != "") & iso_time(retrieved_at).isNull()
    return _findings(df, [("error", "provenance.todo", F.col(content_hash) == "TODO"), ("error", "provenance.timestamp", unread)], location)


def edge_provenance(df: DataFrame, location: str, method: str, content_hash: str, observed: str, confidence: str, most: float = 0.9) -> DataFrame:
    """Edges without a method, with a placeholder for a hash, or inferred with a confidence above ``most`` (a warning)."""
    rules = [
        ("error", "provenance.method", F.coalesce(F.col(method), F.lit("")) == ""), ("error", "provenance.todo", F.col(content_hash) == "TODO"),
        ("warning", "confidence.inferred", ~F.col(observed) & (F.col(confidence) > most)),
    ]
    return _findings(df, rules, location)


def benchmark_lists(df: DataFrame, location: str, candidates: str = "candidates", relevant: str = "relevant", hard: str = "hard_negatives") -> DataFrame:
    """Relevant ids (errors) and hard negatives (warnings) that are not among the candidates: a finding for each id."""
    pool = F.coalesce(F.col(candidates), F.array().cast(df.schema[candidates].dataType))
    lacking = lambda c: F.filter(F.coalesce(F.col(c), pool), lambda x: ~F.array_contains(pool, x))
    one = lambda c, s, k: df.select(F.lit(s).alias("severity"), F.lit(k).alias("code"), F.col(location).cast("string").alias("location"), F.explode(lacking(c)).alias("ref"))
    return one(relevant, "error", "benchmark.relevant").union(one(hard, "warning", "benchmark.hardneg"))


def query_leaks(queries: DataFrame, records: DataFrame) -> DataFrame:
    """(query_id, id): candidates or relevant ids that begin after the query's as_of. ``records``: id, valid_from."""
    named = queries.select("query_id", "as_of", F.explode(F.array_union("candidates", "relevant")).alias("id"))
    return named.join(records.select("id", "valid_from"), "id").where("valid_from > as_of").select("query_id", "id").distinct()


def split_disjoint(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """Findings on a split by groups: groups in both splits (also by the name after the slash), test candidates of a train group.

    ``groups``: grp, split; ``candidates``: query_id, split (of the query), grp (of the candidate).
    """
    sides = groups.select("grp", "split").distinct()
    base = F.element_at(F.split("grp", "/"), -1)
    twice = lambda key, code: sides.groupBy(key.alias("g")).agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.lit("error").alias("severity"), F.lit(code).alias("code"), F.col("g").alias("location"))
    train = sides.where("split = 'train'").select("grp")
    leak = candidates.where("split = 'test'").join(train, "grp", "left_semi").select(F.lit("error").alias("severity"), F.lit("split.candidate").alias("code"), F.col("query_id").cast("string").alias("location")).distinct()
    return twice(F.col("grp"), "split.group").union(twice(base, "split.fork")).union(leak)


def graph_integrity(edges: DataFrame, nodes: DataFrame, source_type: str, target_types: tuple[str, ...]) -> DataFrame:
    """Edges whose source or target isn't of its type, and nodes without a real hash. ``nodes``: id, type, content_hash."""
    typed = lambda kinds, end: nodes.where(F.col("type").isin(*kinds)).select(F.col("id").alias(end))
    wrong = lambda end, kinds: edges.join(typed(kinds, end), end, "left_anti").select(F.lit("error").alias("severity"), F.lit(f"graph.{end}").alias("code"), F.col(end).cast("string").alias("location")).distinct()
    unhashed = nodes.where(~F.coalesce(F.col("content_hash").rlike("^sha256:[0-9a-f]{64}$"), F.lit(False)))
    return wrong("source", (source_type,)).union(wrong("target", target_types)).union(_finding(unhashed, "error", "graph.hash", F.col("id")))


def report(findings: DataFrame) -> DataFrame:
    """One row: errors, warnings, ok (no errors)."""
    errors = F.count_if(F.col("severity") == "error")
    return findings.agg(errors.alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), (errors == 0).alias("ok"))


def rollup(findings: DataFrame) -> DataFrame:
    """Counts by severity and code, with subtotals and a total (null where summed over)."""
    return findings.rollup("severity", "code").agg(F.count("*").alias("n"))
