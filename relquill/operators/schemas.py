"""Record shapes as schema documents, and their compiler to Column expressions over JSON values."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The kinds that records, relations, tasks, methods, splits and redistribution may have.
TYPES = ("issue", "pull_request", "commit", "diff", "file", "symbol", "test", "ci_log", "tool", "agent_run")
RELATIONS = (
    "implements", "fixes", "modifies", "covers", "calls", "depends_on", "duplicates", "fails_on", "caused_by", "regresses", "mitigated_by", "requires_tool", "suitable_agent", "blocks", "enables",
    "safe_to_parallelize",
)
TASKS = ("issue_to_fixing_pr", "diff_to_affected_test", "log_to_likely_file", "pr_to_missing_test")
METHODS = ("static_analysis", "test_coverage", "git_history", "review", "ci_log", "human_label", "agent_trace", "synthetic")
SPLITS = ("train", "dev", "test")
REDISTRIBUTION = ("metadata_only", "snippets_permitted", "full_text", "synthetic_original")
HASH = "^(sha256:[0-9a-f]{64}|TODO)$"

WORD, TEXT, FLAG, WHOLE = {"type": "string", "minLength": 1}, {"type": "string"}, {"type": "boolean"}, {"type": "integer"}
OPTIONAL_TEXT = {"type": ["string", "null"]}
COUNT, SHARE = {"type": "integer", "minimum": 0}, {"type": "number", "minimum": 0, "maximum": 1}


def one_of(*values: str) -> dict:
    return {"type": "string", "enum": list(values)}


def listed(items: dict, least: int = 0) -> dict:
    return {"type": "array", "items": items} | ({"minItems": least} if least else {})


def mapped(values: dict) -> dict:
    return {"type": "object", "additionalProperties": values}


def closed(required: str, **properties: dict) -> dict:
    """An object with no other keys; ``required`` names those that it must have."""
    return {"type": "object", "required": required.split(), "additionalProperties": False, "properties": properties}


ORIGIN = {"$ref": "provenance"}
#: What each shape requires and admits.
SCHEMAS = {
    "provenance": closed(
        "source_url retrieved_at license content_hash",
        source_url=WORD, retrieved_at=TEXT, license=WORD, content_hash={"type": "string", "pattern": HASH}, transform=TEXT, method=one_of(*METHODS), observed=FLAG,
    ),
    "record": closed(
        "id type provenance",
        id=WORD, type=one_of(*TYPES), content={"type": "object"}, provenance=ORIGIN, valid_from=WORD, valid_until=OPTIONAL_TEXT, split=one_of(*SPLITS), attributes={"type": "object"},
    ),
    "edge": closed(
        "source relation target confidence provenance",
        source=WORD, relation=one_of(*RELATIONS), target=WORD, confidence=SHARE, valid_from=WORD, valid_until=OPTIONAL_TEXT, provenance={"allOf": [ORIGIN]},
    ),
    "benchmark-query": closed(
        "query_id task query_record candidates relevant",
        query_id=WORD, task=one_of(*TASKS), query_record=WORD, candidates=listed(WORD, 1), relevant=listed(WORD), hard_negatives=listed(WORD), as_of=TEXT,
    ),
    "source-card": closed(
        "card_type id name source_url retrieved_at license record_types redistribution",
        card_type={"const": "source"}, id=WORD, name=WORD, source_url=WORD, retrieved_at=TEXT, license=WORD, terms_note=TEXT, record_types=listed(one_of(*TYPES), 1), transform=TEXT,
        content_hash={"type": "string", "pattern": HASH}, redistribution=one_of(*REDISTRIBUTION), notes=TEXT,
    ),
    "dataset-card": closed(
        "card_type id name version created_at sources record_counts edge_counts relation_types split_policy redistribution",
        card_type={"const": "dataset"}, id=WORD, name=WORD, version=WORD, created_at=TEXT, sources=listed(TEXT, 1), record_counts=mapped(COUNT), edge_counts=mapped(COUNT), relation_types=listed(TEXT, 1),
        split_policy=closed("frozen method", frozen=FLAG, method=TEXT, seed={"type": ["integer", "null"]}, boundary=TEXT), redistribution=one_of(*REDISTRIBUTION, "mixed"), known_limitations=listed(TEXT), notes=TEXT,
    ),
    "experiment-card": closed(
        "card_type id name created_at hypothesis task dataset_version code_version seed command system metrics exploratory",
        card_type={"const": "experiment"}, id=WORD, name=WORD, created_at=TEXT, hypothesis=WORD, task=one_of(*TASKS), dataset_version=WORD, code_version=WORD, seed=WHOLE, command=WORD, system=TEXT, runtime_class=TEXT,
        metrics={"type": "object", "additionalProperties": False, "properties": {"recall_at_k": mapped(SHARE), "mrr": SHARE, "hard_negative_accuracy": SHARE, "n_queries": COUNT}},
        baseline_comparison=TEXT, error_slices=listed(TEXT), leakage_checks=listed(TEXT), known_limitations=listed(TEXT), exploratory=FLAG,
    ),
}


def load_schema(name: str, schemas: dict | None = None) -> dict:
    """The document of ``name`` with all references resolved."""
    schemas = SCHEMAS if schemas is None else schemas

    def resolved(x):
        if isinstance(x, dict):
            return load_schema(x["$ref"], schemas) | {k: resolved(v) for k, v in x.items() if k != "$ref"} if "$ref" in x else {k: resolved(v) for k, v in x.items()}
        return [resolved(v) for v in x] if isinstance(x, list) else x

    return resolved(schemas[name])


def all_schemas() -> dict[str, dict]:
    return {name: load_schema(name) for name in SCHEMAS}


VIOLATIONS = "array<struct<path:string,rule:string>>"


def member(value: Column, key: str) -> Column:
    """A key's value as a variant: null where the key is missing, a variant null where it holds null."""
    return F.try_variant_get(value, f"$.{key}", "variant")


def is_type(bound: Column, name: str) -> Column:
    """Whether a value has a JSON type; 1.0 is an integer too. ``bound``: kind and number of the value."""
    number = bound["kind"].rlike("^(BIGINT|INT|SMALLINT|TINYINT|FLOAT|DOUBLE|DECIMAL)")
    if name in ("number", "integer"):
        return number if name == "number" else number & (bound["number"] == F.floor(bound["number"]))
    return bound["kind"].startswith({"string": "STRING", "boolean": "BOOLEAN", "null": "VOID", "object": "OBJECT", "array": "ARRAY"}[name])


def violations(value: Column, schema: dict, path: tuple = ()) -> Column:
    """The rules of a (resolved) schema that a variant breaks, as an array of (path, rule): one for each rule and place.

    Known rules: type, const, enum, minLength, pattern, minimum, maximum, minItems, items, required, properties,
    additionalProperties and allOf; texts are the only constants. A rule for other types than the value's own holds, and all
    hold for a null column, which is no value.
    """
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    bound = F.struct(value.alias("value"), F.schema_of_variant(value).alias("kind"), text.alias("text"), number.alias("number"))
    # a lambda over one element looks at the value once, however many rules there are
    found = F.element_at(F.transform(F.array(bound), lambda x: _broken(x, schema, path)), 1)
    return F.when(value.isNotNull(), found).otherwise(F.array().cast(VIOLATIONS))


def _broken(bound: Column, schema: dict, path: tuple) -> Column:
    value, text, number = bound["value"], bound["text"], bound["number"]
    where = F.concat_ws("/", *path) if path else F.lit("")
    none = F.array().cast(VIOLATIONS)
    of = lambda name: is_type(bound, name)
    out: list[Column] = []

    def fail(broken: Column, rule: str) -> None:
        out.append(F.when(F.coalesce(broken, F.lit(False)), F.array(F.struct(where.alias("path"), F.lit(rule).alias("rule")))).otherwise(none))

    for part in schema.get("allOf", ()):
        out.append(violations(value, part, path))
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        fail(~reduce(or_, map(of, names)), "type")
    for rule in ("const", "enum"):
        if rule in schema:
            fail(~(of("string") & text.isin(*([schema[rule]] if rule == "const" else schema[rule]))), rule)
    if "minLength" in schema:
        fail(of("string") & (F.char_length(text) < schema["minLength"]), "minLength")
    if "pattern" in schema:
        fail(of("string") & ~text.rlike(schema["pattern"]), "pattern")
    if "minimum" in schema:
        fail(of("number") & (number < schema["minimum"]), "minimum")
    if "maximum" in schema:
        fail(of("number") & (number > schema["maximum"]), "maximum")
    for key in schema.get("required", ()):
        fail(of("object") & member(value, key).isNull(), f"required:{key}")
    properties = schema.get("properties", {})
    for key, own in properties.items():
        out.append(violations(member(value, key), own, (*path, F.lit(key))))
    other = schema.get("additionalProperties", True)
    if other is not True:
        fields = F.try_variant_get(value, "$", "map<string,variant>")
        if other is False:
            fail(F.size(F.array_except(F.map_keys(fields), F.array(*map(F.lit, properties)).cast("array<string>"))) > 0, "additionalProperties")
        else:
            found = F.flatten(F.transform(F.map_entries(F.map_filter(fields, lambda k, _: ~k.isin(*properties) if properties else F.lit(True))), lambda e: violations(e["value"], other, (*path, e["key"]))))
            out.append(F.coalesce(found, none))
    if "items" in schema or "minItems" in schema:
        items = F.try_variant_get(value, "$", "array<variant>")
        if "minItems" in schema:
            fail(of("array") & (F.size(items) < schema["minItems"]), "minItems")
        if "items" in schema:
            found = F.flatten(F.transform(items, lambda x, k: violations(x, schema["items"], (*path, k.cast("string")))))
            out.append(F.coalesce(found, none))
    return F.concat(*out) if out else none
