"""Queries on records, provenance and data quality, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from relquill.functions import text as T
from relquill.operators import candidates, ingest, schemas, validation
from relquill.plans.catalogue import query
from relquill.sources.tables import ragged, table

# -- text of records ------------------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, sha256(concat_ws(chr(10), nullif(conv_id::VARCHAR, ''), 'turn', nullif(text, ''), nullif(role, ''))) AS h, length(concat_ws(chr(10), nullif(conv_id::VARCHAR, ''), 'turn', nullif(text, ''), nullif(role, ''))) AS n FROM conversations")
def record_texts(s, d):
    """Text views of records whose content is a JSON object with string and other fields."""
    content = F.to_json(F.struct("role", F.col("turn").alias("number"), "text", F.lit("").alias("body")))
    t = table(s, d, "conversations").select("conv_id", "turn", T.record_text(content, F.col("conv_id"), F.lit("turn")).alias("t"))
    return t.select("conv_id", "turn", F.sha2(F.col("t").cast("binary"), 256).alias("h"), F.length("t").cast("long").alias("n"))


@query("SELECT page_id, sha256(trim(coalesce(regexp_replace(url, '#[0-9]+', ' ', 'g'), '') || ' ' || 'issue')) AS h FROM (SELECT page_id, CASE WHEN url IS NULL THEN NULL ELSE 'page' END AS url FROM pages)")
def scrubbed_records(s, d):
    """Title and body scrubbed and joined; a null title is empty."""
    title = F.when(F.col("url").isNotNull(), F.lit("page #12"))
    return table(s, d, "pages").select("page_id", F.sha2(T.scrubbed_record(title, F.lit("issue gh-7")).cast("binary"), 256).alias("h"))


@query("SELECT doc_id, length(left(coalesce(text, ''), 500)) AS n_500, length(left(coalesce(text, ''), 8000)) AS n_8000, sha256(left(coalesce(text, ''), 500)) AS h FROM documents")
def body_caps(s, d):
    """The capped bodies that snapshots keep."""
    t = table(s, d, "documents")
    return t.select("doc_id", *(F.length(T.capped("text", n)).cast("long").alias(f"n_{n}") for n in (500, 8000)), F.sha2(T.capped("text", 500).cast("binary"), 256).alias("h"))


@query("SELECT o_orderkey, 'gh:c' || o_custkey || '/x:pr:' || o_orderkey AS id, 'gh-t2:c' || o_custkey || '/x:pr:' || o_orderkey AS moved, 'c' || o_custkey || '/x' AS repo, 'pr' AS kind, o_orderkey::VARCHAR AS suffix FROM orders")
def identifiers(s, d):
    """Identifiers made, taken apart and moved to another name space."""
    o = table(s, d, "orders").select("o_orderkey", T.identifier("pr", F.concat(F.lit("c"), "o_custkey", F.lit("/x")), "o_orderkey").alias("id"))
    p = o.withColumn("p", T.identifier_parts("id"))
    return p.select("o_orderkey", "id", T.renamed_space("id", "gh", "gh-t2").alias("moved"), "p.repo", "p.kind", "p.suffix")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::TIMESTAMP END AS t FROM orders")
def iso_times(s, d):
    """Times read from ISO texts, null from texts that are none."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("o_orderstatus") == "P", F.lit("last week")).when(F.col("o_orderstatus") == "F", F.concat(day, F.lit("Z"))).otherwise(F.concat(day, F.lit("+00:00")))
    return table(s, d, "orders").select("o_orderkey", T.iso_time(text).cast("timestamp_ntz").alias("t"))


AUDIT = r"""WITH b AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Fixes ' || doc_id WHEN 1 THEN 'closed: gh-' || doc_id WHEN 2 THEN 'resolves#' || doc_id ELSE 'see #' || doc_id END || ' ' || coalesce(text, '') AS body FROM documents),
r AS (SELECT doc_id, list_distinct(regexp_extract_all(body, '(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)[:\s]+(?:#|gh-)?([0-9]+)', 1)) AS refs FROM b)"""


def audited(s, d):
    k = F.col("doc_id") % 4
    head = F.when(k == 0, F.concat(F.lit("Fixes "), "doc_id")).when(k == 1, F.concat(F.lit("closed: gh-"), "doc_id")).when(k == 2, F.concat(F.lit("resolves#"), "doc_id")).otherwise(F.concat(F.lit("see #"), "doc_id"))
    return table(s, d, "documents").select("doc_id", T.closing_references(F.concat(head, F.lit(" "), F.coalesce("text", F.lit(""))), T.AUDITED).alias("refs"))


@query(f"{AUDIT} SELECT doc_id, len(refs) AS n, list_contains(refs, doc_id::VARCHAR) AS own FROM r")
def audit_references(s, d):
    """The audit's stricter closing references, over generated first lines and the texts."""
    return audited(s, d).select("doc_id", F.size("refs").cast("long").alias("n"), F.array_contains("refs", F.col("doc_id").cast("string")).alias("own"))


@query(f"""{AUDIT}, x AS (SELECT doc_id, list_contains(refs, doc_id::VARCHAR) AS hit, doc_id % 4 < 3 AS typed, CASE doc_id % 3 WHEN 0 THEN 'human_label' WHEN 1 THEN 'git_history' END AS method FROM r)
SELECT method, count(*) AS n_edges, round(avg(hit::INTEGER), 6) AS fixes_precision, round(avg(typed::INTEGER), 6) AS modifies_precision FROM x GROUP BY ROLLUP (method) ORDER BY 1""")
def label_construction_precision(s, d):
    """Share of edges whose source closes the target by its text, and of edges whose ends have the right types; edges by method."""
    k = F.col("doc_id")
    x = audited(s, d).select(F.array_contains("refs", k.cast("string")).alias("hit"), F.concat(F.lit("gh:r:pr:"), k).alias("source"), F.concat(F.when(k % 4 < 3, F.lit("gh:r:file:")).otherwise(F.lit("gh:r:issue:")), k).alias("target"), F.when(k % 3 == 0, "human_label").when(k % 3 == 1, "git_history").alias("method"))
    typed = F.col("source").contains(":pr:") & F.col("target").rlike(":(file|test):")
    return x.rollup("method").agg(F.count("*").alias("n_edges"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("fixes_precision"), F.round(F.avg(typed.cast("int")), 6).alias("modifies_precision"))


@query("SELECT p_partkey, coalesce(p_brand IN ('Brand#1', 'Brand#2', 'Brand#13'), false) OR (p_size > 25 AND coalesce(p_brand IN ('NOASSERTION', ''), true)) AS allowed FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN 'NOASSERTION' ELSE p_brand END AS p_brand FROM part)")
def license_predicates(s, d):
    """Allow-listed licenses, and unknown ones of curated sources."""
    k = F.col("p_partkey") % 5
    brand = F.when(k == 0, None).when(k == 1, "NOASSERTION").otherwise(F.col("p_brand"))
    return table(s, d, "part").select("p_partkey", T.license_allowed(brand, ("Brand#1", "Brand#2", "Brand#13"), F.col("p_size") > 25).alias("allowed"))


@query("SELECT event_id, CASE WHEN user_id % 5 = 4 THEN NULL WHEN user_id % 5 = 0 THEN 'card' WHEN user_id % 5 = 1 THEN 'edge' WHEN user_id % 5 = 2 THEN 'benchmark' ELSE 'record' END AS kind FROM events")
def classify_objects(s, d):
    """Objects told apart by their keys; a card's key goes first, and what is no object has no kind."""
    k = F.col("user_id") % 5
    obj = F.when(k == 0, '{"card_type": "x", "relation": 1}').when(k == 1, '{"relation": "fixes"}').when(k == 2, '{"id": 1, "query_record": {}}').when(k == 3, '{"id": 1}').otherwise('[{"relation": 1}]')
    return table(s, d, "events").select("event_id", T.kind_of(obj).alias("kind"))


@query("""SELECT vec_id, ix AS chunk_ix, embedding[ix + 1]::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest(range(0, 1 + vec_id % 7)) AS ix FROM embeddings)""")
def ragged_chunks(s, d):
    """Rows of compressed sparse form, by label, taken apart again."""
    e = table(s, d, "embeddings").select("vec_id", "label", F.slice("embedding", 1, (F.col("vec_id") % 7 + 1).cast("int")).alias("v"))
    rows = F.array_sort(F.collect_list(F.struct("vec_id", "v")))
    packed = e.groupBy("label", (F.col("vec_id") % 64).alias("block")).agg(rows.alias("r"))
    ends = F.aggregate("r", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.size(x["v"]))))
    packed = packed.select(F.transform("r", lambda x: x["vec_id"]).alias("ids"), ends.alias("offsets"), F.flatten(F.transform("r", lambda x: x["v"])).alias("vals"))
    return ragged(packed, "ids", "offsets", "vals").select(F.col("id").alias("vec_id"), F.col("chunk_ix").cast("long").alias("chunk_ix"), F.col("value").cast("double").alias("value"))


# -- ingest ---------------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, 'https://x/' || p_partkey AS source_url, 'sha256:' || sha256('{"p_brand":"' || p_brand || '","p_partkey":' || p_partkey || ',"p_size":' || p_size || '}') AS content_hash, 'git_history' AS method, true AS observed FROM part""")
def provenance_records(s, d):
    p = ingest.provenance(F.concat(F.lit("https://x/"), "p_partkey"), F.lit("2024-01-01T00:00:00Z"), F.lit("MIT"), F.lit("git_history"), "p_partkey", "p_brand", "p_size")
    return table(s, d, "part").select("p_partkey", p.alias("p")).select("p_partkey", "p.source_url", "p.content_hash", "p.method", "p.observed")


@query("""SELECT 'record' AS part, event_type AS key, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'edge', l_returnflag, count(*) FROM lineitem GROUP BY ALL""")
def source_cards(s, d):
    """Counts of records and edges by kind, as a card's maps hold them."""
    card = ingest.source_card(table(s, d, "events").select(F.col("event_type").alias("type")), table(s, d, "lineitem").select(F.col("l_returnflag").alias("relation")))
    one = lambda c, name: card.select(F.lit(name).alias("part"), F.explode(c).alias("key", "n"))
    return one("record_counts", "record").union(one("edge_counts", "edge"))


@query("""SELECT DISTINCT o_orderkey AS source, l_partkey AS target, greatest(o_orderdate, TIMESTAMP '1995-01-01' + to_days((p_partkey % 1000)::INTEGER)) AS valid_from FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'F' AND p_size > 10""")
def graph_enrichment(s, d):
    """Edges of the fixing orders to known parts, valid from the later of both."""
    o = table(s, d, "orders")
    li = table(s, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"))
    since = F.expr("timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(int(p_partkey % 1000))")
    nodes = o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("valid_from"))
    nodes = nodes.union(table(s, d, "part").where("p_size > 10").select(F.concat(F.lit("p"), "p_partkey"), since))
    out = ingest.enriched(li, o.where("o_orderstatus = 'F'").select(F.concat(F.lit("o"), "o_orderkey").alias("source")), nodes)
    return out.select(F.substring("source", 2, 20).cast("long").alias("source"), F.substring("target", 2, 20).cast("long").alias("target"), "valid_from")


@query("""SELECT DISTINCT l_orderkey AS source, l_partkey AS target FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 10 EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1""")
def test_densification(s, d):
    """Edges to small parts, taken as tests, that the first line doesn't hold already."""
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), "l_linenumber")
    p = table(s, d, "part").select(F.col("p_partkey").alias("target"), "p_size")
    return ingest.densified(li.join(p, "target"), F.col("p_size") <= 10, li.where("l_linenumber = 1").select("source", "target").distinct())


# -- data quality -----------------------------------------------------------------------------------------------------------


@query("""SELECT 'error' AS severity, 'provenance.todo' AS code, o_orderkey::VARCHAR AS location FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'error', 'provenance.timestamp', o_orderkey::VARCHAR FROM orders WHERE o_orderpriority = '1-URGENT'""")
def validate_record_provenance(s, d):
    hashed = F.when(F.col("o_orderstatus") == "F", "TODO").when(F.col("o_orderstatus") == "O", "sha256:0")
    at = F.when(F.col("o_orderpriority") == "1-URGENT", "soon").when(F.col("o_orderpriority") == "2-HIGH", "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return validation.record_provenance(table(s, d, "orders").withColumn("h", hashed).withColumn("at", at), "o_orderkey", "h", "at")


@query("""WITH e AS (SELECT l_orderkey || ':' || l_linenumber AS location, nullif(l_returnflag, 'N') AS method, CASE WHEN l_linenumber = 7 THEN 'TODO' END AS h, l_linestatus = 'O' AS observed, l_discount * 10 AS confidence FROM lineitem)
SELECT 'error' AS severity, 'provenance.method' AS code, location FROM e WHERE coalesce(method, '') = '' UNION ALL SELECT 'error', 'provenance.todo', location FROM e WHERE h = 'TODO'
UNION ALL SELECT 'warning', 'confidence.inferred', location FROM e WHERE NOT observed AND confidence > 0.9""")
def validate_edge_provenance(s, d):
    e = table(s, d, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("location"), F.nullif("l_returnflag", F.lit("N")).alias("method"), F.when(F.col("l_linenumber") == 7, "TODO").alias("h"), (F.col("l_linestatus") == "O").alias("observed"), (F.col("l_discount") * 10).alias("confidence"))
    return validation.edge_provenance(e, "location", "method", "h", "observed", "confidence")


def order_lists(s, d):
    """(query_id, candidates, relevant, hard_negatives): parts of each order's lines 1 to 3, 2 to 4 and 3 to 5."""
    li = table(s, d, "lineitem")
    part = lambda lo, hi: F.array_sort(F.collect_set(F.when(F.col("l_linenumber").between(lo, hi), F.col("l_partkey"))))
    return li.groupBy(F.col("l_orderkey").alias("query_id")).agg(part(1, 3).alias("candidates"), part(2, 4).alias("relevant"), part(3, 5).alias("hard_negatives"))


LISTS = "q AS (SELECT l_orderkey AS query_id, " + ", ".join(f"coalesce(list(DISTINCT l_partkey) FILTER (l_linenumber BETWEEN {lo} AND {hi}), []) AS {n}" for n, lo, hi in (("candidates", 1, 3), ("relevant", 2, 4), ("hard_negatives", 3, 5))) + " FROM lineitem GROUP BY l_orderkey)"


@query(f"""WITH {LISTS} SELECT 'error' AS severity, 'benchmark.relevant' AS code, query_id::VARCHAR AS location, r AS ref FROM (SELECT *, unnest(relevant) AS r FROM q) WHERE NOT list_contains(candidates, r)
UNION ALL SELECT 'warning', 'benchmark.hardneg', query_id::VARCHAR, r FROM (SELECT *, unnest(hard_negatives) AS r FROM q) WHERE NOT list_contains(candidates, r)""")
def validate_benchmark_lists(s, d):
    return validation.benchmark_lists(order_lists(s, d), "query_id")


@query(f"""WITH {LISTS} SELECT DISTINCT query_id, id FROM (SELECT query_id, unnest(list_distinct(list_concat(candidates, relevant))) AS id FROM q) JOIN orders ON o_orderkey = query_id
  WHERE TIMESTAMP '1995-01-01' + to_days((id % 1000)::INTEGER) > o_orderdate""")
def candidate_leakage(s, d):
    """Candidates and relevant parts that begin after their order."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("as_of"))
    p = table(s, d, "lineitem").select(F.col("l_partkey").alias("id")).distinct()
    p = p.withColumn("valid_from", F.expr("timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(int(id % 1000))"))
    return validation.query_leaks(order_lists(s, d).join(o, "query_id"), p)


@query("""WITH g AS (SELECT DISTINCT c_mktsegment || '/' || (c_nationkey % 9) AS grp, CASE WHEN c_custkey % 11 = 0 THEN 'train' ELSE CASE WHEN c_nationkey % 2 = 0 THEN 'train' ELSE 'test' END END AS split FROM customer),
c AS (SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 3 = 0 THEN 'test' ELSE 'train' END AS split, c_mktsegment || '/' || (c_nationkey % 9) AS grp FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT 'error' AS severity, 'split.group' AS code, grp AS location FROM g GROUP BY grp HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'error', 'split.fork', split_part(grp, '/', 2) FROM g GROUP BY 3 HAVING count(DISTINCT split) > 1
UNION ALL SELECT DISTINCT 'error', 'split.candidate', query_id::VARCHAR FROM c WHERE split = 'test' AND grp IN (SELECT grp FROM g WHERE split = 'train')""")
def validate_split_disjoint(s, d):
    grp = F.concat("c_mktsegment", F.lit("/"), F.col("c_nationkey") % 9)
    c = table(s, d, "customer").select("c_custkey", grp.alias("grp"), F.when((F.col("c_custkey") % 11 == 0) | (F.col("c_nationkey") % 2 == 0), "train").otherwise("test").alias("split"))
    q = table(s, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 3 == 0, "test").otherwise("train").alias("split"))
    return validation.split_disjoint(q.join(c.select("c_custkey", "grp"), "c_custkey"), c)


@query("""SELECT DISTINCT 'error' AS severity, 'graph.source' AS code, l_orderkey::VARCHAR AS location FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
UNION ALL SELECT DISTINCT 'error', 'graph.target', 'p' || l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) UNION ALL SELECT 'error', 'graph.hash', 'p' || p_partkey FROM part WHERE p_size % 7 = 0""")
def validate_graph_integrity(s, d):
    good = F.concat(F.lit("sha256:"), F.sha2(F.lit("x").cast("binary"), 256))
    nodes = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "P", "issue").otherwise("pull_request").alias("type"), good.alias("content_hash"))
    nodes = nodes.union(table(s, d, "part").select(F.concat(F.lit("p"), "p_partkey"), F.when(F.col("p_size") > 25, "test").when(F.col("p_size") > 5, "file").otherwise("issue"), F.when(F.col("p_size") % 7 != 0, good)))
    e = table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"))
    return validation.graph_integrity(e, nodes, "pull_request", ("file", "test"))


@query("""WITH f AS (SELECT 'error' AS s FROM lineitem WHERE l_returnflag = 'N' UNION ALL SELECT 'error' FROM lineitem WHERE l_linenumber = 7 UNION ALL SELECT 'warning' FROM lineitem WHERE l_linestatus <> 'O' AND l_discount * 10 > 0.9)
SELECT count(*) FILTER (s = 'error') AS errors, count(*) FILTER (s = 'warning') AS warnings, count(*) FILTER (s = 'error') = 0 AS ok FROM f""")
def validation_report(s, d):
    return validation.report(validate_edge_provenance(s, d))


# -- JSON objects judged by compiled schemas ------------------------------------------------------------------------------

@query("""WITH e AS (SELECT event_id, event_id % 3 AS a, user_id % 2 AS b, event_id % 5 AS c, value, ts FROM events)
SELECT event_id, path, rule FROM (
  SELECT event_id, 'relation' AS path, 'enum' AS rule FROM e WHERE a = 2
  UNION ALL SELECT event_id, 'confidence', 'minimum' FROM e WHERE value < 0
  UNION ALL SELECT event_id, 'confidence', 'maximum' FROM e WHERE value > 1
  UNION ALL SELECT event_id, 'confidence', 'type' FROM e WHERE value IS NULL
  UNION ALL SELECT event_id, '', 'additionalProperties' FROM e WHERE c = 1
  UNION ALL SELECT event_id, 'provenance', 'required:license' FROM e WHERE b = 0
  UNION ALL SELECT event_id, 'provenance/content_hash', 'pattern' FROM e WHERE c = 0
  UNION ALL SELECT event_id, 'provenance/retrieved_at', 'type' FROM e WHERE ts IS NULL)""")
def json_schema_violations(s, d):
    """Events written as edges in JSON, some with unknown relations, keys, lacking licenses or broken hashes, judged by the compiled shape of edges."""
    e = table(s, d, "events")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    origin = F.struct(
        F.lit("https://x").alias("source_url"), F.col("ts").cast("string").alias("retrieved_at"), F.when(F.col("user_id") % 2 != 0, F.lit("MIT")).alias("license"),
        F.concat(pick(5, "md5:", "sha256:", "sha256:", "sha256:", "sha256:"), F.sha2(F.col("props").cast("binary"), 256)).alias("content_hash"),
    )
    shown = F.to_json(F.struct(F.col("user_id").cast("string").alias("source"), pick(3, "fixes", "covers", "likes").alias("relation"), F.col("event_type").alias("target")))
    body = F.concat(F.regexp_replace(shown, r"\}$", ""), F.lit(',"confidence":'), F.coalesce(F.col("value").cast("string"), F.lit("null")), F.when(F.col("event_id") % 5 == 1, F.lit(',"note":[{}]')).otherwise(F.lit("")))
    time = F.when(F.col("ts").isNull(), F.lit('{"retrieved_at":null,')).otherwise(F.lit("{"))
    whole = F.concat(body, F.lit(',"provenance":'), time, F.regexp_replace(F.to_json(origin), r"^\{", ""), F.lit("}"))
    found = e.select("event_id", F.explode(schemas.violations(F.parse_json(whole), schemas.load_schema("edge"))).alias("x"))
    return found.select("event_id", "x.path", "x.rule")


@query("""WITH n AS (SELECT count(*) AS n FROM benchmark),
q AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS k, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS task, coalesce(text, '') AS text FROM benchmark),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
p AS (SELECT item_id, task, 'd' || doc_id AS cand, coalesce(quality = 1, false) AS rel, coalesce(toxic = 1, false) AS hard,
  len(list_intersect(string_split(q.text, ' '), string_split(coalesce(d.text, ''), ' ')))::DOUBLE AS score FROM documents d LEFT JOIN l USING (doc_id) CROSS JOIN n JOIN q ON d.doc_id % n.n = q.k),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, cand) AS rank FROM p),
a AS (SELECT item_id, task, count(*) FILTER (rel) AS n_rel, count(*) FILTER (hard) AS n_hard, min(rank) FILTER (rel) AS first, min(rank) FILTER (hard) AS neg, count(*) FILTER (rel AND rank <= 1) AS h1, count(*) FILTER (rel AND rank <= 3) AS h3,
  count(*) FILTER (rel AND rank <= 20) AS h20 FROM r GROUP BY ALL)
SELECT task, count(*) AS n_queries, round(avg(CASE WHEN n_rel > 0 THEN h1 / n_rel ELSE 0 END), 9) AS recall_1, round(avg(CASE WHEN n_rel > 0 THEN h3 / n_rel ELSE 0 END), 9) AS recall_3,
  round(avg(CASE WHEN n_rel > 0 THEN h20 / n_rel ELSE 0 END), 9) AS recall_20, round(avg(coalesce(1 / first, 0)), 9) AS mrr,
  round(coalesce(avg(CASE WHEN n_rel > 0 AND n_hard > 0 THEN CASE WHEN neg IS NULL OR first < neg THEN 1.0 ELSE 0.0 END END), 0), 9) AS hard_negative_accuracy FROM a GROUP BY task""")
def candidate_list_metrics(s, d):
    """Each document is a candidate of one benchmark item, good ones relevant and toxic ones hard negatives; a scorer of shared words, metrics by task at 1, 3 and 20."""
    items = table(s, d, "benchmark")
    numbered = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.row_number().over(Window.orderBy("item_id")) - 1)  # the stated query set
    labels = table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = table(s, d, "documents").join(labels, "doc_id", "left").withColumn("k", F.col("doc_id") % items.count())
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    lists = docs.groupBy("k").agg(F.collect_list(name).alias("candidates"), F.collect_list(F.when(F.col("quality") == 1, name)).alias("relevant"), F.collect_list(F.when(F.col("toxic") == 1, name)).alias("hard_negatives"))
    task = F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd")
    queries = numbered.join(lists, "k").select(F.concat(F.lit("q"), "item_id").alias("query_id"), task.alias("task"), F.concat(F.lit("b"), "item_id").alias("query_record"), "candidates", "relevant", "hard_negatives")
    texts = numbered.select(F.concat(F.lit("b"), "item_id").alias("id"), "text").union(docs.select(name, F.coalesce("text", F.lit(""))))
    words = lambda c: F.split(c, " ")
    shared = lambda p: p.select("query_id", "cand", F.size(F.array_intersect(words("query_text"), words("text"))).cast("double").alias("score"))
    found = candidates.evaluate(queries, shared(candidates.pools(queries, texts)), (1, 3, 20))
    return found.select("task", "n_queries", *(F.round(c, 9).alias(c) for c in found.columns[2:]))
