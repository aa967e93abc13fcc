"""Text and path functions as Column expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a path that say nothing about its subject.
PATH_STOPWORDS = ("test", "tests", "py", "src", "lib", "init", "main", "index", "spec", "mod", "the", "a", "of", "to")
#: What ``scrub_references`` removes, in this order; digits, words and boundaries are those of all alphabets.
REFERENCES = (
    r"(?iU)https?://(?:www\.)?github\.com/[\w.\-]+/[\w.\-]+/(?:issues|pull|commit)/[\w]+",
    r"(?U)\b[\w.\-]+/[\w.\-]+#\d+",
    r"(?U)(?<![\w])#\d+\b",
    r"(?iU)\bgh-\d+\b",
    r"(?iU)\b(?=[0-9a-f]*\d)[0-9a-f]{7,40}\b",
)
#: How texts close issues, and the stricter form that audits use (the separator is due, no owner).
CLOSING = r"(?iU)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\b[:\s]*(?:[\w.\-]+/[\w.\-]+)?(?:#|gh-)(\d+)"
AUDITED = r"(?iU)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)[:\s]+(?:#|gh-)?(\d+)"
#: White space of all alphabets, with the separators that Java's class lacks.
SPACE = r"[\s\x1C-\x1F]"
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: A record's fields whose text comes first, in this order.
TEXT_FIELDS = ("title", "name", "path", "message", "body", "summary", "code", "log", "text", "diff")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str) -> Column:
    """Camel-case split, lower case, runs of a-z and 0-9, repeats kept."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(F.coalesce(_col(text), F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")), F.lit("[a-z0-9]+"), F.lit(0))


def identifier_tokens(text: Column | str) -> Column:
    """The parts of each identifier and then the whole of it in lower case, so a plain word comes twice."""
    runs = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.concat(F.split(F.lower(F.regexp_replace(r, "([a-z0-9])([A-Z])", "$1 $2")), " "), F.array(F.lower(r)))))


def path_tokens(path: Column | str) -> Column:
    """Distinct tokens of a path, longer than one character, without stop words."""
    return F.array_except(F.filter(F.array_distinct(tokens(path)), lambda t: F.length(t) > 1), F.array(*map(F.lit, PATH_STOPWORDS)))


def stripped(text: Column | str) -> Column:
    """Without white space at both ends."""
    return F.btrim(_col(text), F.lit(WHITE))


def scrub_references(text: Column | str) -> Column:
    """Remove links to issues and commits, issue numbers and commit hashes; tidy what is left. Null is empty."""
    out = F.coalesce(_col(text), F.lit(""))
    for pattern in REFERENCES:
        out = F.regexp_replace(out, pattern, " ")
    for pattern, by in ((rf"(?U)\({SPACE}*[,;]?{SPACE}*\)", " "), (r"[ \t]{2,}", " "), (rf"(?U){SPACE}+([.,;:!?])", "$1")):
        out = F.regexp_replace(out, pattern, by)
    return stripped(out)


def scrubbed_record(title: Column | str, body: Column | str) -> Column:
    """Scrubbed title and body in one line."""
    return stripped(F.concat_ws(" ", scrub_references(title), scrub_references(body)))


def record_text(content: Column | str, *first: Column | str) -> Column:
    """``first`` (id and type), the string fields of a JSON object that TEXT_FIELDS names, then its other string fields by name.

    Values that aren't strings and empty ones are left out; lines are joined by line feeds. Not a JSON object: ``first`` alone.
    """
    fields = F.try_variant_get(F.try_parse_json(_col(content)), "$", "map<string,variant>")
    strings = F.map_filter(fields, lambda _, v: F.schema_of_variant(v) == "STRING")
    text = lambda k: F.coalesce(F.try_variant_get(F.element_at(strings, k), "$", "string"), F.lit(""))
    rest = F.array_sort(F.filter(F.map_keys(strings), lambda k: ~k.isin(*TEXT_FIELDS)))
    parts = F.concat(F.array(*(F.coalesce(_col(x).cast("string"), F.lit("")) for x in first)), F.coalesce(F.concat(F.array(*(text(F.lit(k)) for k in TEXT_FIELDS)), F.transform(rest, text)), F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


def capped(text: Column | str, most: int) -> Column:
    """The first ``most`` characters, null as empty: the operator is a cut."""
    return F.left(F.coalesce(_col(text), F.lit("")), F.lit(most))


def chunks(text: Column | str, size: int, overlap: float = 0.2) -> Column:
    """Windows of ``size`` characters at steps of size * (1 - overlap), one at each step below the length; blank ones go.

    A text of ``size`` characters or fewer is one chunk, and so is an empty one.
    """
    step = max(1, int(size * (1.0 - overlap)))
    body = stripped(F.coalesce(_col(text), F.lit("")))
    last = F.ceil(F.length(body) / step).cast("int") - 1
    cut = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(body, i * step + 1, F.lit(size)))
    return F.when(F.length(body) <= size, F.array(body)).otherwise(F.filter(cut, lambda c: stripped(c) != ""))


def is_test_path(path: Column | str, strict: bool = True) -> Column:
    """Whether a path is a test: by how directory or file are named if ``strict``, else by the word alone."""
    low = F.lower(_col(path))
    if not strict:
        return low.contains("test")
    base = F.element_at(F.split(low, "/"), -1)
    named = base.contains("_test.") | base.contains(".test.") | base.contains(".spec.")
    return low.contains("/test") | low.startswith("test") | base.startswith("test_") | named


def closing_references(text: Column | str, pattern: str = CLOSING) -> Column:
    """Issue numbers after a closing keyword, distinct."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(pattern), F.lit(1)))


def iso_time(value: Column | str) -> Column:
    """The time of an ISO-8601 text (a final Z is UTC), null where it is none."""
    return F.try_to_timestamp(F.when(_col(value).rlike(r"^\d{4}-\d\d-\d\d([T ].*)?$"), F.regexp_replace(_col(value), "Z$", "+00:00")))


def identifier(kind: Column | str, repo: Column | str, suffix: Column | str, space: str = "gh") -> Column:
    """``space:repo:kind:suffix``; the kind is given as text or column, the others by column."""
    return F.concat_ws(":", F.lit(space), _col(repo), F.lit(kind) if isinstance(kind, str) else kind, _col(suffix).cast("string"))


def identifier_parts(ident: Column | str) -> Column:
    """(space, repo, kind, suffix) of an identifier; nulls where it is none."""
    part = lambda k: F.nullif(F.regexp_extract(_col(ident), r"(?s)^([^:]+):([^:]+):([^:]+):(.+)\z", k), F.lit(""))
    return F.struct(*(part(k).alias(n) for k, n in enumerate(("space", "repo", "kind", "suffix"), 1)))


def renamed_space(ident: Column | str, old: str, new: str) -> Column:
    """Identifiers of one name space moved to another; others stay."""
    return F.when(_col(ident).startswith(f"{old}:"), F.concat(F.lit(new), F.substring(_col(ident), F.lit(len(old) + 1), F.length(_col(ident))))).otherwise(_col(ident))


def license_allowed(license: Column | str, allowed: tuple[str, ...], curated: Column | None = None) -> Column:
    """Whether a license is on the list; an unknown one only if the source is ``curated``."""
    known = F.coalesce(_col(license).isin(*allowed), F.lit(False))
    return known if curated is None else known | (F.coalesce(_col(license).isin("NOASSERTION", ""), F.lit(True)) & F.coalesce(curated, F.lit(False)))


def kind_of(obj: Column | str) -> Column:
    """card, edge, benchmark or record, by the keys of a JSON object; null where it is none."""
    keys = F.json_object_keys(_col(obj))
    has = lambda k: F.array_contains(keys, k)
    return F.when(keys.isNull(), None).when(has("card_type"), "card").when(has("relation"), "edge").when(has("query_record"), "benchmark").otherwise("record")


def truncated(text: Column | str, limit: int) -> Column:
    """White space collapsed; cut to ``limit`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))


def hash_order(seed: int, *parts: Column | str) -> Column:
    """A pseudo-random, portable order: the first 32 bits of an MD5 sum of seed and parts."""
    return F.conv(hash_text(seed, *parts), 16, 10).cast("long")


def hash_text(seed: int, *parts: Column | str) -> Column:
    """``hash_order`` as eight hexadecimal digits, which sort as the number does and cost less."""
    text = F.concat_ws("|", F.lit(str(seed)), *(_col(p).cast("string") for p in parts))
    return F.substring(F.md5(text.cast("binary")), 1, 8)


def canonical_json(**fields: Column) -> Column:
    """JSON with sorted keys, no spaces and nulls kept; values beyond ASCII are escaped."""
    whole = F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})
    units = F.regexp_extract_all(whole, F.lit(r"(?s)[\x00-\x7F]+|[^\x00-\x7F]"), F.lit(0))

    def escaped(x: Column) -> Column:
        units = F.regexp_replace(F.lower(F.hex(F.encode(x, "UTF-16BE"))), "(.{4})", r"\\u$1")
        return F.when(x.rlike(r"^[\x00-\x7F]"), x).otherwise(units)

    return F.when(whole.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(units, escaped), "")).otherwise(whole)


def canonical_hash(*columns: str) -> Column:
    """sha256 of the columns as canonical JSON."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(**{c: F.col(c) for c in columns}).cast("binary"), 256))
