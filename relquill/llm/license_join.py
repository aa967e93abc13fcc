"""License scan: exact set-similarity join of text blocks with license templates, with DataFrame operations only.

A block for a template is a run of consecutive words, a quarter longer than the template, that begins at any word of the text; how
the text is wrapped into lines plays no part. It matches if it holds at least ``threshold`` of the template's distinct words. All
words of the templates are ordered by the number of rows that hold them, over all rows, rarest first. A matching pair must
then share a word of both prefixes (prefix filter); blocks with too few words (length filter) and pairs whose first shared words
leave too few behind them (positional filter) are dropped, and what remains is counted exactly. Blocks are only formed in texts
that hold enough words of some template as a whole. Beside it, the base phrases are found wherever their words stand consecutively.

Null counts as the empty text: no words and no labels. Texts of any length count whole. Equal shares and templates that match
twice give one label. Repeated rows give repeated results; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: The phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices that licenses are commonly stated with.
TEMPLATES = (
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-terms", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd-terms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0-notice", "Licensed under CC BY-SA 4.0"),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-terms", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit-notice", "Released under the MIT License"),
    ("mit-terms", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
)
THRESHOLD = 0.9
#: A block is so many times as long as the template's text.
SLACK = 1.25
#: Rows whose blocks one task forms, about.
TASK_ROWS = 1_000
WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    import re

    return list(dict.fromkeys(re.findall(WORDS, text.lower())))


def span(text: str) -> int:
    """Words that a block of the template has."""
    import re

    return math.ceil(SLACK * len(re.findall(WORDS, text.lower())))


def needed(size: int, threshold: float) -> int:
    """The least overlap that reaches the threshold."""
    return max(1, math.ceil(threshold * size - 1e-9))


def words_of(text: Column) -> Column:
    inner = F.regexp_replace(text, f"\\A{GAPS}|{GAPS}\\z", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAPS))


def phrase_at(words: str, i: Column) -> Column:
    """The label of the phrase that starts at word ``i``, else null."""
    out = None
    for phrase, label in PHRASES:
        parts = phrase.split()
        same = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (F.get(words, i + k) == part)
        out = F.when(same, F.lit(label)) if out is None else out.when(same, F.lit(label))
    return out


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``df``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest share of a template's words that a matching block holds, 1 where a base phrase stands, else 0.
    """
    own = {name: template_words(text) for name, text in templates}
    spans = {name: span(text) for name, text in templates}
    vocabulary = sorted({w for words in own.values() for w in words})
    least, longest = min(needed(len(w), threshold) for w in own.values()), max(spans.values())
    known = F.array(*map(F.lit, vocabulary))
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    df = df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    df = df.select("id", "row", words_of(F.col("text")).alias("words"), F.col("text").contains("license").alias("may"))
    df = df.withColumn("known", F.array_intersect("words", known))
    enough = F.lit(False)
    for words in own.values():
        enough = enough | (F.size(F.array_intersect("known", F.array(*map(F.lit, words)))) >= needed(len(words), threshold))
    places = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: F.array_contains("known", x["w"]))
    found = F.filter(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0))), lambda i: F.struct(i.alias("i"), phrase_at("words", i).alias("label"))),
        lambda x: x["label"].isNotNull(),
    )
    rows = df.select("id", "row", "known", F.size("words").cast("long").alias("n_words"), F.when(F.col("may"), found).alias("found"), F.when(enough, places).alias("places"))
    rows = materialise(rows, "rows")

    # the templates' words by the number of rows that hold them, rarest first (a word of the vocabulary each: bounded)
    count = {r["w"]: r["n"] for r in rows.select(F.explode("known").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}
    ordered = F.create_map(*(F.lit(x) for w, k in order.items() for x in (w, k)))
    index = []
    for name, words in own.items():
        ranks = sorted(order[w] for w in words)
        need = needed(len(ranks), threshold)
        index += [(rank, name, k, need, spans[name], ranks) for k, rank in enumerate(ranks[: len(ranks) - need + 1])]
    indexed = F.array(*(F.lit(k) for k in sorted({x[0] for x in index})))
    index = df.sparkSession.createDataFrame(index, "rank int, template string, t_at int, need int, span int, t array<int>")

    # the places are few bytes and much work: a task for so many rows, whatever Spark would coalesce
    near = rows.where("places IS NOT NULL").select("row", "places")
    near = near.repartition(max(1, -(-near.count() // TASK_ROWS)), "row")
    ranked = near.select("row", F.transform("places", lambda x: F.struct(x["i"].alias("i"), F.element_at(ordered, x["w"]).alias("r"))).alias("p"))
    starts = ranked.select("row", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k")).select("row", F.slice("p", F.col("k"), longest).alias("p"))
    blocks = starts.select("row", F.col("p")[0]["i"].alias("start"), F.filter("p", lambda x: x["i"] < F.col("p")[0]["i"] + longest).alias("p"))
    blocks = blocks.withColumn("b", F.array_sort(F.array_distinct(F.col("p")["r"]))).where(F.size("b") >= least)
    prefix = F.filter(F.transform(F.slice("b", 1, F.size("b") - least + 1), lambda r, k: F.struct(k.alias("b_at"), r.alias("rank"))), lambda x: F.array_contains(indexed, x["rank"]))
    prefix = blocks.select("row", "start", "p", F.size("b").alias("size"), F.explode(prefix).alias("x")).select("row", "start", "p", "size", "x.*")
    pairs = prefix.join(F.broadcast(index), "rank")  # as many rows as the templates have words, at most
    pairs = pairs.where("size >= need AND least(size - b_at, size(t) - t_at) >= need")
    inside = F.transform(F.filter("p", lambda x: x["i"] < F.col("start") + F.col("span")), lambda x: x["r"])
    pairs = pairs.withColumn("share", F.size(F.array_intersect(inside, "t"))).where("share >= need")
    matched = pairs.groupBy("row").agg(F.collect_set("template").alias("method"), F.max(F.col("share") / F.size("t")).alias("share"))
    rows = rows.join(matched, "row", "left")
    base = F.array_sort(F.array_distinct(F.transform(F.coalesce("found", F.array().cast("array<struct<i:int,label:string>>")), lambda x: x["label"])))
    starts_at = F.transform("found", lambda x: x["i"].cast("long"))
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(F.col("found").isNull(), 0).otherwise(F.size("found")).cast("long").alias("n_base"),
        F.array_min(starts_at).alias("first_word"),
        F.array_max(starts_at).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("method", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def license_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same result by comparing the blocks at every word with every template, in DuckDB SQL."""
    pattern = WORDS.replace("\\\\", "\\")
    values = ", ".join(f"('{name}', {len(template_words(text))}, [{', '.join(repr(w) for w in template_words(text))}], {needed(len(template_words(text)), threshold)}, {span(text)})" for name, text in templates)
    return f"""
WITH t(template, n, ws, need, span) AS (VALUES {values}),
d AS (SELECT doc_id, coalesce(text, '') AS body,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}') AS w FROM documents),
p AS (SELECT doc_id, i, CASE WHEN w[i] = 'mit' AND w[i + 1] = 'license' THEN 'mit' WHEN w[i] = 'apache' AND w[i + 1] = 'license' THEN 'apache'
        WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl' END AS label
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE list_contains(w, 'license'))),
base AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS lo, max(i) - 1 AS hi FROM p WHERE label IS NOT NULL GROUP BY doc_id),
b AS (SELECT doc_id, template, t.n, need, span, ws, w, unnest(range(1, len(w) + 1)) AS i FROM d, t WHERE len(list_intersect(w, ws)) >= need),
m AS (SELECT doc_id, template, max(len(list_intersect(w[i : i + span - 1], ws)) / n) AS share FROM b
      WHERE len(list_intersect(w[i : i + span - 1], ws)) >= need GROUP BY doc_id, template),
l AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels, string_agg(label, ',' ORDER BY label) FILTER (own = 0) AS base_labels FROM
      (SELECT DISTINCT doc_id, label, 0 AS own FROM p WHERE label IS NOT NULL UNION ALL SELECT doc_id, template, 1 FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.lo::BIGINT AS first_word, base.hi::BIGINT AS last_word,
  coalesce(l.base_labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce((SELECT max(share) FROM m WHERE m.doc_id = d.doc_id), 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN l USING (doc_id)"""
