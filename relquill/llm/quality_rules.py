"""Quality rules: statistics of each text and a learned decision list over them, with DataFrame operations only.

Sequential covering learns the list on the driver from a bounded sample of labelled statistics: each rule is a conjunction
of thresholds, grown on two thirds of the sample and pruned on the rest. The list becomes one ordered Spark conditional.

Null counts as the empty text, which fails the base rule (fewer than 50 words). Texts of any length count whole, in arrays that
grow with the text. Repeated rows give repeated results; of several labels of one id all count; an empty table gives an empty
result; without labels of both kinds the list is empty and only the base rule rejects. Ties between thresholds go to the
first in the order of FEATURES. Clashing names in the input don't matter, as only the named columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the list is learned from, about: those with the smallest hashes of their id.
SAMPLE = 20_000
SPACES = "[\\x20\\x09-\\x0D]+"
MIN_WORDS = 50
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct")
#: What rules test: name -> expression over the statistics.
FEATURES = {
    "words": "n_words * 1D",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "capitals": "n_upper / greatest(word_chars, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
    "variety": "n_distinct / greatest(n_words, 1)",
}


def _without(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, ""))


def statistics(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus STATISTICS of the whole text, all long.

    n_repeat_words counts the words in 3-word windows that occur twice or more. Windows are compared by a 64-bit hash.
    """
    kept = [F.col(c) for c in keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.select(*kept, text.alias("_text"))
    inner = F.regexp_replace("_text", "\\A[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+\\z", "")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.select(
        *kept, F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACES)).alias("_w"), lines.alias("_lines"),
        F.char_length("_text").alias("_n"), _without(F.col("_text"), SPACES).alias("word_chars"), _without(F.col("_text"), "[#*$%&|<>]").alias("_s"),
        _without(F.col("_text"), "[A-Z]+").alias("_u"), _without(F.col("_text"), "[!?;:|]+").alias("_m"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    df = df.select(
        *kept, F.size("_w").alias("_nw"), F.size(F.array_distinct("_w")).alias("n_distinct"), F.size("_lines").alias("n_lines"), F.size(F.array_distinct("_lines")).alias("_dl"),
        "_n", "word_chars", "_s", "_u", "_m", F.when(F.size("_w") >= 4, windows).otherwise(F.array().cast("array<bigint>")).alias("_h"),
    )
    places = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_p", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), places))

    def again(x: Column, k: Column) -> Column:
        return (F.get("_p", k - 1)["h"] == x["h"]) | (F.get("_p", k + 1)["h"] == x["h"])

    found = F.sort_array(F.transform(F.filter("_p", lambda x, k: F.coalesce(again(x, k), F.lit(False))), lambda x: x["i"]))
    df = df.withColumn("_at", found)
    covered = F.aggregate(F.zip_with("_at", F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3))), F.lit(0), lambda s, x: s + x)
    # a filter pushed below would put the arrays' expressions inside the lambdas and evaluate them for each element
    barrier = F.monotonically_increasing_id() * 0
    out = {
        "n_words": F.col("_nw"), "word_chars": F.col("word_chars"), "n_symbols": F.col("_n") - F.col("_s"), "n_dup_lines": F.col("n_lines") - F.col("_dl"),
        "n_repeat_words": F.coalesce(F.when(F.col("_at").isNotNull(), covered), F.lit(0)) + barrier, "n_lines": F.col("n_lines"),
        "n_upper": F.col("_n") - F.col("_u"), "n_marks": F.col("_n") - F.col("_m"), "n_distinct": F.col("n_distinct"),
    }
    return df.select(*kept, *(out[k].cast("long").alias(k) for k in STATISTICS))


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words")


@dataclass(frozen=True)
class Test:
    """One threshold on a feature."""

    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


def _grow(rows: list, n_cuts: int = 24, max_tests: int = 4) -> list[Test]:
    """Add the test of the largest information gain until the rule covers no good row or nothing helps."""
    rule: list[Test] = []
    while len(rule) < max_tests:
        bad = sum(1 for _, y in rows if y)
        good = len(rows) - bad
        if not bad or not good:
            break
        now, best = math.log2(bad / len(rows)), (0.0, None)
        for name in FEATURES:
            pairs = sorted((x[name], y) for x, y in rows)
            total, step = len(pairs), max(1, len(pairs) // n_cuts)
            bad_values = sorted(v for v, y in pairs if y)
            cuts = {pairs[k][0] for k in range(step - 1, total - 1, step)} | {bad_values[k * (len(bad_values) - 1) // n_cuts] for k in range(n_cuts + 1)}
            k = below = 0
            for cut in sorted(cuts):
                while k < total and pairs[k][0] <= cut:
                    below += pairs[k][1]
                    k += 1
                for above, p, n in ((False, below, k), (True, bad - below, total - k)):
                    if p and n < total:
                        gain = p * (math.log2(p / n) - now)
                        if gain > best[0] + 1e-9:
                            best = (gain, Test(name, above, float(cut)))
        if best[1] is None:
            break
        above = min((x[best[1].feature] for x, _ in rows if x[best[1].feature] > best[1].threshold), default=best[1].threshold)
        rule.append(Test(best[1].feature, best[1].above, (best[1].threshold + above) / 2))  # half way to the next value
        rows = [r for r in rows if rule[-1].holds(r[0])]
    return rule


def _worth(rule: list[Test], rows: list) -> tuple[float, int, int]:
    own = [y for x, y in rows if all(t.holds(x) for t in rule)]
    bad = sum(own)
    return (2 * bad - len(own)) / max(1, len(own)), bad, len(own) - bad


def learn(rows: list[tuple[dict[str, float], int]], min_precision: float = 0.9, max_rules: int = 12, min_cover: int = 5) -> list[list[Test]]:
    """An ordered decision list that rejects. ``rows``: (features, 1 if the label is bad), in an order that is random enough."""
    grown = [r for k, r in enumerate(rows) if k % 3]
    held = [r for k, r in enumerate(rows) if not k % 3]
    rules: list[list[Test]] = []
    while len(rules) < max_rules and any(y for _, y in grown):
        rule = _grow(grown)
        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: (_worth(r, held)[0], len(r)))
        _, bad, good = _worth(rule, held)
        _, bad_grown, good_grown = _worth(rule, grown)
        if bad + bad_grown < min_cover or (bad + bad_grown) < min_precision * (bad + good + bad_grown + good_grown) or bad < good:
            break
        rules.append(rule)
        grown, held = ([r for r in part if not all(t.holds(r[0]) for t in rule)] for part in (grown, held))
    return rules


def verdict(rules: list[list[Test]]) -> Column:
    """The list as one ordered conditional: the number of the first rule that rejects, else 0."""
    if not rules:
        return F.lit(0)
    out = None
    for k, rule in enumerate(rules, 1):
        condition = F.expr(" AND ".join(t.sql() for t in rule))
        out = F.when(condition, F.lit(k)) if out is None else out.when(condition, F.lit(k))
    return out.otherwise(F.lit(0))


def learn_from(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, allowed: Column | None = None) -> list[list[Test]]:
    """Learn from about ``sample`` rows of ``labels`` (doc_id, quality) that ``allowed`` admits."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    marked = marked if allowed is None else marked.where(allowed)
    n = marked.count()
    marked = marked.select("doc_id", (F.col("quality") == 0).cast("int").alias("_bad"), F.xxhash64("doc_id", F.lit(9)).alias("_order"))
    if n > sample:
        marked = marked.where(F.col("_order") < int(-(2**63) + 2**64 * (sample / n)))
    own = docs.join(F.broadcast(marked), "doc_id").select("doc_id", "text", "_bad", "_order")
    rows = statistics(own, keep=("doc_id", "_bad", "_order")).where(~base_failed())
    rows = rows.select("_order", "doc_id", "_bad", *(F.expr(f"double({x})").alias(k) for k, x in FEATURES.items())).collect()
    rows = sorted(rows, key=lambda r: (r["_order"], r["doc_id"]))
    return learn([({k: r[k] for k in FEATURES}, r["_bad"]) for r in rows])


def quality(docs: DataFrame, rules: list[list[Test]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, base_failed, rule (the number of the rule that rejects, 0 for none) and kept of each row."""
    found = statistics(docs, text_col, (id_col,)).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
