"""Toxicity by class-conditional Kneser-Ney bigram models.

Toxic and ordinary texts have a model each, of the same form. A word follows the word before it with

    P(w | v) = discounted class bigrams + mass * (discounted bigrams of both classes + mass * P(w))
    P(w)     = P(head) * P(w | head),

where the head is the word's first bytes, and P(head) and P(w | head) are discounted continuation counts of the class, whose mass
goes to the discounted continuation counts that both classes share. What the models don't know has a share of its own at each
level, so all probabilities of a context sum to 1. Each level and class takes three discounts off counts of 1, 2 and more, which are
below those and follow from its counts of counts; so a rare expression tells mostly by the shared counts. A bigram counts once for each text
that holds it.

A text is judged by the length-normalised difference of its two log likelihoods: over the whole text, over its most telling
WINDOW words in a row, and over its most telling three words. Single words and windows count with less: what the head, the word and
the bigram each add to a word's log ratio is taken nearer to zero by ERRORS standard errors of a log ratio at the counts of that level. A
logistic curve over these and the length, fitted on labelled texts that the counts did not see, turns them into a probability.

A null or empty text has the evidence zero and gets the score of that; texts of any length are scored whole. Without labels of
both classes all scores are 0. Several labels of one id count as toxic if one does. Repeated rows give repeated results; an empty
table gives an empty result; only the named columns are read, and an added column gets underscores in front where a kept one has
its name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_SLICE_BYTES, discard, free_name, give_back, materialise, slices, tidy
from .tokens import LETTERS, STEP, gram_hashes, mix, word_hashes

#: Labelled rows of each class that the models are fitted on, about, and bytes of their texts in sum, about: those with the
#: smallest hashes of their id. Half of them are counted, half calibrate.
SAMPLE = {0: 8_000, 1: 6_000}
SAMPLE_BYTES = 30_000_000
#: Taken off a count where counts of counts don't tell.
DISCOUNT = 0.75
WINDOW = 8
#: Standard errors that are taken off what a level adds to a word's log ratio, where single words and windows are judged.
ERRORS = 3.0
#: Bytes of a word's head.
HEAD = 4
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """Sorted hashes, each with the terms of the ordinary and the toxic model; a last row stands for all that is unknown."""

    words: np.ndarray
    word_p: np.ndarray  # P(w), nan for a word that is known as a context only
    mass: np.ndarray  # of the class bigrams of a context
    shared_mass: np.ndarray
    pairs: np.ndarray
    pair_p: np.ndarray
    shared_p: np.ndarray
    heads: np.ndarray
    rest_p: np.ndarray  # P of an unknown word with that head
    head_p: np.ndarray  # P(head), of an unknown one at the end
    head_n: np.ndarray  # counts of both classes: continuation counts of heads and words, and counts of bigrams
    word_n: np.ndarray
    pair_n: np.ndarray
    curve: np.ndarray | None


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted hash in the sorted keys, or the number of keys where it is missing."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, len(keys))


def levels(model: Model, words: np.ndarray, heads: np.ndarray, text: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """P of each word's head, of the word, and of the word after the one before it in its text, in both models; the counts that these add."""
    at, of_head = find(model.words, words), find(model.heads, heads)
    p = model.word_p[at].astype(float)
    unknown = np.isnan(p[:, 0])
    p[unknown] = model.rest_p[of_head[unknown]]
    grams, ends = gram_hashes(words, text, 2)
    known, before = find(model.pairs, grams), at[ends - 1]
    shared = model.shared_p[known][:, None] + model.shared_mass[before][:, None] * p[ends]
    whole, n = p.copy(), np.zeros(len(words))
    whole[ends] = model.pair_p[known] + model.mass[before] * shared
    n[ends] = model.pair_n[known]
    return [model.head_p[of_head], p, whole], [model.head_n[of_head], model.word_n[at], n]


def evidence(p: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Log ratio of each word, toxic to ordinary; the same with what each level adds brought ERRORS standard errors nearer to zero."""
    ratio, sure, below = np.zeros(len(p[0])), np.zeros(len(p[0])), 0.0
    for own, count in zip(p, n, strict=True):
        ratio = np.log(own[:, 1]) - np.log(own[:, 0])
        added = ratio - below
        sure = sure + np.sign(added) * np.maximum(np.abs(added) - ERRORS / np.sqrt(np.maximum(count, 1e-9)), 0)
        below = ratio
    return ratio, sure


def features(model: Model, texts: list[bytes]) -> np.ndarray:
    """Length-normalised difference over the whole text, its best window and its best three words; logarithm of the length."""
    out = np.zeros((len(texts), 4))
    words, text = word_hashes(texts, LETTERS)
    if not len(words):
        return out
    ratio, sure = evidence(*levels(model, words, word_hashes(texts, LETTERS, HEAD)[0], text))
    present, starts = np.unique(text, return_index=True)
    sizes = np.diff(np.r_[starts, len(text)])
    out[present, 0] = np.add.reduceat(ratio, starts) / sizes
    total = np.r_[0, np.cumsum(sure)]
    last = np.repeat(starts + sizes, sizes)
    end = np.minimum(np.arange(len(words)) + WINDOW, last)
    begin = np.maximum(end - WINDOW, np.repeat(starts, sizes))
    out[present, 1] = np.maximum.reduceat((total[end] - total[begin]) / (end - begin), starts)
    order = np.lexsort((-sure, text))
    best = order[np.arange(len(words)) - np.repeat(starts, sizes) < 3]
    out[:, 2] = np.bincount(text[best], sure[best], len(texts)) / 3
    out[present, 3] = np.log(sizes) / 10
    return out


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's method with a small ridge."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def discounts(n: list[int]) -> np.ndarray:
    """What Kneser-Ney smoothing takes off counts of 0, 1, 2 and of 3 or more, by how many counts of 1, 2, 3 and 4 there are."""
    out = np.array([0.0, DISCOUNT, DISCOUNT, DISCOUNT])
    if min(n) > 0:
        share = n[0] / (n[0] + 2 * n[1])
        for k in (1, 2, 3):
            out[k] = min(max(k - (k + 1) * share * n[k] / n[k - 1], DISCOUNT / 2), k - 0.01)
    return out


def discounts_of(counts: np.ndarray) -> np.ndarray:
    return discounts([int((counts == k).sum()) for k in (1, 2, 3, 4)])


def tables(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the models need of distinct bigrams (hash, context, last, head of the last word, c0, c1: texts of each class).

    Words, with continuation counts, sums of their bigrams as contexts and what the discount takes of these; and the discounted share
    of each bigram among those of its context, in both classes together and in each.
    """
    grams = grams.withColumn("c", F.col("c0") + F.col("c1"))
    seen = grams.agg(*(F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in ("c", "c0", "c1") for k in (1, 2, 3, 4))).first()
    own = {c: discounts([seen[f"{c}_{k}"] for k in (1, 2, 3, 4)]).tolist() for c in ("c", "c0", "c1")}
    off = lambda c: F.element_at(F.array(*map(F.lit, own[c])), F.least(F.col(c), F.lit(3)).cast("int") + 1)
    taken = lambda c: F.sum(F.least(F.col(c).cast("double"), off(c)))
    before = grams.groupBy(F.col("last").alias("word")).agg(F.any_value("head").alias("head"), F.count("*").alias("n"), F.count_if(F.col("c0") > 0).alias("n0"), F.count_if(F.col("c1") > 0).alias("n1"))
    after = grams.groupBy(F.col("context").alias("word")).agg(*(f(c).cast("double").alias(f"{k}{c[1:]}") for f, k in ((F.sum, "s"), (taken, "m")) for c in ("c", "c0", "c1")))
    words = before.join(after, "word", "full").withColumn("known", F.col("head").isNotNull())
    sums = after.select(F.col("word").alias("context"), "s", "s0", "s1")
    share = lambda c: (F.greatest(F.col(f"c{c}") - off(f"c{c}"), F.lit(0.0)) / F.greatest(F.col(f"s{c}"), F.lit(1.0))).cast("float").alias(f"p{c}")
    return words.na.fill(0), grams.join(sums, "context").select("hash", F.col("c").cast("float").alias("n"), *map(share, ("", "0", "1")))


def models(words: dict[str, np.ndarray], pairs: dict[str, np.ndarray]) -> Model:
    """The Kneser-Ney terms from the columns of ``tables``."""
    order = np.argsort(words["word"].view(np.uint64))
    words = {k: x[order] for k, x in words.items()}
    own = np.flatnonzero(words["known"])
    heads, of_own = np.unique(words["head"][own].view(np.uint64), return_inverse=True)

    def by_head(x: np.ndarray) -> np.ndarray:
        return np.bincount(of_own, x, len(heads))

    def off(x: np.ndarray, taken: np.ndarray) -> np.ndarray:
        return np.minimum(x, taken[np.minimum(x, 3).astype(np.int64)])

    # both classes: continuation counts (distinct words before each word) of heads, then of the words of a head; one more head and
    # one more word of each head stand for the unknown
    follows = words["n"][own].astype(float)
    of_head, types = by_head(follows), np.bincount(of_own, minlength=len(heads))
    by_heads, by_words = discounts_of(of_head), discounts_of(follows)
    taken = off(of_head, by_heads)
    total = max(of_head.sum(), 1)
    left = taken.sum() / total if len(heads) else 1.0
    shared_head = np.r_[(of_head - taken) / total, 0] + left / (len(heads) + 1)
    taken = off(follows, by_words)
    left = by_head(taken) / np.maximum(of_head, 1) / (types + 1)
    shared_word = (follows - taken) / np.maximum(of_head[of_own], 1) + left[of_own]
    shared_rest, head_n = np.r_[left, 1.0], np.r_[of_head, 0]
    # each class backs off to them
    p_word, p_heads, rest = np.full((len(order) + 1, 2), np.nan), np.empty((len(heads) + 1, 2)), np.empty((len(heads) + 1, 2))
    for k in (0, 1):
        follows = words[f"n{k}"][own].astype(float)
        of_head = by_head(follows)
        by_heads, by_words = discounts_of(of_head), discounts_of(follows)
        taken, total = off(of_head, by_heads), of_head.sum()
        p_head = np.r_[(of_head - taken) / max(total, 1), 0] + (taken.sum() / total if total else 1.0) * shared_head
        p_heads[:, k] = p_head
        taken = off(follows, by_words)
        kept = np.where(of_head > 0, by_head(taken) / np.maximum(of_head, 1), 1.0)
        p_word[own, k] = p_head[of_own] * ((follows - taken) / np.maximum(of_head[of_own], 1) + kept[of_own] * shared_word)
        rest[:, k] = p_head * np.r_[kept, 1.0] * shared_rest
    # bigrams, and the mass that the discount leaves of each context; a row more for the unknown
    sums, taken = (np.stack([words[f"{k}{c}"] for c in ("", "0", "1")], axis=1) for k in "sm")
    mass = np.r_[np.where(sums > 0, taken / np.maximum(sums, 1), 1.0), np.ones((1, 3))].astype(np.float32)
    by = np.argsort(pairs["hash"].view(np.uint64))
    p_pair = np.r_[np.stack([pairs[f"p{c}"][by] for c in ("", "0", "1")], axis=1), np.zeros((1, 3), np.float32)]
    keys = (words["word"].view(np.uint64), pairs["hash"][by].view(np.uint64))
    return Model(keys[0], p_word, mass[:, 1:].copy(), mass[:, 0].copy(), keys[1], p_pair[:, 1:].copy(), p_pair[:, 0].copy(), heads, rest, p_heads, head_n, np.r_[words["n"], 0].astype(np.float32), np.r_[pairs["n"][by], 0].astype(np.float32), None)


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: dict[int, int] | None = None, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Fit on a bounded sample of the labelled rows that ``allowed`` (over the id) admits; None without both classes."""
    sample = sample or SAMPLE
    marked = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("toxic")).where(allowed & F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull())
    marked = marked.groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    sizes = docs.select(id_col, F.coalesce(F.octet_length(text_col), F.lit(0)).alias("size")).join(marked, id_col).groupBy("toxic").agg(F.count("*"), F.sum("size")).collect()
    if len(sizes) < 2:
        return None
    share = F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    rate = {k: min(1.0, sample[k] / n, sample_bytes / 2 / max(1, size)) for k, n, size in sizes}
    marked = marked.where(share < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0]))
    marked = marked.withColumn("part", F.pmod(F.xxhash64(F.col(id_col), F.lit(4)), F.lit(2)).cast("int"))
    own = docs.join(F.broadcast(marked), id_col).select("toxic", "part", F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))  # the sample's bound holds for marked
    names = ("hash", "context", "last", "head", "c0", "c1")

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch, most=SMALL_SLICE_BYTES):
                texts, toxic = piece.column("text").to_pylist(), np.array(piece.column("toxic").to_pylist())
                words, text = word_hashes(texts, LETTERS)
                grams, ends = gram_hashes(words, text, 2)
                head = word_hashes(texts, LETTERS, HEAD)[0]
                once = np.unique(mix(grams ^ mix(text[ends].astype(np.uint64) + STEP)), return_index=True)[1]
                keys, at, back = np.unique(grams[once], return_index=True, return_inverse=True)
                end = ends[once[at]]
                c1 = np.bincount(back, toxic[text[ends[once]]], len(keys)).astype(np.int64)
                columns = (keys, words[end - 1], words[end], head[end])
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in columns), pa.array(np.bincount(back, minlength=len(keys)) - c1), pa.array(c1)], list(names))

    grams = own.where("part = 0").drop("part").mapInArrow(tidy(count), ", ".join(f"{c} long" for c in names))
    grams = materialise(grams.groupBy("hash", "context", "last", "head").agg(*(F.sum(c).alias(c) for c in ("c0", "c1"))), "grams")
    found = (t.toArrow() for t in tables(grams))  # words and bigrams of the bounded sample
    model = models(*({c: x.to_numpy() for c, x in zip(t.column_names, t.columns, strict=True)} for t in found))
    discard(grams)
    held = docs.sparkSession.sparkContext.broadcast(model)
    x, y = [], []
    for r in own.where("part = 1").select("toxic", "text").mapInArrow(_evidence(held), "toxic int, a double, b double, c double, d double").collect():
        x.append(r[1:])
        y.append(r[0])
    held.destroy()
    give_back()
    if len(set(y)) < 2:
        return None
    y = np.array(y, float)
    weights = np.where(y == 1, 1 / rate[1], 1 / rate[0])
    return Model(*(getattr(model, k) for k in Model.__dataclass_fields__ if k != "curve"), curve(np.array(x), y, weights / weights.mean()))


def _evidence(held):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in slices(batch, most=SMALL_SLICE_BYTES):
                found = features(held.value, piece.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column("toxic"), *map(pa.array, np.ascontiguousarray(found.T))], ["toxic", "a", "b", "c", "d"])

    return tidy(run)


def score(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, score (0 to 1) and predicted (1 if score >= threshold)."""
    own = docs.select(*keep)
    body, score, predicted = (free_name(own, c) for c in ("body", "score", "predicted"))
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias(score), F.lit(0).alias(predicted))
    held = docs.sparkSession.sparkContext.broadcast(model)  # words and bigrams of the bounded sample
    source = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias(body))
    fields = [f for f in source.schema.fields if f.name != body]
    names = [f.name for f in fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{score}` double"])

    def run(batches):
        import pyarrow as pa

        model = held.value
        for batch in batches:
            for piece in slices(batch, body, SMALL_SLICE_BYTES):
                x = features(model, piece.column(body).to_pylist())
                p = 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), x] @ model.curve, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(p)], [*names, score])

    return source.mapInArrow(tidy(run), schema).withColumn(predicted, (F.col(score) >= threshold).cast("int"))
