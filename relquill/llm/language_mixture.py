"""Language identification by multilingual mixture inference.

Byte trigrams of each language, counted in labelled texts, give a likelihood for every word. For a document,
expectation-maximisation finds the proportions of languages that explain its words; the set of languages grows by the one
with the steepest rise of the likelihood, as long as the rise is worth a penalty for each language.

A text that is null or has no letter is ``und`` with score 0, and so is every text if there is nothing to learn from. Texts count
whole; memory grows with the words of the longest text times the languages. Ties go to the language that is first by name.
Repeated rows give repeated results; an empty table gives an empty result; only the named columns are read, and an added column
gets underscores in front where a kept one has its name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, free_name, slices

#: Labelled rows of each language that the model is fitted on, about: those with the smallest hashes of their id.
SAMPLE = 4_000
BUCKETS = 1 << 16
SMOOTHING = 0.1
#: A word's likelihoods are held within this factor (as a logarithm), so that no single word decides.
CLIP = 8.0
ROUNDS = 12
#: Letters times languages whose likelihoods are looked up at once.
LETTERS = 4_000_000
#: A further language must raise twice the logarithm of the likelihood by this times the logarithm of the number of words.
PENALTY = 6.0

FOLD = np.zeros(256, np.uint32)
for _b in range(97, 123):
    FOLD[_b] = FOLD[_b - 32] = _b
FOLD[128:] = np.arange(128, 256)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the trigram around each letter, first letter of each word, index of the word's text)."""
    buffer = FOLD[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    at = np.flatnonzero(buffer)
    if not len(at):
        return at, at, at
    before = buffer[np.maximum(at - 1, 0)]
    if at[0] == 0:
        before[0] = 0
    code = before * np.uint32(0x9E3779B1) + buffer[at] * np.uint32(0x85EBCA6B) + buffer[at + 1] * np.uint32(0xC2B2AE35)
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return code >> np.uint32(16), first, np.searchsorted(ends, at[first], side="right")


def fit(docs: DataFrame, text_col: str, lang_col: str, id_col: str, allowed: Column, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each bucket in each): from about ``sample`` rows of each language."""
    known = docs.where(allowed & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((BUCKETS, 0), np.float32)
    limits = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, float(min(1.0, sample / n)))))
    share = F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.where(share < F.element_at(limits, F.col(lang_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text"))

    def count(batches):
        import pyarrow as pa

        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                names = np.array(part.column("lang").to_pylist(), object)
                texts = part.column("text").to_pylist()
                for name in set(names):
                    code = trigrams([t for t, n in zip(texts, names, strict=True) if n == name])[0]
                    total[name] = total.get(name, 0) + np.bincount(code, minlength=BUCKETS)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    table = np.zeros((BUCKETS, len(languages)))
    for lang, bucket, n in chosen.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n")).collect():
        table[bucket, languages.index(lang)] = n  # 65,536 rows for each language at most
    table += SMOOTHING
    return languages, np.log(table / table.sum(axis=0)).astype(np.float32)


def proportions(like: np.ndarray, text: np.ndarray, starts: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation of each text's proportions over its ``allowed`` languages; also the log likelihood."""
    n = np.diff(np.r_[starts, len(text)])[:, None]
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        part = like * share[text]
        part /= part.sum(axis=1, keepdims=True)
        share = np.add.reduceat(part, starts) / n
    mixed = np.einsum("ij,ij->i", like, share[text])
    return share, np.add.reduceat(np.log(mixed), starts)


def infer(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, confidence in the leading language) of each text; zeros for texts without words."""
    k = table.shape[1]
    shares, score = np.zeros((len(texts), k)), np.zeros(len(texts))
    code, first, text = trigrams(texts)
    if not len(first) or not k:
        return shares, score
    logs = np.empty((len(first), k), np.float32)
    ends = np.r_[first[1:], len(code)]
    step = max(1, LETTERS // k)
    cuts = np.unique(np.r_[np.searchsorted(ends, np.arange(0, len(code), step)), len(first)])
    for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):  # whole words, of so many letters in sum
        if b > a:
            logs[a:b] = np.add.reduceat(table[code[first[a] : ends[b - 1]]], first[a:b] - first[a], axis=0)
    logs = np.maximum(logs - logs.max(axis=1, keepdims=True), -CLIP)
    like = np.exp(logs)
    present, starts = np.unique(text, return_index=True)
    text = np.searchsorted(present, text)
    words = np.diff(np.r_[starts, len(text)])
    sums = np.add.reduceat(logs, starts, axis=0).astype(np.float64)
    rows = np.arange(len(present))
    best = sums.argmax(axis=1)
    allowed = np.zeros((len(present), k), bool)
    allowed[rows, best] = True
    share, total = allowed.astype(np.float64), sums[rows, best]
    live = rows
    while len(live) and k > 1:
        own = np.isin(text, live, assume_unique=False) if len(live) < len(present) else np.ones(len(text), bool)
        sub_like, sub_text = like[own], np.searchsorted(live, text[own])
        sub_starts = np.flatnonzero(np.r_[True, sub_text[1:] != sub_text[:-1]])
        mixed = np.einsum("ij,ij->i", sub_like, share[live][sub_text])
        rise = np.add.reduceat(sub_like / mixed[:, None], sub_starts) / words[live][:, None] - 1
        rise[allowed[live]] = -1
        new = rise.argmax(axis=1)
        trial = allowed[live].copy()
        trial[np.arange(len(live)), new] = True
        hopeful = rise.max(axis=1) > 0
        found, log = proportions(sub_like, sub_text, sub_starts, trial)
        better = hopeful & (2 * (log - total[live]) > PENALTY * np.log(np.maximum(words[live], 2)))
        live, found, log, trial = live[better], found[better], log[better], trial[better]
        share[live], total[live], allowed[live] = found, log, trial
    shares[present] = share
    odds = np.exp(sums - sums.max(axis=1, keepdims=True))
    lead = share.argmax(axis=1)
    single = allowed.sum(axis=1) == 1
    score[present] = np.where(single, (odds / odds.sum(axis=1, keepdims=True))[rows, lead], share[rows, lead])
    return shares, score


def identify(docs: DataFrame, languages: list[str], table: np.ndarray, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score, and proportions as a map of the languages found to their shares."""
    own = docs.select(*keep)
    text, *added = (free_name(own, c) for c in ("text", "lang_pred", "score", "proportions"))
    source = docs.select(*keep, F.col(text_col).alias(text))
    fields = [f for f in source.schema.fields if f.name != text]
    names = [f.name for f in fields]
    types = ("string", "double", "map<string,double>")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"`{c}` {t}" for c, t in zip(added, types, strict=True))])
    most = max(1, 4 * SLICE_BYTES // max(4, len(languages)))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, text, most):
                raw = [t or "" for t in part.column(text).to_pylist()]
                shares, score = infer([t.encode() for t in raw], table)
                lead = shares.argmax(axis=1) if len(languages) else np.zeros(len(raw), int)
                sure = [bool(len(languages)) and s > 0 and (t.isascii() or any(map(str.isalpha, t))) for s, t in zip(score, raw, strict=True)]
                pred = [languages[k] if ok else "und" for k, ok in zip(lead, sure, strict=True)]
                mixture = [[(languages[k], float(row[k])) for k in np.flatnonzero(row)] if ok else [] for row, ok in zip(shares, sure, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(pred, pa.string()), pa.array(np.where(sure, np.clip(score, 0, 1), 0.0), pa.float64()), pa.array(mixture, pa.map_(pa.string(), pa.float64()))],
                    [*names, *added],
                )

    return source.mapInArrow(run, schema)
