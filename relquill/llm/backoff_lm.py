"""Language-model scores by stupid backoff, each text under the counts of all other texts.

Texts are dealt into blocks of bounded size. A block sends each of its distinct n-grams once, with its count, to the hash
partition that owns the n-gram; there the count tables are summed over all blocks and joined back to the n-grams sent. The
block then explodes its texts into n-grams, takes the text's own occurrences off the counts, and sums the scores of each text.
A very common n-gram therefore comes once from each block, not once from each text.

An n-gram table travels as sorted arrays of 64-bit hashes, one for each pair of block and partition, and what comes back are
the counts in the same order. A pair without common n-grams sends nothing, so there are never more tables than rows of single
n-grams would be: their number grows with the square of the blocks while tables are long, then in proportion. Null and empty texts have no words and a null score. Repeated rows count as texts of their own; a text of any length is scored whole; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import NOT_SPACE, gram_hashes, word_hashes

#: Bytes of text in a block, about; a block with a longer text is as large as that.
BLOCK_BYTES = 5_000_000
ALPHA = 0.4


def planes(x: np.ndarray) -> bytes:
    """The array's bytes, all first bytes first: sorted or small numbers then compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


class Grams:
    """The n-grams of one order in a block: distinct hashes by partition, and where each occurrence is among them."""

    def __init__(self, words: np.ndarray, text: np.ndarray, n: int, parts: int):
        found, self.ends = gram_hashes(words, text, n)
        keys, back, self.counts = np.unique(found, return_inverse=True, return_counts=True)
        part = (keys % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.keys, self.counts, self.part, self.back = keys[by], self.counts[by].astype(np.uint32), part[by], place[back]


def block_words(table) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([x or b"" for x in table.column("text").to_pylist()], NOT_SPACE)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """The sum of each key's counts over all arrays, in 64 bits, for each key of each array."""
    _, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(back.max(initial=-1) + 1, np.int64)
    np.add.at(total, back, np.concatenate(counts).astype(np.int64))
    return np.split(total[back], np.cumsum([len(k) for k in keys])[:-1])


def backoff_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, n_backed_off, log_score): words, words whose longest n-gram no other text has, mean log10 score.

    A word that no other text has counts as seen once.
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    source = df.select(F.col(id_col).alias("id"), body.alias("text"))

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
                inside = NOT_SPACE[buffer]
                yield pa.RecordBatch.from_arrays([pa.array([len(buffer)], pa.int64()), pa.array([int((inside[:-1] & ~inside[1:]).sum())], pa.int64())], ["bytes", "words"])

    totals = source.select("text").mapInArrow(measure, "bytes long, words long").agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    parts, all_words = max(1, -(-totals[0] // block_bytes)), totals[1]
    row = F.monotonically_increasing_id()  # rows alike in id and text are dealt apart
    blocks = source.withColumn("row", row).select("id", "text", F.pmod(F.xxhash64("id", "row"), F.lit(parts)).cast("int").alias("block"))

    def send(table):
        import pyarrow as pa

        words, text = block_words(table)
        number = table.column("block")[0].as_py() if table.num_rows else 0
        rows = []
        for n in range(1, order + 1):
            own = Grams(words, text, n, parts)
            cuts = np.searchsorted(own.part, np.arange(parts + 1))
            rows += [(k, number, n, planes(own.keys[a:b]), planes(own.counts[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.table({c: pa.array(x, t) for (c, t), x in zip((("part", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())), columns, strict=True)})

    sent = blocks.groupBy("block").applyInArrow(send, "part int, block int, n int, grams binary, counts binary")

    def total(table):
        import pyarrow as pa

        rows = table.to_pylist()
        out = []
        for n in range(1, order + 1):
            own = [r for r in rows if r["n"] == n]
            if own:
                sums = summed([unplanes(r["grams"], np.uint64) for r in own], [unplanes(r["counts"], np.uint32) for r in own])
                out += [(r["block"], r["part"], n, planes(x)) for r, x in zip(own, sums, strict=True)]
        columns = list(zip(*out, strict=True))
        return pa.table({c: pa.array(x, t) for (c, t), x in zip((("block", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("totals", pa.binary())), columns, strict=True)})

    counted = sent.groupBy("part").applyInArrow(total, "block int, part int, n int, totals binary")

    def score(left, right):
        import pyarrow as pa

        words, text = block_words(left)
        texts = left.num_rows
        sizes = np.bincount(text, minlength=texts)
        rows = sorted(right.to_pylist(), key=lambda r: (r["n"], r["part"]))
        place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        log = np.zeros(len(words))
        settled = np.zeros(len(words), bool)
        backed = np.zeros(len(words), bool)
        others = {}
        for n in range(1, order + 1):
            own = Grams(words, text, n, parts)
            sums = np.concatenate([np.zeros(0, np.int64), *(unplanes(r["totals"], np.int64) for r in rows if r["n"] == n)])
            _, same, here = np.unique(own.back * texts + text[own.ends], return_inverse=True, return_counts=True)
            others[n] = np.zeros(len(words), np.int64)
            others[n][own.ends] = sums[own.back] - here[same]
        for n in range(order, 0, -1):
            possible = (place >= n - 1) & ~settled
            if n == 1:
                rest = np.maximum(all_words - sizes[text], 1)
                log[possible] += np.log10(np.maximum(others[1][possible], 1) / rest[possible])
                break
            seen = possible & (others[n] > 0)
            at = np.flatnonzero(seen)
            log[at] += np.log10(others[n][at] / others[n - 1][at - 1])
            settled |= seen
            missed = possible & ~seen
            log[missed] += np.log10(alpha)
            if n == order:
                backed = missed
        total_log = np.bincount(text, log, texts)
        mean = [x / k if k else None for x, k in zip(total_log.tolist(), sizes.tolist(), strict=True)]
        return pa.table({"id": left.column("id"), "n_words": pa.array(sizes, pa.int64()), "n_backed_off": pa.array(np.bincount(text, backed, texts).astype(np.int64)), "log_score": pa.array(mean, pa.float64())})

    schema = f"id {source.schema['id'].dataType.simpleString()}, n_words long, n_backed_off long, log_score double"
    found = blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(score, schema)
    return found.withColumnRenamed("id", id_col)


def backoff_sql(alpha: float = ALPHA) -> str:
    """DuckDB SQL for order 2 over ``documents`` with unique ids; log_score is rounded to 6 digits."""
    return f"""
WITH w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x09-\\x0D\\x20]+') AS ws FROM documents)),
p AS (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM w),
u AS (SELECT w, count(*) AS n FROM w GROUP BY w), ud AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL),
b AS (SELECT v, w, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY ALL), bd AS (SELECT doc_id, v, w, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY ALL),
size AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id), total AS (SELECT count(*) AS n FROM w),
s AS (SELECT p.doc_id, p.v, b.n - bd.n AS two, uv.n - uvd.n AS one_v, greatest(uw.n - uwd.n, 1) AS one_w, greatest((SELECT n FROM total) - size.n, 1) AS rest
  FROM p JOIN u uw ON uw.w = p.w JOIN ud uwd ON uwd.doc_id = p.doc_id AND uwd.w = p.w JOIN size ON size.doc_id = p.doc_id
  LEFT JOIN u uv ON uv.w = p.v LEFT JOIN ud uvd ON uvd.doc_id = p.doc_id AND uvd.w = p.v
  LEFT JOIN b ON b.v = p.v AND b.w = p.w LEFT JOIN bd ON bd.doc_id = p.doc_id AND bd.v = p.v AND bd.w = p.w),
r AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (v IS NOT NULL AND two = 0) AS n_backed_off,
  sum(CASE WHEN v IS NULL THEN log10(one_w / rest) WHEN two > 0 THEN log10(two / one_v) ELSE log10({alpha}) + log10(one_w / rest) END) / count(*) AS log_score FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(r.n_words, 0)::BIGINT AS n_words, coalesce(r.n_backed_off, 0)::BIGINT AS n_backed_off, round(r.log_score, 6) AS log_score
FROM documents d LEFT JOIN r USING (doc_id)"""
