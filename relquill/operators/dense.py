"""Dense vectors: cosine, projections, chunk aggregators, a zero vector where there is none, a check of embedders, a hashed encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are broadcast to the candidates, at most; more are dealt into blocks.
QUERY_BLOCK = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` computed once for a row; inside a lambda function it would be computed for each component."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    scaled = lambda w: once(F.sqrt(dot(w, w)), lambda norm: F.transform(w, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0))))
    return once(v, scaled)


def blocks(queries: DataFrame, key: str = "qid") -> list[DataFrame]:
    """The query set in blocks of about QUERY_BLOCK rows, each small enough to be broadcast."""
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    return [queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)]


def searched(queries: DataFrame, cands: DataFrame, score: Column, top: int) -> DataFrame:
    """(qid, cand, score, rank): the ``top`` candidates of each query among all, smallest id on ties.

    ``queries``: qid and what ``score`` reads; ``cands``: cand and the same. Each scan of the candidates meets one block of
    queries; the best are kept before rows are shuffled.
    """
    out = None
    for q in blocks(queries):
        pairs = cands.join(F.broadcast(q), F.col("cand") != F.col("qid")).select("qid", "cand", score.alias("score"))
        w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "cand")
        part = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
        out = part if out is None else out.union(part)
    return out


#: Candidate vectors and query vectors in a tile, about; queries of a tile that are multiplied at once.
TILE_CANDIDATES, TILE_QUERIES, TILE_ROWS = 20_000, 10_000, 128

#: Key of a null score, which is the last of all, behind any number.
NULL = float(np.finfo(float).min)


def tiles(queries: DataFrame, cands: DataFrame, run, schema: str, cand: str = "cand", keys: tuple[str, ...] = ()) -> DataFrame:
    """``run`` on each tile, a block of ``queries`` (by qid) and a block of ``cands`` (by ``cand``) with the same ``keys``.

    As many blocks as the rows need, so a tile is bounded and no scan meets all queries; rows are shuffled once for each block of
    the other side.
    """
    cores = queries.sparkSession.sparkContext.defaultParallelism
    nq, nc = (max(least, -(-df.select(name).distinct().count() // size)) for df, name, size, least in ((queries, "qid", TILE_QUERIES, 1), (cands, cand, TILE_CANDIDATES, cores)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    by, parts = [*keys, "qb", "cb"], 3 * nq * nc
    left = queries.withColumn("qb", block("qid", nq)).withColumn("cb", every(nc)).repartition(parts, *by)
    right = cands.withColumn("cb", block(cand, nc)).withColumn("qb", every(nq)).repartition(parts, *by)
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)


def _components(column) -> tuple[np.ndarray, Callable[[int], np.ndarray]]:
    """Each vector's number of components, -1 where it or a component is null; and the matrix of those that have a given number."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(held), -1).to_numpy(zero_copy_only=False).copy()
    flat = pc.list_flatten(held)
    if flat.null_count:
        size[pc.list_parent_indices(held).to_numpy()[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = -1
    return size, lambda n: pc.list_flatten(held.filter(pa.array(size == n))).to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)


def _slices(column) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(rows, number of components or -1, matrix) of query vectors of one length, TILE_ROWS at a time."""
    size, matrix = _components(column)
    for n in np.unique(size):
        rows, own = np.flatnonzero(size == n), matrix(n) if n >= 0 else np.zeros((np.count_nonzero(size == n), 0))
        for k in range(0, len(rows), TILE_ROWS):
            yield rows[k : k + TILE_ROWS], n, own[k : k + TILE_ROWS]


def _largest(score: np.ndarray, null: np.ndarray, gone: list[list[int]], top: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``top`` largest scores of each row at 9 digits, smaller columns first on ties, without the columns ``gone``."""
    key = np.round(score, 9)
    if not np.isfinite(key).all():
        key = np.maximum(np.where(np.isnan(key), np.inf, key), NULL)  # Spark takes NaN as the largest
    key[np.broadcast_to(null, key.shape)] = NULL
    for row, columns in enumerate(gone):
        key[row, columns] = -np.inf
    n = key.shape[1]
    least = np.partition(key, n - top, axis=1)[:, n - top, None] if top < n else np.full((len(key), 1), NULL)
    rows, columns = np.nonzero((key >= least) & (key > -np.inf))
    order = np.lexsort((columns, -key[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < top
    return rows[kept], columns[kept]


def _places(names: list) -> dict:
    out: dict = {}
    for k, name in enumerate(names):
        out.setdefault(name, []).append(k)
    return out


def searched_dot(queries: DataFrame, cands: DataFrame, top: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, qid, cand, score, rank): ``searched`` by the dot product of ``qv`` and ``v``, as products of matrices in ``tiles``.

    ``queries``: keys, qid, qv; ``cands``: keys, cand, v. Vectors of different lengths, and null ones, have a null score, last of all.
    """
    types = [f"{f.name} {f.dataType.simpleString()}" for f in (*(queries.schema[k] for k in keys), queries.schema["qid"], cands.schema["cand"])]

    def run(key, left, right):
        import pyarrow as pa

        right = right.sort_by("cand")
        places, size, matrix = _places(right.column("cand").to_pylist()), *_components(right.column("v"))
        qids, out = left.column("qid"), []
        owns = qids.to_pylist()
        for rows, n, q in _slices(left.column("qv")) if right.num_rows else ():
            fits, v = size == n, np.zeros((len(size), max(n, 0)))
            fits = fits & (n >= 0)
            v[fits] = matrix(n) if fits.any() else 0
            score = q @ v.T
            r, c = _largest(score, ~fits, [places.get(owns[k], []) for k in rows], top)
            own = [pa.array([key[k].as_py()] * len(r), queries_schema[k]) for k in range(len(keys))]
            out.append(pa.table([*own, qids.take(pa.array(rows[r])), right.column("cand").take(pa.array(c)), pa.array(score[r, c], mask=~fits[c])], names=names))
        return pa.concat_tables(out) if out else pa.table([*(pa.array([], t) for t in queries_schema), left.column("qid").slice(0, 0), right.column("cand").slice(0, 0), pa.array([], pa.float64())], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    queries_schema, names = [to_arrow_type(queries.schema[k].dataType) for k in keys], [*keys, "qid", "cand", "score"]
    best = tiles(queries.select(*keys, "qid", "qv"), cands.select(*keys, "cand", "v"), run, ", ".join([*types, "score double"]), keys=keys)
    w = Window.partitionBy(*keys, "qid").orderBy(F.round("score", 9).desc(), "cand")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


AGGREGATORS = ("maxp", "firstp", "sump", "meanp", "whole_doc_mean")


def chunks_searched(queries: DataFrame, chunks: DataFrame, top: int, by: tuple[str, ...] = AGGREGATORS) -> DataFrame:
    """(qid, by, cand, aggregators, rank): the ``top`` documents of each query by each of the aggregators ``by`` of ``chunk_scores``.

    ``queries``: qid, q (unit vector), own (the document that is left out, or null); ``chunks``: cand, chunk_ix, v. Products of chunks are made
    and added up in ``tiles``; neither chunks nor pairs leave them.
    """
    types = [f"qid {queries.schema['qid'].dataType.simpleString()}", "by string", f"cand {chunks.schema['cand'].dataType.simpleString()}", *(f"{a} double" for a in AGGREGATORS)]
    names = ["qid", "by", "cand", *AGGREGATORS]

    def run(key, left, right):
        import pyarrow as pa

        right = right.sort_by([("cand", "ascending"), ("chunk_ix", "ascending")])
        docs = right.column("cand").unique() if right.num_rows else right.column("cand")
        places = {name: k for k, name in enumerate(docs.to_pylist())}
        at = np.array([places[name] for name in right.column("cand").to_pylist()], int)
        size, matrix = _components(right.column("v"))
        there = right.column("v").is_valid().to_numpy()
        owns, qids, out = left.column("own").to_pylist(), left.column("qid"), []
        for rows, n, q in _slices(left.column("q")) if right.num_rows else ():
            fits = (size == n) & (n >= 0)
            broken = np.zeros(len(places), bool)
            broken[at[there & ~fits]] = True  # vectors of another length make the mean null
            have, starts, counts = np.unique(at[fits], return_index=True, return_counts=True)
            score = {a: np.full((len(rows), len(places)), -1.0) for a in AGGREGATORS}
            if len(have):
                v = matrix(n)
                p = q @ v.T
                total, mean = np.add.reduceat(p, starts, axis=1), np.add.reduceat(v, starts, axis=0)
                norm = np.sqrt((mean * mean).sum(axis=1))
                whole = np.where(norm == 0, -1.0, q @ (mean / np.where(norm == 0, 1.0, norm)[:, None]).T)
                for a, x in (("maxp", np.maximum.reduceat(p, starts, axis=1)), ("firstp", p[:, starts]), ("sump", total), ("meanp", total / counts), ("whole_doc_mean", whole)):
                    score[a][:, have] = x
            none = np.zeros(len(places), bool)
            for name in by:
                null = broken if name == "whole_doc_mean" else none
                r, c = _largest(score[name], null, [[places[owns[k]]] if owns[k] in places else [] for k in rows], top)
                held = [pa.array(score[a][r, c], mask=broken[c] if a == "whole_doc_mean" else none[c]) for a in AGGREGATORS]
                out.append(pa.table([qids.take(pa.array(rows[r])), pa.array([name] * len(r), pa.string()), docs.take(pa.array(c)), *held], names=names))
        return pa.concat_tables(out) if out else pa.table([qids.slice(0, 0), pa.array([], pa.string()), right.column("cand").slice(0, 0), *(pa.array([], pa.float64()) for _ in AGGREGATORS)], names=names)

    best = tiles(queries.select("qid", "q", "own"), chunks.select("cand", "chunk_ix", "v"), run, ", ".join(types))
    value = F.coalesce(*(F.when(F.col("by") == a, F.col(a)) for a in by))
    w = Window.partitionBy("qid", "by").orderBy(F.round(value, 9).desc(), "cand")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def zero_filled(nodes: DataFrame, vectors: DataFrame, dim: int, v: str = "v") -> DataFrame:
    """``nodes`` with their vector, or zeros where they have none. Both have ``node``."""
    return nodes.join(vectors, "node", "left").withColumn(v, F.coalesce(v, F.array_repeat(F.lit(0.0), dim)))


def projected(v: Column, matrix: list[list[float]]) -> Column:
    """The matrix (of bounded size, as a literal) times the vector, at length 1."""
    rows = F.array(*(F.array(*map(F.lit, map(float, row))) for row in matrix))
    return once(v, lambda w: unit(F.transform(rows, lambda r: dot(r, w))))


def chunk_scores(pairs: DataFrame, keys: tuple[str, ...] = ("qid", "cand")) -> DataFrame:
    """Aggregators of chunk scores by document. ``pairs``: keys, chunk_ix, q (unit query vector), v (chunk vector, null for none).

    maxp, firstp, sump, meanp over the products; whole_doc_mean is the cosine of the mean vector. A document without chunks, and a
    zero mean vector, scores -1.
    """
    held = pairs.withColumn("p", F.when(F.col("v").isNotNull(), dot(F.col("q"), F.col("v"))))
    total = F.transform(F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("chunk_ix", "v")))), lambda x: x["v"])  # the chunks of one document
    out = held.groupBy(*keys).agg(
        *(F.coalesce(x, F.lit(-1.0)).alias(n) for n, x in (("maxp", F.max("p")), ("firstp", F.min_by("p", F.when(F.col("p").isNotNull(), F.col("chunk_ix")))), ("sump", F.sum("p")), ("meanp", F.avg("p")))),
        total.alias("vs"), F.any_value("q").alias("q"),
    )
    added = F.aggregate(F.slice("vs", 2, F.greatest(F.size("vs") - 1, F.lit(0))), F.get("vs", F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    whole = F.when(F.size("vs") == 0, -1.0).when(dot(added, added) == 0, -1.0).otherwise(dot(unit(added), F.col("q")))
    return out.select(*keys, "maxp", "firstp", "sump", "meanp", whole.alias("whole_doc_mean"))


def sanity(vectors: DataFrame, group: str, margin: float = 0.05) -> DataFrame:
    """One row: mean product of unit vectors of one group and of different groups, and whether the first is ``margin`` above.

    ``vectors``: v, group. From sums of vectors, without any pair: n^2 times the mean product is the squared length of the sum.
    """
    long = vectors.select(F.col(group).alias("g"), F.posexplode(unit(F.col("v"))).alias("dim", "x"))
    sums = long.groupBy("g", "dim").agg(F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("own"), F.count("*").alias("n"))
    all_ = sums.groupBy("dim").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("square"))
    by = sums.groupBy("g").agg(F.sum(F.col("x") * F.col("x")).alias("square"), F.sum("own").alias("own"), F.max("n").alias("n"))
    by = by.agg(F.sum(F.col("square") - F.col("own")).alias("within"), F.sum("square").alias("square_in"), F.sum(F.col("n") * (F.col("n") - 1)).alias("n_in"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    both = by.join(all_).select((F.col("within") / F.col("n_in")).alias("related"), ((F.col("square") - F.col("square_in")) / (F.col("n") * F.col("n") - F.col("nn"))).alias("unrelated"))
    return both.withColumn("usable", F.col("related") > F.col("unrelated") + margin)


def embedded(df: DataFrame, id_col: str, text_col: str, encoder: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """(id, v): the vectors that an external model gives; ``encoder`` is called once in each Python worker and loads it."""

    def run(batches):
        import pandas as pd

        encode = encoder()
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            yield pd.DataFrame({"id": batch["id"], "v": encode(texts)})

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInPandas(run, f"id {source.schema['id'].dataType.simpleString()}, v array<double>")


def hashed_encoder(dim: int = 64) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """The default where no model is at hand: logarithmic counts of words in ``dim`` crc32 buckets, at length 1."""

    def load():
        import math
        import re
        import zlib
        from collections import Counter

        def encode(texts: list[str]) -> list[list[float]]:
            out = []
            for text in texts:
                v = [0.0] * dim
                for word, n in Counter(re.findall("[a-z0-9]+", text.lower())).items():
                    v[zlib.crc32(word.encode()) % dim] += 1 + math.log(n)
                norm = math.sqrt(sum(x * x for x in v)) or 1.0
                out.append([x / norm for x in v])
            return out

        return encode

    return load
