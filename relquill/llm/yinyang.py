"""Centroid clustering by Yinyang k-means over integer vectors, exact with and without the bounds.

The first centroids are clustered into groups once. Each vector keeps an upper bound of the distance to its centroid and one
lower bound for each group of the others. After centroids move, bounds move with them: a vector whose upper bound lies under
all its lower bounds is passed over, of the others only the groups whose bound is reached are looked at, and in these only
centroids that their own drift lets come near enough are compared, in integers. Bounds are floating-point numbers with slack on
the safe side, so they never decide a near tie.

Vectors that aren't of the stated dimension, or have a null, infinite or undefined component, are left out. Components beyond
2^27 after scaling count as that, so that distances fit 64 bits. Equal distances go to the smaller centroid number. Repeated rows are
vectors of their own; of equal ids (null ids last) the smaller vector comes first where centroids are chosen. Fewer vectors than
centroids give fewer centroids; an empty table gives an empty result. A sum of distances beyond 64 bits is null. Only the named
columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, tidy

#: Largest size of a scaled component.
LARGEST = 1 << 27
#: Distances up to this size of component are exact in floating-point products.
EXACT = 1 << 21
#: Centroids in a group, about.
GROUP = 10
#: Differences of vectors and centroids that are held at once.
CELLS = 4_000_000
SLACK = 1e-9


def usable(vector: Column, dim: int) -> Column:
    """True for vectors of ``dim`` finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & fine, F.lit(False))


def scaled(column, dim: int, scale: float) -> np.ndarray:
    """floor(scale * x) of each component of an Arrow column of lists."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return np.clip(np.floor(flat * scale), -LARGEST, LARGEST).astype(np.int64).reshape(-1, dim)


def unpacked(column, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def packed(x: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in x]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of ``x`` to the row of ``c`` beside it, in integers."""
    out = np.empty(len(x), np.int64)
    step = max(1, CELLS // max(1, x.shape[1]))
    for a in range(0, len(x), step):
        d = x[a : a + step].astype(np.int64) - c[a : a + step]
        out[a : a + step] = np.einsum("ij,ij->i", d, d)
    return out


def all_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of ``x`` to each row of ``c``, in integers."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        u, v = x.astype(np.float64), c.astype(np.float64)
        return ((u * u).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2 * u @ v.T).astype(np.int64)
    rows, columns = np.divmod(np.arange(len(x) * len(c)), len(c))
    return squared(x[rows], c[columns]).reshape(len(x), len(c))


def grouped(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid, by a few rounds of k-means over the centroids themselves."""
    heads = centroids[:: max(1, len(centroids) // groups)][:groups].astype(np.float64)
    own = np.zeros(len(centroids), np.int64)
    for _ in range(rounds):
        own = ((centroids[:, None, :] - heads[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(len(heads)):
            if (own == g).any():
                heads[g] = centroids[own == g].mean(axis=0)
    return np.unique(own, return_inverse=True)[1]


class Round:
    """What one round knows: the centroids, their groups and how far they and their groups moved."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None, group: np.ndarray):
        self.centroids, self.group = centroids, group
        moved = np.zeros(len(centroids)) if before is None else np.sqrt(squared(centroids, before).astype(np.float64))
        self.moved = moved * (1 + SLACK)
        self.group_moved = np.array([self.moved[group == g].max() for g in range(group.max() + 1)])
        self.members = [np.flatnonzero(group == g) for g in range(group.max() + 1)]

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(centroid, upper bound, lower bounds) of each vector from those of the round before, and the number of distances taken."""
        own, upper = own.copy(), upper + self.moved[own]
        drifted = np.maximum(lower - self.group_moved, 0)
        reach = lambda u: u * (1 + SLACK) + SLACK
        rows = np.flatnonzero(drifted.min(axis=1) <= reach(upper))  # global filter
        exact = squared(x[rows], self.centroids[own[rows]])
        taken = len(rows)
        upper[rows] = np.sqrt(exact.astype(np.float64)) * (1 + SLACK)
        near = drifted[rows].min(axis=1) <= reach(upper[rows])  # again, with the exact distance
        rows, exact = rows[near], exact[near]
        best, best_at = exact.copy(), own[rows].copy()
        bound = drifted[rows]
        seen = []  # (row, centroid, distance) of what was compared
        for g, members in enumerate(self.members):
            open_ = np.flatnonzero(drifted[rows, g] <= reach(upper[rows]))  # group filter
            if not len(open_):
                continue
            own_bound = np.maximum(lower[rows[open_], g][:, None] - self.moved[members][None, :], 0)
            other = members[None, :] != own[rows[open_]][:, None]
            survives = other & (own_bound <= reach(upper[rows[open_]])[:, None])  # local filter
            bound[open_, g] = np.where(other & ~survives, own_bound, np.inf).min(axis=1, initial=np.inf)
            r, c = np.nonzero(survives)
            if not len(r):
                continue
            r, c = open_[r], members[c]
            d = all_squared(x[rows[open_]], self.centroids[members])[survives] if survives.mean() > 0.5 else squared(x[rows[r]], self.centroids[c])
            taken += len(r)
            seen.append((r, c, d))
        if seen:
            r, c, d = (np.concatenate(k) for k in zip(*seen, strict=True))
            order = np.lexsort((c, d, r))
            first = order[np.r_[True, r[order][1:] != r[order][:-1]]]
            at = r[first]
            better = (d[first] < best[at]) | ((d[first] == best[at]) & (c[first] < best_at[at]))
            best[at[better]], best_at[at[better]] = d[first][better], c[first][better]
            left = np.flatnonzero(best_at != own[rows])  # the centroid that a vector leaves bounds its group as well
            r, c, d = np.r_[r, left], np.r_[c, own[rows[left]]], np.r_[d, exact[left]]
            lost = c != best_at[r]
            np.minimum.at(bound, (r[lost], self.group[c[lost]]), np.sqrt(d[lost].astype(np.float64)) * (1 - SLACK))
        drifted[rows] = bound
        own[rows], upper[rows] = best_at, np.sqrt(best.astype(np.float64)) * (1 + SLACK)
        return own, upper, drifted, taken


def first_centroids(vectors: DataFrame, k: int, salt: str, dim: int, scale: float) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of their id."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    chosen = vectors.select(key.alias("key"), "vector").orderBy(F.col("key").asc_nulls_last(), "vector").limit(k).select("vector").toArrow()
    return scaled(chosen.column("vector").combine_chunks(), dim, scale) if chosen.num_rows else np.zeros((0, dim), np.int64)


def new_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of the mean of each centroid's vectors; one without vectors stays."""
    k, dim = centroids.shape

    def sums(batches):
        import pyarrow as pa

        total, n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            own = batch.column("own").to_numpy()
            x = unpacked(batch.column("vector"), np.int32, dim).astype(np.int64)
            order = np.argsort(own, kind="stable")
            found, at = np.unique(own[order], return_index=True)
            if len(found):
                total[found] += np.add.reduceat(x[order], at, axis=0)
                n += np.bincount(own, minlength=k)
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(found, dim), pa.int32()), pa.array(np.tile(np.arange(dim), len(found)), pa.int32()), pa.array(total[found].reshape(-1)), pa.array(np.repeat(n[found], dim))],
            ["own", "place", "total", "n"],
        )

    parts = state.select("own", "vector").mapInArrow(tidy(sums), "own int, place int, total long, n long")
    total = parts.groupBy("own", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in total.toLocalIterator():  # centroids x components at most
        out[r["own"], r["place"]] = int(r["total"]) // r["n"]
    return out


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, salt: str = "2") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid): one row for each usable vector of ``df``.

    Each of ``rounds`` rounds assigns all vectors and moves the centroids; then all are assigned once more. centroid: the
    components of the cluster's last centroid.
    """
    vectors = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).where(usable(F.col("vector"), dim))
    centroids = first_centroids(vectors, k, salt, dim, scale)
    id_type = vectors.schema["id"].dataType.simpleString()
    if not len(centroids):
        return vectors.select(F.col("id").alias(id_col), *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid", "array<long>")))).where("false")
    group = grouped(centroids, -(-len(centroids) // GROUP))
    width = int(group.max()) + 1
    schema = f"id {id_type}, vector binary, own int, upper double, lower binary"

    def begin(batches):
        import pyarrow as pa

        for batch in batches:
            x = scaled(batch.column("vector"), dim, scale)
            first = np.sqrt(squared(x, np.broadcast_to(centroids[0], x.shape)).astype(np.float64)) * (1 + SLACK)
            columns = [pa.array(packed(x.astype(np.int32)), pa.binary()), pa.array(np.zeros(len(x), np.int32)), pa.array(first), pa.array(packed(np.zeros((len(x), width))), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "vector", "own", "upper", "lower"])

    def step(now: Round):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                x = unpacked(batch.column("vector"), np.int32, dim).astype(np.int64)
                lower = unpacked(batch.column("lower"), np.float64, width)
                own, upper, lower, _ = now.assign(x, batch.column("own").to_numpy().astype(np.int64), batch.column("upper").to_numpy(), lower)
                columns = [pa.array(own, pa.int32()), pa.array(upper), pa.array(packed(lower), pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), *columns], ["id", "vector", "own", "upper", "lower"])

        return tidy(run)

    state, before, written = vectors.mapInArrow(tidy(begin), schema), None, None
    for n in range(rounds + 1):
        state = materialise(state.mapInArrow(step(Round(centroids, before, group)), schema), "yinyang")
        if written is not None:
            discard(written)
        written = state
        if n < rounds:
            before, centroids = centroids, new_centroids(state, centroids)

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            x = unpacked(batch.column("vector"), np.int32, dim)
            d = squared(x, centroids[batch.column("own").to_numpy()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("own"), pa.array(d)], ["id", "cluster", "distance"])

    found = state.select("id", "vector", "own").mapInArrow(tidy(measure), f"id {id_type}, cluster int, distance long")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()  # one row for each centroid
    fits = lambda x: x if x < 1 << 63 else None
    total = fits(sum(int(r["total"]) for r in sums))
    about = df.sparkSession.createDataFrame([(r["cluster"], fits(int(r["total"])), total, [int(x) for x in centroids[r["cluster"]]]) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: Column) -> Column:
    """Lowercase hex SHA-256 of the components as decimal integers joined by commas."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)


def cluster_sql(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2") -> str:
    """The same over ``embeddings`` in DuckDB SQL, comparing all centroids in each round."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale}::DOUBLE * x)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dim})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id)) - 1 AS k, x AS c FROM v ORDER BY sha256('{salt}:' || vec_id) LIMIT {k})",
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (SELECT r, vec_id, x, min_by(k, (d, k)) AS k, min(d) AS d FROM (SELECT v.r, v.vec_id, v.x, k, list_sum(list_transform(list_zip(v.x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
  FROM v, c{n}) GROUP BY r, vec_id, x)"""
        )
        if n < rounds:
            parts.append(
                f"""s{n} AS (SELECT k, p, sum(e) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS e, unnest(range(1, {dim + 1})) AS p FROM a{n}) GROUP BY k, p),
c{n + 1} AS MATERIALIZED (SELECT c{n}.k, coalesce(m.c, c{n}.c) AS c FROM c{n} LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS c FROM s{n} GROUP BY k) m USING (k))"""
            )
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, a.k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.k"""
    )
