"""SimHash near-duplicates: tiled exact comparison with exclusive-or and bit counts.

Distinct fingerprints are put in cells by the population counts of their four 16-bit words. Two fingerprints within the
radius lie in cells whose counts differ by the radius at most in sum, so all other tile pairs are skipped; what is left is
compared exactly. A cell of many fingerprints is cut into tiles of bounded size. Each tile task gives a spanning forest of
its links, and connected components are found over those with repeated star contractions.

Null and empty texts have fingerprint zero and link like any other; texts of any length count whole. Ties and repeated rows share
a fingerprint and hence a component, whose id is the smallest that isn't null; fingerprints with a large share of the rows are
broadcast to them. An empty table gives an empty result; only the named columns are read, so other names don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, slices, tidy, uneven_join

#: Most fingerprints of one cell that a tile holds.
TILE = 16_384
#: Rows and columns that one exclusive-or compares: 16 MB.
ROWS, COLUMNS = 256, 8_192
SIDE = 17  # a 16-bit word has 0 to 16 bits set


def shingle_hashes(text: bytes, words: int = 3) -> list[int]:
    """XXH64 (seed 42) of each shingle of the text in lower-case ASCII, repeats included."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()
    if not found:
        return []
    plain = b" ".join(found)
    if len(found) < words:
        return [xxh64_intdigest(plain, 42)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[: len(found) - words] + 1).tolist()]
    return [xxh64_intdigest(plain[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, words: int = 3) -> int:
    """64 bits, each 1 if it is set in over half of the shingles' hashes."""
    hashes = shingle_hashes(text, words)
    if not hashes:
        return 0
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        own = np.array(hashes[at : at + 65_536], "<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(own, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed 64-bit integer."""
    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary")).alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                found = np.array([fingerprint(x, words) for x in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    return source.mapInArrow(tidy(run), f"id {source.schema['id'].dataType.simpleString()}, fp long")


def cell(fp: Column) -> Column:
    """The number of the cell: population counts of the four 16-bit words as digits to base 17."""
    out = F.lit(0)
    for k in range(4):
        out = out * SIDE + F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF)))
    return out.cast("int")


def lower_neighbours(radius: int) -> list[tuple[int, ...]]:
    """Differences of population counts that come to ``radius`` at most in sum and lead to a cell of a smaller number."""
    span = range(-radius, radius + 1)
    return [d for d in ((a, b, c, e) for a in span for b in span for c in span for e in span) if sum(map(abs, d)) <= radius and d < (0, 0, 0, 0)]


def mixed(fp: np.ndarray) -> np.ndarray:
    x = fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)


def deal(cells: np.ndarray, fp: np.ndarray, tiles: np.ndarray, radius: int):
    """(key, role, fp) of each tile task that a fingerprint takes part in.

    A task (cell A, tile i, tile j) compares tile i of A (role 0) with tile j of A (if j > i) and of A's upper neighbours (role 1).
    ``tiles``: the number of tiles of each cell, 0 where it has no fingerprint.
    """
    wide = int(tiles.max())
    digits = np.stack([cells // SIDE**3, cells // SIDE**2 % SIDE, cells // SIDE % SIDE, cells % SIDE])
    own = (mixed(fp) % tiles[cells].astype(np.uint64)).astype(np.int64)

    def near(step: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        there = digits + np.array(step)[:, None]
        inside = ((there >= 0) & (there < SIDE)).all(axis=0)
        number = ((there[0] * SIDE + there[1]) * SIDE + there[2]) * SIDE + there[3]
        return np.where(inside, number, 0), inside

    # role 0: once for each number of tiles that an upper neighbour, or the cell itself, has
    most = tiles[cells].copy()
    for step in lower_neighbours(radius):
        there, inside = near(tuple(-x for x in step))
        most = np.maximum(most, np.where(inside, tiles[there], 0))
    at = np.repeat(np.arange(len(fp)), most)
    j = np.arange(len(at)) - np.repeat(np.cumsum(most) - most, most)
    yield (cells[at].astype(np.int64) * wide + own[at]) * wide + j, 0, fp[at]
    # role 1 in the own cell: the tiles before
    if wide > 1:
        at = np.repeat(np.arange(len(fp)), own)
        i = np.arange(len(at)) - np.repeat(np.cumsum(own) - own, own)
        yield (cells[at].astype(np.int64) * wide + i) * wide + own[at], 1, fp[at]
    for step in lower_neighbours(radius):
        there, inside = near(step)
        times = np.where(inside, tiles[there], 0)
        at = np.repeat(np.arange(len(fp)), times)
        i = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        yield (there[at].astype(np.int64) * wide + i) * wide + own[at], 1, fp[at]


def forest(a: np.ndarray, b: np.ndarray, inner: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of ``a`` with ``b``, and within ``a`` if ``inner``, as (fingerprint, its group's root), roots left out."""
    fps = np.concatenate([a, b])
    label = np.arange(len(fps))
    low = 0 if inner else len(a)
    counts = np.bitwise_count(fps.view(np.uint64)).astype(np.int16)
    rows = np.argsort(counts[: len(a)], kind="stable")
    columns = low + np.argsort(counts[low:], kind="stable")
    for r in range(0, len(rows), ROWS):
        left = rows[r : r + ROWS]
        for c in range(0, len(columns), COLUMNS):
            right = columns[c : c + COLUMNS]
            if counts[left[0]] - counts[right[-1]] > radius or counts[right[0]] - counts[left[-1]] > radius:
                continue
            x, y = np.nonzero(np.bitwise_count(fps[left].view(np.uint64)[:, None] ^ fps[right].view(np.uint64)[None, :]) <= radius)
            x, y = label[left[x]], label[right[y]]
            while True:  # hook the larger root of a link under the smaller, then point all at their roots
                apart = x != y
                if not apart.any():
                    break
                x, y = x[apart], y[apart]
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while (label[label] != label).any():
                    label = label[label]
                x, y = label[x], label[y]
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): links between fingerprints that join all within ``radius`` bits. ``distinct`` has one row for each fp."""
    sizes = distinct.groupBy(cell(F.col("fp")).alias("cell")).count().collect()  # 17^4 = 83,521 rows at most
    tiles = np.zeros(SIDE**4, np.int64)
    for row in sizes:
        tiles[row["cell"]] = -(-row["count"] // TILE)
    wide = int(tiles.max()) if len(sizes) else 1

    def emit(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                fp = part.column("fp").to_numpy()
                for key, role, out in deal(part.column("cell").to_numpy().astype(np.int64), fp, tiles, radius):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), role, np.int8)), pa.array(out)], ["key", "role", "fp"])

    def compare(batches):
        import pyarrow as pa

        def tasks(key, role, fp):
            for k in np.split(np.arange(len(key)), np.flatnonzero(key[1:] != key[:-1]) + 1):
                i, j = divmod(int(key[k[0]]) % (wide * wide), wide)
                u, v = forest(fp[k][role[k] == 0], fp[k][role[k] == 1], i == j, radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        held = [np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64)]
        for batch in batches:
            held = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(held, ("key", "role", "fp"), strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if last:
                yield from tasks(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if len(held[0]):
            yield from tasks(*held)

    dealt = distinct.select("fp", cell(F.col("fp")).alias("cell")).mapInArrow(tidy(emit), "key long, role byte, fp long")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(compare), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (u, v) reaches, by large-star and small-star rounds.

    A node with a large share of the links, like the centre of a star, is broadcast with its least neighbour, not shuffled to.
    """
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state["n"] == 0 or state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        before, old = state, edges
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = uneven_join(both, least, ["u"], total=2 * state["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "links")
        discard(old)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = uneven_join(large, least, ["u"], total=state["n"])  # about as many
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        edges = materialise(small, "links")
        discard(large)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``df``.

    Two rows are linked if their fingerprints differ in ``radius`` bits at most; component_id is the smallest id reachable.
    """
    rows = materialise(fingerprints(df, id_col, text_col, words), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = materialise(components(links(distinct, radius)), "roots")
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "least", "n")
    of_root = linked.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("members"))
    linked = uneven_join(materialise(linked, "linked"), of_root, ["root"], "members").select("fp", "component")
    found = distinct.join(linked, "fp", "left").select("fp", "n", F.coalesce("component", "least").alias("component_id"))
    joined = uneven_join(rows, found, ["fp"])
    return joined.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
