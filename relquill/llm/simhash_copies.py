"""SimHash near-dedup of texts: the comparison of tiles as the search, an exact similarity of word shingles as the rule.

Two texts are linked if their sets of ``words``-word shingles have a Jaccard similarity of ``tenths`` tenths or more. Each text has
a fingerprint of 256 bits over its distinct shingles. At a similarity of 0.8 two fingerprints differ in 39 bits on average (48 for
very short texts, where a majority is coarser) with a deviation of 6, those of unrelated texts in 128. The radius is five
deviations above that average, so a pair at the bound is missed about once in a million times, and few pairs have to be read to be
compared exactly.

Similar sets have similar sizes, so a tile holds fingerprints of one class of sizes and meets only the tiles of the same and
of the next class; within a pair of tiles, stretches whose sizes or population counts differ too much are skipped. First each
fingerprint proposes its nearest neighbour, and the pair of texts is compared exactly. Fingerprints that then
still have one within the radius in another component then meet once more with their sets, and a tile task compares those
pairs exactly and gives a spanning forest of the links. So no step gives all the pairs of a group, and no link is lost.

Null and empty texts are equal to each other and link to nothing else; texts of any length count whole; equal texts and repeated
rows are one fingerprint; rows without an id link like any other; an empty table gives an empty result. Only the named columns are
read, and ``drop_near_copies`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_SLICE_BYTES, free_name, materialise, slices, tidy, uneven_join
from .simhash import components, mixed
from .tokens import STEP, mix, shingle_sets

WORDS64 = 4
#: Bits that two fingerprints may differ in, for sets of fewer than SHORT shingles and for others.
SHORT, RADIUS, LONG_RADIUS = 64, 80, 68
#: Most fingerprints of one class of sizes that a tile holds, and the least for which a class is cut into TILES for its cores.
TILE, SMALL_TILE, TILES = 32_768, 1_024, 4
#: Bytes of shingle sets in a tile, about, where these are compared.
TILE_BYTES = 16_000_000
ROWS, COLUMNS = 128, 8_192
#: Rows that a key has in one task of the join that fetches texts, about.
KEY_ROWS = 256
#: Rows that are broadcast, at most; their number is counted first, and beyond it they are shuffled.
BROADCAST = 1_000_000
LANES = np.uint64(0x0101010101010101)


def fingerprints(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of WORDS64 64-bit words for each set; a bit is 1 if it is set in over half of the set's hashes."""
    sizes = np.diff(np.r_[starts, len(hashes)])
    runs = -(-sizes // 255)  # a byte counts up to 255
    first = np.cumsum(runs) - runs
    at = np.repeat(starts, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    out = np.zeros((len(starts), WORDS64), np.uint64)
    for w in range(WORDS64):
        own = mix(hashes + STEP * np.uint64(w + 1))
        for k in range(8):
            lanes = np.add.reduceat((own >> np.uint64(k)) & LANES, at)
            counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
            bits = (2 * counts > sizes[:, None]).astype(np.uint64)
            out[:, w] |= (bits << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(k))).sum(axis=1, dtype=np.uint64)
    return out


def prints(df: DataFrame, words: int) -> DataFrame:
    """(id, key, wide, size, f0 ... f3) of each row of (id, key, text): wide is a hash of the set in 128 bits, size that of the set."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, most=SMALL_SLICE_BYTES):
                hashes, starts = shingle_sets(part.column("text").to_pylist(), words)
                wide = np.stack([mix(np.add.reduceat(mix(hashes * k + STEP), starts)) for k in (np.uint64(1), STEP)], axis=1)
                found = fingerprints(hashes, starts).view(np.int64)
                sizes = np.diff(np.r_[starts, len(hashes)])
                columns = [sizes, *(np.ascontiguousarray(found[:, k]) for k in range(WORDS64))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array([x.tobytes() for x in wide], pa.binary()), *map(pa.array, columns)], names)

    names = ["id", "key", "wide", "size", *(f"f{k}" for k in range(WORDS64))]
    schema = ", ".join([f"id {df.schema['id'].dataType.simpleString()}, key binary, wide binary", *(f"{c} long" for c in names[3:])])
    return df.select("id", "key", "text").mapInArrow(tidy(run), schema)


def size_class(size: np.ndarray, tenths: int) -> np.ndarray:
    """Sets that reach the similarity are in one class or in neighbouring ones."""
    return np.floor(np.log(size) / (np.log(10 / tenths) + 1e-6)).astype(np.int64)


def pairs_within(a: dict[str, np.ndarray], b: dict[str, np.ndarray], tenths: int):
    """(row of a, row of b, distance) of all pairs of two components within the radius whose sizes allow the similarity, in blocks."""
    rows, columns = np.argsort(a["size"], kind="stable"), np.argsort(b["size"], kind="stable")
    low = np.searchsorted(b["size"][columns], -(-tenths * a["size"][rows] // 10))
    high = np.searchsorted(b["size"][columns], 10 * a["size"][rows] // tenths, side="right")
    count_a, count_b = (np.bitwise_count(x["fp"]).sum(axis=1, dtype=np.int64) for x in (a, b))
    for r in range(0, len(rows), ROWS):
        left = rows[r : r + ROWS]
        for c in range(int(low[r : r + ROWS].min()), int(high[r : r + ROWS].max()), COLUMNS):
            right = columns[c : c + COLUMNS]
            if count_a[left].min() - count_b[right].max() > RADIUS or count_b[right].min() - count_a[left].max() > RADIUS:
                continue
            apart = np.zeros((len(left), len(right)), np.uint16)
            for w in range(WORDS64):
                apart += np.bitwise_count(a["fp"][left, w][:, None] ^ b["fp"][right, w][None, :])
            x, y = np.nonzero(apart <= RADIUS)
            distance = apart[x, y]
            x, y = left[x], right[y]
            less, more = np.minimum(a["size"][x], b["size"][y]), np.maximum(a["size"][x], b["size"][y])
            fits = (a["root"][x] != b["root"][y]) & (10 * less >= tenths * more) & ((distance <= LONG_RADIUS) | (less < SHORT))
            if fits.any():
                yield x[fits], y[fits], distance[fits]


def nearest(a: dict[str, np.ndarray], b: dict[str, np.ndarray], tenths: int):
    """(node, its nearest node in another component, distance), for the rows of both."""
    best = [np.full(len(x["node"]), 2**62, np.int64) for x in (a, b)]
    base = max(len(a["node"]), len(b["node"]))
    for x, y, distance in pairs_within(a, b, tenths):
        np.minimum.at(best[0], x, distance.astype(np.int64) * base + y)
        np.minimum.at(best[1], y, distance.astype(np.int64) * base + x)
    for own, other, found in ((a, b, best[0]), (b, a, best[1])):
        at = np.flatnonzero(found < 2**62)
        yield own["node"][at], other["node"][found[at] % base], found[at] // base


def unsettled(a: dict[str, np.ndarray], b: dict[str, np.ndarray], tenths: int):
    """The nodes of both that have one within the radius in another component; the other columns play no part."""
    seen = [np.zeros(len(x["node"]), bool) for x in (a, b)]
    for x, y, _ in pairs_within(a, b, tenths):
        seen[0][x] = seen[1][y] = True
    for own, found in zip((a, b), seen, strict=True):
        node = own["node"][found]
        yield node, node, np.zeros(len(node), np.int64)


def exact(a: dict[str, np.ndarray], b: dict[str, np.ndarray], tenths: int):
    """A spanning forest of the pairs that reach the similarity, as (node, other node, 0)."""
    label: dict[int, int] = {}

    def root(k: int) -> int:
        while label.get(k, k) != k:
            k = label[k]
        return k

    held = [[np.frombuffer(x, np.uint64) for x in side["set"]] for side in (a, b)]
    found: list[tuple[int, int]] = []
    for x, y, _ in pairs_within(a, b, tenths):
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        for part in np.split(np.arange(len(x)), np.flatnonzero(x[1:] != x[:-1]) + 1):
            k, others = int(x[part[0]]), y[part]
            own = held[0][k]
            lens = np.array([len(held[1][j]) for j in others.tolist()])
            every = np.concatenate([held[1][j] for j in others.tolist()])
            at = np.minimum(np.searchsorted(own, every), len(own) - 1)
            both = np.add.reduceat((own[at] == every).astype(np.int64), np.cumsum(lens) - lens)
            for j in others[10 * both >= tenths * (len(own) + lens - both)].tolist():
                p, q = root(int(a["root"][k])), root(int(b["root"][j]))
                if p != q:
                    label[max(p, q)] = min(p, q)
                    found.append((int(a["node"][k]), int(b["node"][j])))
    if found:
        pairs = np.array(found, np.int64)
        yield pairs[:, 0].copy(), pairs[:, 1].copy(), np.zeros(len(pairs), np.int64)


def compared(nodes: DataFrame, search, tenths: int) -> DataFrame:
    """(a, b, distance): what ``search`` finds in each pair of tiles. ``nodes``: node, root, size, f0 ... f3, and set for ``exact``."""
    sets = ["set"] if "set" in nodes.columns else []
    fields = [f"f{k}" for k in range(WORDS64)]
    own_class = F.floor(F.log("size") / F.lit(float(np.log(10 / tenths) + 1e-6))).cast("int")
    counts = nodes.groupBy(own_class.alias("c")).count().collect()  # a row for each class of sizes
    tiles = np.zeros(max([r["c"] for r in counts], default=0) + 2, np.int64)
    for r in counts:
        most = max(1, min(TILE, int(TILE_BYTES / (8 * (10 / tenths) ** (r["c"] + 1))))) if sets else TILE
        tiles[r["c"]] = max(-(-r["count"] // most), min(TILES, -(-r["count"] // SMALL_TILE)))
    wide = int(tiles.max())

    def emit(batches):
        import pyarrow as pa

        for batch in batches:
            for begin in range(0, batch.num_rows, 20_000):
                part = batch.slice(begin, 20_000)
                c = size_class(part.column("size").to_numpy(), tenths)
                tile = (mixed(part.column("node").to_numpy()) % tiles[c].astype(np.uint64)).astype(np.int64)

                def dealt(times, role, make):
                    at = np.repeat(np.arange(len(c)), times)
                    k = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                    key = make(at, k)
                    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), role, np.int8)), *(x.take(pa.array(at)) for x in part.columns)], ["key", "role", *part.schema.names])

                before = np.where(c > 0, tiles[np.maximum(c - 1, 0)], 0)
                number = lambda c, i, step, j: ((c * wide + i) * 2 + step) * wide + j
                yield dealt(tiles[c] - tile, 0, lambda at, k: number(c[at], tile[at], 0, tile[at] + k))
                yield dealt(tiles[c + 1], 0, lambda at, k: number(c[at], tile[at], 1, k))
                yield dealt(tile, 1, lambda at, k: number(c[at], k, 0, tile[at]))
                yield dealt(before, 1, lambda at, k: number(c[at] - 1, k, 1, tile[at]))

    def compare(batches):
        import pyarrow as pa

        def tasks(held):
            for at in np.split(np.arange(len(held["key"])), np.flatnonzero(held["key"][1:] != held["key"][:-1]) + 1):
                part = {k: v[at] for k, v in held.items()}
                a, b = ({k: v[part["role"] == role] for k, v in part.items()} for role in (0, 1))
                step, j = divmod(int(part["key"][0]) % (2 * wide), wide)
                if not step and j == int(part["key"][0]) // (2 * wide) % wide:
                    b = a
                if len(a["key"]) and len(b["key"]):
                    for found in search(a, b, tenths):
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), ["a", "b", "distance"])

        held = None
        for batch in batches:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "role", "node", "root", "size", *sets)}
            new["fp"] = np.stack([batch.column(c).to_numpy() for c in fields], axis=1).view(np.uint64)
            held = new if held is None else {k: np.concatenate([v, new[k]]) for k, v in held.items()}
            last = int(np.searchsorted(held["key"], held["key"][-1])) if len(held["key"]) else 0
            if last:
                yield from tasks({k: v[:last] for k, v in held.items()})
                held = {k: v[last:] for k, v in held.items()}
        if held is not None and len(held["key"]):
            yield from tasks(held)

    schema = ", ".join(["key long, role byte, node long, root long, size long", *(f"{c} long" for c in fields), *["set binary"] * len(sets)])
    dealt = nodes.select("node", "root", "size", *fields, *sets).mapInArrow(tidy(emit), schema)
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(compare), "a long, b long, distance long")


def verified(pairs: DataFrame, keys: DataFrame, docs: DataFrame, words: int, tenths: int) -> DataFrame:
    """(u, v): the pairs (a, b) of nodes that reach the similarity. ``keys``: node, key of a text that has the set."""

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, most=SMALL_SLICE_BYTES):
                (x, at_x), (y, at_y) = (shingle_sets(part.column(c).to_pylist(), words) for c in ("text", "other"))
                ends_x, ends_y = np.r_[at_x[1:], len(x)], np.r_[at_y[1:], len(y)]
                ok = []
                for p, q, r, s in zip(at_x.tolist(), ends_x.tolist(), at_y.tolist(), ends_y.tolist(), strict=True):
                    both = len(np.intersect1d(x[p:q], y[r:s], assume_unique=True))
                    ok.append(10 * both >= tenths * (q - p + s - r - both))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], ["u", "v"])

    pairs = materialise(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(keys, "node")
    wanted = materialise(wanted, "wanted")
    small = wanted.count() <= BROADCAST
    texts = docs.join(F.broadcast(wanted) if small else wanted, "key").groupBy("node").agg(F.any_value("text").alias("text"))
    # a node that many pairs name is dealt over several tasks; there are at most a thousand such nodes
    most, found = max(KEY_ROWS, pairs.count() // 1_000), pairs
    for side, name in (("a", "text"), ("b", "other")):
        heavy = pairs.groupBy(side).count().where(F.col("count") > most).select(F.col(side).alias("node"), F.ceil(F.col("count") / KEY_ROWS).cast("int").alias("salts"))
        side_texts = texts.join(F.broadcast(heavy), "node", "left").select(F.col("node").alias(side), F.col("text").alias(name), F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
        left = found.join(F.broadcast(heavy.withColumnRenamed("node", side)), side, "left")
        left = left.withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        found = left.join(side_texts, [side, "salt"]).drop("salt")
    return materialise(found.select("a", "b", "text", "other").mapInArrow(tidy(check), "u long, v long"), "links")


def shingles(docs: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """(node, set): the sorted shingle hashes of the text that ``keys`` (node, key) names."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, most=SMALL_SLICE_BYTES):
                found, starts = shingle_sets(part.column("text").to_pylist(), words)
                ends = np.r_[starts[1:], len(found)]
                sets = [found[p:q].tobytes() for p, q in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], ["node", "set"])

    wanted = materialise(keys, "wanted")
    texts = docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted, "key").select("node", "text")
    return texts.mapInArrow(tidy(run), "node long, set binary").groupBy("node").agg(F.any_value("set").alias("set"))


def near_links(docs: DataFrame, rows: DataFrame, words: int, tenths: int) -> DataFrame:
    """(u, v): links that join all similar nodes. ``docs``: key, text; ``rows``: what ``prints`` gives for them."""
    fields = [f"f{k}" for k in range(WORDS64)]
    nodes = rows.groupBy("node").agg(*(F.any_value(c).alias(c) for c in ("size", *fields)), F.min("key").alias("key"))
    nodes = materialise(nodes, "nodes")
    keys = nodes.select("node", "key")
    close = compared(nodes.withColumn("root", F.col("node")), nearest, tenths)
    close = close.groupBy("a").agg(F.min_by("b", F.struct("distance", "b")).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = verified(close, keys, docs, words, tenths)
    state = materialise(nodes.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node")), "state")
    left = materialise(compared(state, unsettled, tenths).select(F.col("a").alias("node")).distinct(), "unsettled")
    sets = shingles(docs, left.join(keys, "node"), words)
    rest = compared(materialise(state.join(sets, "node"), "sets"), exact, tenths)
    return found.union(materialise(rest.select(F.col("a").alias("u"), F.col("b").alias("v")), "links"))


def text_key(text: Column) -> Column:
    """What tells texts apart: 128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def grouped(df: DataFrame, id_col: str, text_col: str, words: int, tenths: int) -> tuple[DataFrame, DataFrame]:
    """(id, key, node of each row; node, root, least id of its component, of the linked nodes)."""
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary")).alias("text")).withColumn("key", text_key(F.col("text")))
    rows = materialise(prints(docs, words), "prints")
    numbers = materialise(rows.groupBy("wide").agg(F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "numbers")
    rows = materialise(uneven_join(rows, numbers, ["wide"]).drop("wide", "n"), "rows")
    roots = materialise(components(near_links(docs, rows, words, tenths)), "roots")
    least = rows.groupBy("node").agg(F.min("id").alias("least"))
    linked = materialise(roots.join(least, "node"), "linked")
    of_root = linked.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("null"), "least", "node")).alias("best"), F.count("*").alias("n"))
    linked = uneven_join(linked, of_root, ["root"]).select("node", F.col("best.least").alias("component_id"), F.col("best.node").alias("stays"))
    return rows, materialise(linked, "linked")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, tenths: int = 8) -> DataFrame:
    """(doc_id, component_id): one row for each row of ``df``; component_id is the smallest id reachable over links."""
    rows, linked = grouped(df, id_col, text_col, words, tenths)
    of_node = rows.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    found = of_node.join(linked, "node", "left").select("node", "n", F.coalesce("component_id", "least").alias("component_id"))
    return uneven_join(rows, found, ["node"]).select(F.col("id").alias(id_col), "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, tenths: int = 8) -> DataFrame:
    """``df`` with one row of each group of near copies, all columns: that with the smallest id (none counts as the largest).

    Rows are told apart by their text, not by their id. Of rows with the same set of shingles that have the smallest id of the
    group, one stays.
    """
    rows, linked = grouped(df, id_col, text_col, words, tenths)
    # of each set that stays, the text of the smallest id; all other texts go
    nodes = rows.groupBy("node").agg(F.min_by("key", F.struct(F.col("id").isNull(), "id", "key")).alias("stay"), F.count_distinct("key").alias("texts"), F.count("*").alias("n"))
    gone_nodes = linked.where("node <> stays").select("node")
    several = nodes.where("texts > 1").select("node", "stay")
    keys = rows.select("node", "key").distinct()
    gone = keys.join(gone_nodes, "node", "left_semi").select("key")
    gone = gone.union(keys.join(several, "node").where("key <> stay").select("key")).distinct()
    gone = materialise(gone, "gone")
    key = free_name(df, "key")
    keyed = df.withColumn(key, text_key(F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))))
    out = keyed.join(F.broadcast(gone.withColumnRenamed("key", key)) if gone.count() <= BROADCAST else gone.withColumnRenamed("key", key), key, "left_anti")
    repeated = rows.groupBy("key").count().where("count > 1").select(F.col("key").alias(key))
    repeated = materialise(repeated.join(gone.withColumnRenamed("key", key), key, "left_anti"), "repeated")
    if not repeated.isEmpty():
        few = repeated.count() <= BROADCAST
        chosen = F.broadcast(repeated) if few else repeated
        whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
        once = out.join(chosen, key, "left_semi").groupBy(key).agg(F.min_by(whole, F.struct(F.col(id_col).isNull(), F.col(id_col))).alias(free_name(df, "row")))
        return out.join(chosen, key, "left_anti").drop(key).unionByName(once.select(f"{free_name(df, 'row')}.*"))
    return out.drop(key)
