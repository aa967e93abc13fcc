"""The prefix trie of conversations, from a global sort of their turn arrays.

A turn is told by 128 bits of the SHA-256 of its role and text. Turn arrays are range-sorted over all partitions, so conversations
that share a prefix stand side by side; where a conversation departs from the one before it, at their longest common prefix (LCP), the
nodes below that depth close and its own open. A stack sweep of each partition turns these LCP intervals into nodes. What is open
where a partition begins or ends is left as fragments, two for each depth at most; the driver stitches those, whose number depends on
partitions and turns of single conversations only, and the lists of members that end there are hashed as a stream in the order of partitions.

Turns are ordered by turn (null first), then role, then text. A null role or text is empty, and repeated rows are turns of their own. Rows
without a conv_id belong to no conversation and make no node. Conversations without turns end at the root; an empty table gives an
empty result. Texts and conversations of any length count whole; the digests of one conversation (40 bytes a turn) are held at once.
Only the named columns are read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, tidy

#: Turns of a partition of the sorted arrays, about; there are TASKS partitions at least where there are as many conversations.
TURNS, TASKS = 250_000, 16
DIGEST = 16
#: A conversation takes the first turns of the one whose id is the multiple of FAMILY before it, up to HEADS - 1 of them.
FAMILY, HEADS = 5, 9
FIELDS = {
    "part": "int", "place": "int", "parent": "int", "depth": "int", "conv_id": "long", "parent_conv_id": "long", "n_convs": "long", "n_children": "long", "n_leaves": "long", "saved_tokens": "long",
    "size": "long", "from_left": "boolean", "to_right": "boolean", "turn": "binary", "ends": "binary",
}
EMPTY = hashlib.sha256().hexdigest()


def turns(df: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, size) of each turn of ``df`` (conv_id, turn, role, text), positions from 1."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * DIGEST))
    own = df.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    return own.withColumn("pos", place).select("conv_id", "pos", digest.alias("digest"), F.octet_length("text").cast("long").alias("size"))


def heads(conv_id: Column) -> Column:
    """How many turns a conversation takes from its family's first."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<digest, size>>): each conversation with its family's first turns in place of its own first ones."""
    ids = own.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"))
    donors = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "first")
    taken = ids.join(donors, "first").where(F.col("pos") <= heads(F.col("conv_id"))).select("conv_id", F.lit(0).alias("part"), "pos", "digest", "size")
    kept = own.where(F.col("pos") > heads(F.col("conv_id"))).select("conv_id", F.lit(1).alias("part"), "pos", "digest", "size")
    marks = ids.select("conv_id", F.lit(2).alias("part"), F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("size"))
    arrays = taken.unionByName(kept).unionByName(marks).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "pos", "digest", "size"))).alias("turns"))
    found = F.filter("turns", lambda t: t["part"] < 2)
    return arrays.select("conv_id", F.transform(found, lambda t: t["digest"]).alias("turns"), F.transform(found, lambda t: t["size"]).alias("sizes"))


class Open:
    """A node whose interval is still open; ``left``: it may begin before the partition."""

    __slots__ = ("depth", "place", "parent", "size", "turn", "left", "conv", "n", "children", "leaves", "saved", "ends", "inner")

    def __init__(self, depth: int, place: int, parent: int | None, size: int, turn: bytes, left: bool):
        self.depth, self.place, self.parent, self.size, self.turn, self.left = depth, place, parent, size, turn, left
        self.conv, self.n, self.children, self.leaves, self.saved, self.ends, self.inner = None, 0, 0, 0, 0, bytearray(), []


class Sweep:
    """The stack sweep of one partition. ``rows`` holds what is done (FIELDS): nodes, and fragments of nodes that may go on beyond it."""

    def __init__(self, part: int):
        self.part, self.stack, self.before, self.made, self.rows = part, [], None, 0, []

    def push(self, size: int, turn: bytes) -> None:
        self.stack.append(Open(len(self.stack), self.made, self.stack[-1].place if self.stack else None, size, turn, self.before is None))
        self.made += 1

    def feed(self, conv: int, digests: list[bytes], sizes: list[int]) -> None:
        common = 0
        if self.before is None:
            self.push(0, b"")
        else:
            most = min(len(self.before), len(digests))
            while common < most and self.before[common] == digests[common]:
                common += 1
        while len(self.stack) > common + 1:
            self.close(False)
        for digest, size in zip(digests[common:], sizes[common:], strict=True):
            self.push(size, digest)
        top = self.stack[-1]
        top.ends += (b"," if top.ends else b"") + str(conv).encode()
        top.n += 1
        top.conv = conv if top.conv is None else min(top.conv, conv)
        self.before = digests

    def close(self, right: bool) -> None:
        """Close the top; ``right``: it may go on after the partition. The members count for the node above; so does the subtree, but for fragments."""
        node = self.stack.pop()
        above = self.stack[-1] if self.stack else None
        fragment = node.left or right
        row = [self.part, node.place, node.parent, node.depth, node.conv, None, node.n, node.children, node.leaves, node.saved, node.size, node.left, right, node.turn, bytes(node.ends)]
        if not fragment:
            row[8], row[9] = node.leaves or 1, node.saved + (node.n - 1) * node.size
            row[13:] = None, hashlib.sha256(node.ends).hexdigest().encode()
            above.children += 1
            above.leaves += row[8]
            above.saved += row[9]
        if above is not None:
            above.n += node.n
            above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
        for child in node.inner:  # they know their parent's id now, but not that of a fragment
            if not fragment:
                child[5] = node.conv
        self.rows += node.inner
        if fragment or above.left:
            self.rows.append(row)
        else:
            above.inner.append(row)

    def finish(self) -> None:
        while self.stack:
            self.close(True)


def swept(arrays: DataFrame) -> DataFrame:
    """Nodes and fragments (FIELDS) of (conv_id, turns, sizes), range-sorted; a node's ends are its digest, a fragment's the ids."""
    size = arrays.agg(F.count("*"), F.coalesce(F.sum(F.size("turns")), F.lit(0))).first()
    parts = max(1, min(TASKS, size[0]), -(-(size[0] + size[1]) // TURNS))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
        sweep = Sweep(TaskContext.get().partitionId())

        def out():
            found, sweep.rows = sweep.rows, []
            for at in range(0, len(found), 10_000):
                columns = zip(*found[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, t in zip(columns, FIELDS.values(), strict=True)], list(FIELDS))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turns", "sizes")), strict=True):
                sweep.feed(*row)
            yield from out()
        sweep.finish()
        yield from out()

    ordered = arrays.repartitionByRange(parts, "turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    return ordered.mapInArrow(tidy(run), ", ".join(f"{c} {t}" for c, t in FIELDS.items()))


def stitch(fragments: list) -> tuple[list[tuple], list[tuple]]:
    """((number, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) of each stitched node, (part, place, number, conv_id) of each fragment)."""
    nodes: list[dict] = []
    member: dict[tuple[int, int], int] = {}
    open_: list[int] = []  # nodes by depth that reach beyond the partition before
    by_part: dict[int, list] = {}
    for f in sorted(fragments, key=lambda f: (f["part"], f["depth"], not f["from_left"])):
        by_part.setdefault(f["part"], []).append(f)
    for own in by_part.values():
        left = [f for f in own if f["from_left"]]
        common = 0 if open_ else -1
        while 0 <= common < min(len(left), len(open_)) - 1 and nodes[open_[common + 1]]["turn"] == left[common + 1]["turn"]:
            common += 1
        for f in own:  # by depth, so parents come first
            if f["from_left"] and f["depth"] <= common:
                number = open_[f["depth"]]
            else:
                number = len(nodes)
                parent = None if f["parent"] is None else member[f["part"], f["parent"]]
                nodes.append({"depth": f["depth"], "parent": parent, "turn": f["turn"], "size": f["size"], "conv": f["conv_id"], "n": 0, "children": 0, "leaves": 0, "saved": 0})
            member[f["part"], f["place"]] = number
            node = nodes[number]
            node["conv"] = min(node["conv"], f["conv_id"])
            for key, c in (("n", "n_convs"), ("children", "n_children"), ("leaves", "n_leaves"), ("saved", "saved_tokens")):
                node[key] += f[c]
        open_ = [member[f["part"], f["place"]] for f in own if f["to_right"]]
    for node in reversed(nodes):  # children before parents
        node["leaves"] = node["leaves"] or 1
        node["saved"] += (node["n"] - 1) * node["size"]
        if node["parent"] is not None:
            above = nodes[node["parent"]]
            above["children"] += 1
            above["leaves"] += node["leaves"]
            above["saved"] += node["saved"]
    made = [(k, x["conv"], x["depth"], None if x["parent"] is None else nodes[x["parent"]]["conv"], x["n"], x["children"], x["leaves"], x["saved"]) for k, x in enumerate(nodes)]
    return made, [(part, place, k, nodes[k]["conv"]) for (part, place), k in member.items()]


def streamed_hashes(batches):
    """SHA-256 of each node's lists of ids, joined by commas in the order of partitions; rows come sorted by node and partition."""
    import pyarrow as pa

    now, state = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([state.hexdigest()])], ["number", "ends_sha256"])

    for batch in batches:
        for number, ends in zip(batch.column("number").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if number == now:
                state.update(b"," + ends)
                continue
            if now is not None:
                yield row()
            now, state = number, hashlib.sha256(ends)
    if now is not None:
        yield row()


def prefix_trie(df: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): one row for each node of the trie of rebuilt conversations."""
    return trie(rebuilt(materialise(turns(df), "turns")))


def trie(arrays: DataFrame) -> DataFrame:
    """The nodes over (conv_id, turns, sizes): arrays of turn digests, and of what each turn counts for saved_tokens."""
    spark = arrays.sparkSession
    found = materialise(swept(materialise(arrays, "arrays")), "swept")
    fragments = found.where("from_left OR to_right")
    made, member = stitch(fragments.drop("ends").collect())  # two for each partition and depth
    places = spark.createDataFrame(member, "part int, place int, number int, at long")
    ends = fragments.where(F.octet_length("ends") > 0).select("part", "place", "ends").join(F.broadcast(places), ["part", "place"]).select("number", "part", "ends")
    ends = ends.repartition("number").sortWithinPartitions("number", "part").select("number", "ends").mapInArrow(tidy(streamed_hashes), "number int, ends_sha256 string")
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    top = spark.createDataFrame(made, "number int, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    top = top.join(ends, "number", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    inner = found.where("NOT (from_left OR to_right)").withColumn("ends_sha256", F.col("ends").cast("string"))
    above = places.select("part", F.col("place").alias("parent"), "at")
    inner = inner.join(F.broadcast(above), ["part", "parent"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "at"))
    return inner.select(*names).union(top.select(*names)).withColumn("depth", F.col("depth").cast("long"))


def trie_sql() -> str:
    """DuckDB SQL over ``conversations``, with all prefixes as lists."""
    crc = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda u, v: xor(u >> 1, (u & 1) * 3988292384))"
    code = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: {crc}), 4294967295)"
    return f"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS turn
  FROM conversations WHERE conv_id IS NOT NULL),
i AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % {FAMILY} AS first, {code} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM o)),
a AS (SELECT i.conv_id, 0 AS part, o.pos, o.turn FROM i JOIN o ON o.conv_id = i.first AND o.pos <= i.h UNION ALL SELECT i.conv_id, 1, o.pos, o.turn FROM i JOIN o ON o.conv_id = i.conv_id AND o.pos > i.h),
s AS (SELECT i.conv_id, coalesce(l, []) AS l FROM i LEFT JOIN (SELECT conv_id, list(turn ORDER BY part, pos) AS l FROM a GROUP BY conv_id) USING (conv_id)),
p AS (SELECT conv_id, len(l) AS n, d, l[1:d] AS key FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM s)),
n AS MATERIALIZED (SELECT row_number() OVER () AS node, key, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM p GROUP BY key, d),
e AS (SELECT n.node, n.key, n.depth, n.conv_id, n.n_convs, n.ends, u.conv_id AS parent_conv_id, u.node AS parent FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.key = n.key[1:n.depth - 1]),
c AS (SELECT parent AS node, count(*) AS n_children FROM e WHERE parent IS NOT NULL GROUP BY parent),
f AS (SELECT e.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(key[depth].t) END AS own FROM e LEFT JOIN c USING (node)),
b AS (SELECT key[1:d] AS key, d AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved FROM (SELECT key, n_children, own, unnest(range(0, depth + 1)) AS d FROM f) GROUP BY 1, 2)
SELECT conv_id, f.depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM f JOIN b ON b.depth = f.depth AND b.key = f.key"""
