"""Substring deduplication with automata of repeated phrases.

A window is WINDOW words in a row. Each word that lies in a window which a document with a smaller id has too is removed. Texts travel
in blocks of bounded size, and windows are narrowed down before any of them is compared:

1. Each window has an anchor, the ANCHOR-gram with the smallest hash inside it, which it shares with all windows equal to it.
   Blocks send their distinct anchors to hash partitions, which answer for each whether a second document has it.
2. Windows whose anchor recurs are confirmed in the same way with 96 bits, and the smallest document that has one owns it.
3. Owners hand out their recurring passages, in a row for each document, to the blocks that ask for them.
4. Each block compiles the windows of these passages that it may hold into Aho-Corasick automata, sharded by number of phrases, and
   streams all its documents through them, which locates every occurrence; what lies in one with a smaller owner goes.

A block sends each anchor or window once, so a passage that a third of all documents hold comes once from each block. What an owner
hands out is bounded by its document, and salted where many blocks ask for it.

Windows are judged on the input. A null text has no words. Rows that share an id are one document here: they don't remove from each other.
Documents with a null id keep all words and remove none. Texts of any length are read whole (a block holds one text at least);
repeated rows give repeated results; an empty table gives an empty result. Only the named columns are read. ``df`` must give the same rows in the
same order when a task is run again, as a scan of files does.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .backoff_lm import planes, unplanes
from .common import slices, tidy
from .tokens import NOT_SPACE, STEP, mix, word_hashes

WINDOW = 13
ANCHOR = 7
#: Bytes of text in a block, about; a block with a longer text is as large as that.
BLOCK_BYTES = 5_000_000
#: Most phrases of one automaton (about 110 MB).
PHRASES = 70_000
#: Blocks that get an owner's passages from one task, about.
SALT_BLOCKS = 256
STEP2 = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of an anchor's hash that travel beside the number of its partition; anchors are a filter, so a clash costs time only.
ANCHOR_BYTES = 5


def rolling(words: np.ndarray, n: int, step: np.uint64 = STEP) -> np.ndarray:
    """A hash of the ``n`` words from each word on, put together from those of 1, 2, 4, ... words."""
    size = max(0, len(words) - n + 1)
    out, length, power = None, 0, words
    for k in range(n.bit_length()):
        width = 1 << k
        if n & width:
            own = power[: len(power) if out is None else None]
            out = own if out is None else mix(out[: len(words) - length - width + 1] * step + own[length : length + len(words) - length - width + 1])
            length += width
        if n >> (k + 1):
            power = mix(power[: max(0, len(power) - width)] * step + power[width:])
    return out[:size]


class Block:
    """The documents of a block: texts, ids, word hashes, and the windows of documents with an id."""

    def __init__(self, data: bytes):
        import pyarrow as pa

        docs = pa.ipc.open_stream(data).read_all()
        ids = docs.column("id").combine_chunks()
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        self.texts = [x or b"" for x in docs.column("text").to_pylist()]
        self.words, self.text = word_hashes(self.texts, NOT_SPACE, lower=False)
        size = max(0, len(self.words) - WINDOW + 1)
        self.starts = np.flatnonzero((self.text[:size] == self.text[WINDOW - 1 :]) & self.known[self.text[:size]]) if size else np.zeros(0, np.int64)
        self.doc = self.ids[self.text[self.starts]]

    def anchors(self) -> np.ndarray:
        """The smallest hash of an ANCHOR-gram in each window."""
        grams = rolling(self.words, ANCHOR)
        size = max(0, len(self.words) - WINDOW + 1)
        best = grams[:size].copy()
        for k in range(1, WINDOW - ANCHOR + 1):
            np.minimum(best, grams[k : k + size], out=best)
        return best[self.starts]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each window, 96 bits."""
        return self.first(), self.second(np.arange(len(self.starts)))

    def first(self) -> np.ndarray:
        return rolling(self.words, WINDOW)[self.starts]

    def second(self, windows: np.ndarray) -> np.ndarray:
        return (rolling(self.words, WINDOW, STEP2) >> np.uint64(32)).astype(np.uint32)[self.starts[windows]]


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts by the keys, the first most important; where each run of equal keys begins in it)."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        own = key[order]
        new[1:] |= own[1:] != own[:-1]
    return order, np.flatnonzero(new)


def spread(values: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """Each run's value, for every place of the run."""
    return np.repeat(values, np.diff(np.r_[begins, size]))


def distinct_anchors(block: Block, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct anchors by partition, their partitions, if two documents have each, index of each window's anchor among them)."""
    found = block.anchors()
    order = np.argsort(found)
    held = found[order]
    begins = np.flatnonzero(np.r_[True, held[1:] != held[:-1]][: len(held)])
    keys = held[begins]
    part = (keys % np.uint64(parts)).astype(np.int64)
    by = np.argsort(part, kind="stable")  # only distinct anchors are put in order of partitions
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    at = np.empty(len(order), np.int64)
    at[order] = spread(place, begins, len(order))
    doc = block.doc[order]
    many = np.minimum.reduceat(doc, begins) != np.maximum.reduceat(doc, begins) if len(begins) else np.zeros(0, bool)
    return keys[by], part[by], many[by], at


def met(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the values that are among the sorted ``keys``, where the first such key stands); most others go by 22 of their bits."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, bits = np.zeros(1 << 22, bool), np.uint64((1 << 22) - 1)
    held[keys & bits] = True
    places = np.flatnonzero(held[values & bits])
    at = np.minimum(np.searchsorted(keys, values[places]), len(keys) - 1)
    fits = keys[at] == values[places]
    return places[fits], at[fits]


def ipc(ids, texts) -> bytes:
    import pyarrow as pa

    table = pa.record_batch([ids, texts], ["id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def found_windows(block: Block, rows: list[dict]) -> np.ndarray:
    """Index of each window's row among the confirmed ones (sorted by both hashes), or their number where it has none."""
    first, second = (np.concatenate([np.zeros(0, t), *(unplanes(r[c], t) for r in rows)]) for c, t in (("a", np.uint64), ("b", np.uint32)))
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    h1 = block.first()
    out = np.full(len(h1), len(first))
    if len(first) and len(h1):
        places, at = met(first, h1)
        h1, h2 = h1[places], block.second(places)
        same = np.diff(np.r_[np.flatnonzero(np.r_[True, first[1:] != first[:-1]]), len(first)]).max()
        for k in range(int(same)):  # one, but for a clash of the first hash
            here = np.minimum(at + k, len(first) - 1)
            fits = (first[here] == h1) & (second[here] == h2)
            out[places[fits]] = order[here[fits]]
    return out


def needed(block: Block, passages: list[bytes]) -> tuple[list[tuple[int, list[bytes]]], np.ndarray]:
    """([(index of the passage, its words)] of each part of a passage whose windows all have a hash that a window of the block has; where such
    windows of the block start)."""
    words, text = word_hashes(passages, NOT_SPACE, lower=False)
    hashes = rolling(words, WINDOW)
    none: tuple = [], np.zeros(0, np.int64)
    if not len(hashes) or not len(block.starts):
        return none
    keys, back = np.unique(hashes, return_inverse=True)
    places, at = met(keys, block.first())
    wanted = np.zeros(len(keys), bool)
    wanted[at] = True
    starts = np.flatnonzero((text[: len(hashes)] == text[WINDOW - 1 :]) & wanted[back])
    if not len(starts):
        return none
    offsets, last, split, out = np.searchsorted(text, np.arange(len(passages))), -1, [], []
    cuts = np.flatnonzero(np.r_[True, (np.diff(starts) != 1) | (np.diff(text[starts]) != 0), True])
    for a, b in zip(cuts, cuts[1:], strict=False):
        k = int(text[starts[a]])
        if k != last:
            last, split = k, passages[k].split(b" ")
        out.append((k, split[starts[a] - offsets[k] : starts[b - 1] - offsets[k] + WINDOW]))
    return out, block.starts[places]


def symbols(numbers: list[int], base: int) -> str:
    """Two characters for each number below base squared, of different ranges: no match begins inside a word, and nodes have few children."""
    high, low = np.divmod(np.array(numbers, np.int64), base)
    return np.stack([high, low + base], axis=1).reshape(-1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def automata(parts: list[tuple[int, list[int]]], base: int):
    """(automaton, owner of each phrase) for shards of PHRASES windows of the parts (owner, numbers of words) of passages."""
    import ahocorasick

    machine, owners = ahocorasick.Automaton(ahocorasick.STORE_INTS), []
    for owner, numbers in parts:
        text = symbols(numbers, base)
        for p in range(len(numbers) - WINDOW + 1):
            machine.add_word(text[2 * p : 2 * (p + WINDOW)], len(owners))
            owners.append(owner)
            if len(owners) == PHRASES:
                machine.make_automaton()
                yield machine, np.array(owners)
                machine, owners = ahocorasick.Automaton(ahocorasick.STORE_INTS), []
    if owners:
        machine.make_automaton()
        yield machine, np.array(owners)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, n_removed, kept): one row for each row of ``df``; kept are the words that stay, joined by single spaces."""
    import pyarrow as pa

    source = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts = max(1, -(-size // block_bytes))

    def deal(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in slices(batch, most=block_bytes):
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ipc(piece.column("id"), piece.column("text"))], pa.binary())], ["block", "docs"])
                number += 1

    blocks = source.mapInArrow(tidy(deal), "block long, docs binary")

    def open_(table) -> tuple[int, Block]:
        return table.column("block")[0].as_py(), Block(table.column("docs")[0].as_py())

    def rows(columns: dict, found: list[tuple]):
        values = list(zip(*found, strict=True)) or [()] * len(columns)
        return pa.table({c: pa.array(x, t) for (c, t), x in zip(columns.items(), values, strict=True)})

    def send_anchors(table):
        number, block = open_(table)
        keys, part, many, _ = distinct_anchors(block, parts)
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else []
        out = [(int(part[a]), number, planes(keys[a:b] >> np.uint64(24))[: ANCHOR_BYTES * (b - a)], np.packbits(many[a:b]).tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
        return rows({"part": pa.int64(), "block": pa.int64(), "a": pa.binary(), "b": pa.binary()}, out)

    def count_anchors(table):
        sent = table.to_pylist()
        keys = [unplanes(r["a"] + bytes(len(r["a"]) // ANCHOR_BYTES * (8 - ANCHOR_BYTES)), np.uint64) for r in sent]
        many = np.concatenate([np.unpackbits(np.frombuffer(r["b"], np.uint8), count=len(k)) for r, k in zip(sent, keys, strict=True)])
        _, back = np.unique(np.concatenate(keys), return_inverse=True)
        recurs = (np.bincount(back) + np.bincount(back, many) > 1)[back]
        own = np.split(recurs, np.cumsum([len(k) for k in keys])[:-1])
        out = [(r["block"], r["part"], np.packbits(x).tobytes()) for r, x in zip(sent, own, strict=True) if x.any()]
        return rows({"block": pa.int64(), "part": pa.int64(), "a": pa.binary()}, out)

    def send_windows(left, right):
        number, block = open_(left)
        keys, part, _, at = distinct_anchors(block, parts)
        recurs = np.zeros(len(keys), bool)
        for r in right.to_pylist():
            a, b = np.searchsorted(part, [r["part"], r["part"] + 1])
            recurs[a:b] = np.unpackbits(np.frombuffer(r["a"], np.uint8), count=b - a)
        chosen = np.flatnonzero(recurs[at])
        h1, h2 = (x[chosen] for x in block.hashes())
        doc, part = block.doc[chosen], (h1 % np.uint64(parts)).astype(np.int64)
        order, begins = runs(part, h1, h2)
        if not len(begins):
            return rows({"part": pa.int64(), "block": pa.int64(), **dict.fromkeys("abcd", pa.binary())}, [])
        least = np.minimum.reduceat(doc[order], begins)
        many = least != np.maximum.reduceat(doc[order], begins)
        h1, h2, part = (x[order[begins]] for x in (h1, h2, part))
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        out = [(int(part[a]), number, planes(h1[a:b]), planes(h2[a:b]), planes(least[a:b]), np.packbits(many[a:b]).tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
        return rows({"part": pa.int64(), "block": pa.int64(), **dict.fromkeys("abcd", pa.binary())}, out)

    def confirm(table):
        sent = table.to_pylist()
        h1, h2, doc = (np.concatenate([unplanes(r[c], t) for r in sent]) for c, t in (("a", np.uint64), ("b", np.uint32), ("c", np.int64)))
        sizes = [len(r["b"]) // 4 for r in sent]
        many = np.concatenate([np.unpackbits(np.frombuffer(r["d"], np.uint8), count=n) for r, n in zip(sent, sizes, strict=True)])
        order, begins = runs(h1, h2)
        least, most = np.minimum.reduceat(doc[order], begins), np.maximum.reduceat(doc[order], begins)
        recurs = (least != most) | (np.add.reduceat(many[order].astype(np.int64), begins) > 0)
        owner, asking, again = np.empty(len(order), np.int64), np.empty(len(order), np.int64), np.empty(len(order), bool)
        for target, values in ((owner, least), (asking, np.diff(np.r_[begins, len(order)])), (again, recurs)):
            target[order] = spread(values, begins, len(order))
        out = []
        for r, k in zip(sent, np.split(np.arange(len(order)), np.cumsum(sizes)[:-1]), strict=True):
            k = k[again[k]]
            if len(k):
                out.append((r["block"], planes(h1[k]), planes(h2[k]), planes(owner[k]), planes(asking[k])))
        return rows({"block": pa.int64(), **dict.fromkeys("abcd", pa.binary())}, out)

    def ask(left, right):
        number, block = open_(left)
        confirmed = right.to_pylist()
        owner, asking = (np.concatenate([np.zeros(0, np.int64), *(unplanes(r[c], np.int64) for r in confirmed)]) for c in "cd")
        at = found_windows(block, confirmed)
        own = np.flatnonzero(at < len(owner))
        at = at[own]
        salts = -(-asking // SALT_BLOCKS)
        out = []
        # passages: the first place of each window that a document owns itself
        mine = own[owner[at] == block.doc[own]]
        at_mine = at[owner[at] == block.doc[own]]
        mine, at_mine = (x[np.sort(np.unique(at_mine, return_index=True)[1])] for x in (mine, at_mine))
        begin = block.starts[mine]
        offsets = np.searchsorted(block.text, np.arange(len(block.texts)))
        last, words = -1, []
        parts_of: dict[int, tuple[list[bytes], int]] = {}
        cuts = np.flatnonzero(np.r_[True, np.diff(begin) != 1, True] | np.r_[True, np.diff(block.text[begin]) != 0, True]) if len(begin) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            k = int(block.text[begin[a]])
            if k != last:
                last, words = k, block.texts[k].split()
            held, most = parts_of.get(int(block.ids[k]), ([], 1))
            held.append(b" ".join(words[begin[a] - offsets[k] : begin[b - 1] - offsets[k] + WINDOW]))
            parts_of[int(block.ids[k])] = held, max(most, int(salts[at_mine[a:b]].max()))
        for doc, (held, most) in parts_of.items():
            out += [(doc, salt, None, b"\n".join(held)) for salt in range(most)]
        theirs = own[owner[at] < block.doc[own]]
        at = at[owner[at] < block.doc[own]]
        wanted, first = np.unique(owner[at], return_index=True)
        for doc, k in zip(wanted.tolist(), at[first].tolist(), strict=True):
            out.append((doc, number % int(salts[k]), number, None))
        return rows({"owner": pa.int64(), "salt": pa.int64(), "block": pa.int64(), "passages": pa.binary()}, out)

    def hand_out(batches):
        now, held = None, []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["owner"], r["salt"]) != now:
                    now, held = (r["owner"], r["salt"]), []
                if r["block"] is None:
                    if r["passages"] not in held:
                        held.append(r["passages"])
                else:
                    out.append((r["block"], r["owner"], b"\n".join(held)))
                if sum(len(x[2]) for x in out) > block_bytes:
                    yield rows({"block": pa.int64(), "owner": pa.int64(), "passages": pa.binary()}, out).to_batches()[0]
                    out = []
            if out:
                yield rows({"block": pa.int64(), "owner": pa.int64(), "passages": pa.binary()}, out).to_batches()[0]

    def locate(left, right):
        _, block = open_(left)
        passages = [(owner, x) for owner, held in zip(right.column("owner").to_pylist(), right.column("passages").to_pylist(), strict=True) for x in held.split(b"\n")]
        numbers: dict[bytes, int] = {}  # from 1; 0 is any word that no passage has
        held, starts = needed(block, [x for _, x in passages])
        parts = [(passages[k][0], [numbers.setdefault(w, len(numbers) + 1) for w in words]) for k, words in held]
        base = math.isqrt(len(numbers)) + 1
        sizes = np.bincount(block.text, minlength=len(block.texts))
        words = [text.split() for text in block.texts]
        covered = np.zeros(len(block.words) + 1, np.int64)
        if parts:
            # only runs of words that lie in windows with the hash of some phrase are looked at
            edge = np.zeros(len(block.words) + 2, np.int64)
            edge[starts + 1] += 1
            edge[starts + 1 + WINDOW] -= 1
            breaks = np.flatnonzero(np.diff(np.cumsum(edge) > 0))
            runs_ = list(zip(breaks[::2].tolist(), breaks[1::2].tolist(), strict=True))
            flat = list(chain.from_iterable(words))
            known = np.array([numbers.get(w, 0) for a, b in runs_ for w in flat[a:b]], np.int64)
            stream = symbols(known, base)
            before = np.cumsum([0, *(b - a for a, b in runs_)]).tolist()
            for machine, owners in automata(parts, base):
                found = np.array([x for (a, b), c in zip(runs_, before, strict=False) for end, phrase in machine.iter(stream[2 * c : 2 * (c + b - a)]) for x in (a + end // 2, phrase)], np.int64).reshape(-1, 2)
                end, owner = found[:, 0], owners[found[:, 1]]
                text = block.text[end]
                hit = block.known[text] & (block.text[end - WINDOW + 1] == text) & (owner < block.ids[text])
                np.add.at(covered, end[hit] - WINDOW + 1, 1)
                np.add.at(covered, end[hit] + 1, -1)
        stays = np.cumsum(covered[:-1]) == 0
        ends = np.cumsum(sizes)
        kept = []
        for own, a, b in zip(words, (ends - sizes).tolist(), ends.tolist(), strict=True):
            stay = stays[a:b]
            kept.append(b" ".join(own if stay.all() else [own[k] for k in np.flatnonzero(stay).tolist()]))
        removed = sizes - np.bincount(block.text, stays, len(block.texts)).astype(np.int64)
        ids = pa.array(block.ids, pa.int64(), mask=~block.known)
        return pa.table({"id": ids, "n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary())})

    by_block = blocks.groupBy("block")
    sent = by_block.applyInArrow(send_anchors, "part long, block long, a binary, b binary")
    recurring = sent.groupBy("part").applyInArrow(count_anchors, "block long, part long, a binary")
    sent = by_block.cogroup(recurring.groupBy("block")).applyInArrow(send_windows, "part long, block long, a binary, b binary, c binary, d binary")
    confirmed = sent.groupBy("part").applyInArrow(confirm, "block long, a binary, b binary, c binary, d binary")
    asked = by_block.cogroup(confirmed.groupBy("block")).applyInArrow(ask, "owner long, salt long, block long, passages binary")
    dealt = asked.repartition("owner", "salt").sortWithinPartitions("owner", "salt", F.col("block").asc_nulls_first())
    handed = dealt.mapInArrow(tidy(hand_out), "block long, owner long, passages binary")
    found = by_block.cogroup(handed.groupBy("block")).applyInArrow(locate, "id long, n_words long, n_removed long, kept binary")
    return found.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))


def repeats_sql() -> str:
    """DuckDB SQL over ``documents``, comparing all windows as texts."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
w AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT r, doc_id, n, w, i, string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS t FROM w),
m AS (SELECT r, i, w, i <= n - {WINDOW - 1} AND min(doc_id) OVER (PARTITION BY t, i <= n - {WINDOW - 1}) < doc_id AS bad FROM g),
c AS (SELECT r, i, w, coalesce(bool_or(bad) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), false) AS gone FROM m),
f AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN f USING (r)"""
