"""SentencePiece encoding and decoding (BPE with byte fallback) in vectorised merge rounds.

All words of a slice lie in one flat numpy array of symbols. A round finds each word's best-ranked pair with a segmented
minimum, joins its leftmost occurrences in all words at once, and compacts the array, until no word has a pair left.

Null and empty texts give the begin and end ids alone; a text of any length is encoded whole, in memory that grows with it. Any
other column is untouched, and an added column gets underscores in front where an input column has its name; repeated rows give
repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_SLICE_BYTES, free_name, slices, tidy

SPACE = "▁"
NO_PAIR = np.int32(2**31 - 1)
#: Characters of the words kept with their ids in a worker; the store is emptied when full, and longer words are not kept.
CACHE_CHARACTERS, CACHED_WORD = 2_000_000, 64
#: Segments of more symbols than this keep the minimum of their rounds in two levels, over blocks of so many.
LONG_RUN, BLOCK = 2_048, 512
WORD = re.compile(r" *[^ ]+| +")


def proto_fields(raw: bytes):
    """(field number, value) pairs of a serialised protocol buffer."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, raw[at : at + n]
            at += n


class PairTable:
    """Open-addressing hash table from a pair of int32 to an int32, looked up for whole arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, (4 * max(1, len(pairs)) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        left = np.array([p[0] for p in pairs], np.int64)
        right = np.array([p[1] for p in pairs], np.int64)
        keys = self.key(left, right)
        slots = self.slot(keys)
        self.probes = 1
        for k, s, v in zip(keys.tolist(), slots.tolist(), pairs.values(), strict=True):
            n = 1
            while self.keys[s] != -1:
                s = (s + 1) & int(self.mask)
                n += 1
            self.keys[s], self.values[s] = k, v
            self.probes = max(self.probes, n)

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return ((left.astype(np.int64) & 0x7FFFFFFF) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = self.key(left, right)
        slots = self.slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], np.int32(-1))
        todo = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            slots[todo] = (slots[todo] + 1) & self.mask
            found = self.keys[slots[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slots[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


class PieceModel:
    """Vocabulary, ranks and pair table of a SentencePiece BPE model with identity normalisation and byte fallback."""

    def __init__(self, proto: bytes):
        import sentencepiece

        spec = {n: dict(proto_fields(v)) for n, v in proto_fields(proto) if n in (2, 3)}
        trainer, normaliser = spec[2], spec[3]
        if trainer.get(3) != 2 or not trainer.get(35) or normaliser.get(1) != b"identity" or normaliser.get(3, 1) != 1 or normaliser.get(4, 1) or not trainer.get(22, 1):
            raise ValueError("the model must be BPE with byte fallback, identity normalisation, a dummy prefix and kept white space")
        lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = lib.get_piece_size()
        if any(lib.is_unused(i) for i in range(size)):
            raise ValueError("models with unused pieces aren't supported")
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        pieces = [lib.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        scores = np.array([lib.get_score(i) for i in range(size)])
        ids = {pieces[i]: i for i in normal}
        # rank 0 is merged first; equal scores share a rank
        self.rank = np.full(size + 1, NO_PAIR, np.int32)
        self.rank[normal] = np.unique(-scores[normal], return_inverse=True)[1]
        times = np.bincount(self.rank[normal])
        self.first = np.arange(0x110000, dtype=np.int32)
        self.first = -self.first - 2  # a character without a piece is -(code point) - 2
        for piece, i in ids.items():
            if len(piece) == 1:
                self.first[ord(piece)] = i

        def part(text: str) -> int | None:
            return ids.get(text, -ord(text) - 2 if len(text) == 1 else None)

        pairs, touching = {}, {}
        self.alone = np.zeros(size + 1, bool)  # merging this piece never makes room for a pair of the same or a better rank
        self.alone[normal] = times[self.rank[normal]] == 1
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                touching[ord(piece[k - 1]), ord(piece[k])] = 1
                left, right = part(piece[:k]), part(piece[k:])
                if left is not None and right is not None:
                    pairs[left, right] = i
                    for x in (left, right):
                        if x >= 0 and self.rank[x] >= self.rank[i]:
                            self.alone[x] = False
        self.pairs, self.touching = PairTable(pairs), PairTable(touching)
        self.byte_id = np.zeros(256, np.int32)
        plain = []
        for i, piece in enumerate(pieces):
            if lib.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                plain.append(bytes([int(piece[3:5], 16)]))
            else:
                plain.append(b"" if lib.is_control(i) else b" \xe2\x81\x87 " if lib.is_unknown(i) else piece.replace(SPACE, " ").encode())
        self.plain = np.frombuffer(b"".join(plain), np.uint8)
        self.plain_len = np.array([len(x) for x in plain], np.int64)
        self.plain_at = np.cumsum(self.plain_len) - self.plain_len
        self.spaced = np.array([x.startswith(SPACE) for x in pieces])
        self.silent = np.array([lib.is_control(i) for i in range(size)])
        self.store: dict[str, bytes] = {}
        self.stored = 0

    # -- encoding -----------------------------------------------------------------------------------------------------

    def merge_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        points = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        symbols = self.first[points]
        # a new segment begins at each word, and where no piece holds the two characters side by side
        fresh = np.ones(len(points), bool)
        fresh[1:] = (word[1:] != word[:-1]) | (self.touching.get(points[:-1], points[1:]) < 0)
        segment = np.cumsum(fresh) - 1
        symbols, word = self.rounds(symbols, segment, word)
        unknown = symbols < 0
        if unknown.any():
            points = np.where(unknown, -symbols.astype(np.int64) - 2, 0)
            wide = np.select([points < 0x80, points < 0x800, points < 0x10000], [1, 2, 3], 4)
            at = np.cumsum(wide) - wide
            out = np.repeat(symbols, wide)
            one = unknown & (wide == 1)
            out[at[one]] = self.byte_id[points[one]]
            for k in np.flatnonzero(unknown & (wide > 1)).tolist():
                out[at[k] : at[k] + wide[k]] = self.byte_id[list(chr(points[k]).encode())]
            symbols, word = out, np.repeat(word, wide)
        data = symbols.astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word, minlength=len(words))) * 4
        return [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def rounds(self, symbols: np.ndarray, segment: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge until no segment has a pair left; gives the symbols in order and the word of each."""
        order = np.arange(len(symbols))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        long = np.flatnonzero(np.bincount(segment) > LONG_RUN)
        if len(long):
            apart = np.isin(segment, long)
            for k in long.tolist():
                own = np.flatnonzero(segment == k)
                kept, merged = self.merge_long(symbols[own])
                done.append((order[own[kept]], merged, word[own[kept]]))
            symbols, segment, word, order = (x[~apart] for x in (symbols, segment, word, order))

        def joined(at: np.ndarray) -> np.ndarray:
            out = np.full(len(at), -1, np.int32)
            inside = at + 1 < len(symbols)
            inside[inside] = segment[at[inside]] == segment[at[inside] + 1]
            out[inside] = self.pairs.get(symbols[at[inside]], symbols[at[inside] + 1])
            return out

        into = joined(np.arange(len(symbols)))
        while len(symbols):
            rank = self.rank[into]  # of -1: NO_PAIR
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            sizes = np.diff(np.r_[starts, len(segment)])
            best = np.minimum.reduceat(rank, starts)
            over = best == NO_PAIR
            if over.any():
                gone = np.repeat(over, sizes)
                done.append((order[gone], symbols[gone], word[gone]))
                live = ~gone
                symbols, segment, word, order, into, rank = (x[live] for x in (symbols, segment, word, order, into, rank))
                if not len(symbols):
                    break
                best, sizes = best[~over], sizes[~over]
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            lead = np.r_[True, segment[at[1:]] != segment[at[:-1]]]
            # of neighbouring occurrences, which overlap, every second one
            run = np.r_[True, (at[1:] != at[:-1] + 1) | lead[1:]]
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            even = (np.arange(len(at)) - first) % 2 == 0
            at = at[lead | (even & self.alone[into[at]])]
            symbols[at] = into[at]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            at = (np.cumsum(stays) - 1)[at]
            symbols, segment, word, order, into = (x[stays] for x in (symbols, segment, word, order, into))
            again = np.union1d(at, at[at > 0] - 1)
            into[again] = joined(again)
        if not done:
            return symbols, word
        order, symbols, word = (np.concatenate(x) for x in zip(*done, strict=True))
        by = np.argsort(order, kind="stable")
        return symbols[by], word[by]

    def merge_long(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rounds of one long segment: places that stay and their symbols.

        Where merging a piece may make room for a better one, a round can merge a single place, so here the minimum is kept in
        two levels, over blocks and within them, and places are linked instead of compacted: such a round costs a block.
        """
        n, symbols = len(symbols), symbols.copy()
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        into = np.full(-(-n // BLOCK) * BLOCK, -1, np.int32)
        into[: n - 1] = self.pairs.get(symbols[:-1], symbols[1:])
        rank = self.rank[into]
        best = rank.reshape(-1, BLOCK).min(axis=1)
        while True:
            block = int(best.argmin())
            if best[block] == NO_PAIR:
                break
            first = block * BLOCK + int(rank[block * BLOCK : (block + 1) * BLOCK].argmin())
            if self.alone[into[first]]:
                at = np.flatnonzero(rank == best[block])
                run = np.r_[True, at[1:] != after[at[:-1]]]
                start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            else:
                at = np.array([first])
            gone = after[at]
            symbols[at] = into[at]
            alive[gone], into[gone], rank[gone] = False, -1, NO_PAIR
            after[at] = after[gone]
            next_ = after[at]
            before[next_[next_ < n]] = at[next_ < n]
            again = np.unique(np.concatenate([at, before[at]]))
            again = again[again >= 0]
            right = after[again]
            inside = right < n
            into[again] = -1
            into[again[inside]] = self.pairs.get(symbols[again[inside]], symbols[right[inside]])
            rank[again] = self.rank[into[again]]
            touched = np.unique(np.concatenate([again, gone]) // BLOCK)
            best[touched] = rank.reshape(-1, BLOCK)[touched].min(axis=1)
        kept = np.flatnonzero(alive)
        return kept, symbols[kept]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit integers."""
        split = [WORD.findall(f" {t}".replace(SPACE, " ")) if t else [] for t in texts]
        if self.stored > CACHE_CHARACTERS:
            self.store.clear()
            self.stored = 0
        missing = list({w for words in split for w in words if w not in self.store})
        store = self.store
        store.update(zip(missing, self.merge_words(missing), strict=True))
        head, tail = (np.array([x], "<u4").tobytes() for x in (self.begin, self.end))
        out = [head + b"".join([store[w] for w in words]) + tail for words in split]
        for w in missing:
            if len(w) > CACHED_WORD:
                del store[w]
            else:
                self.stored += len(w)
        return out

    # -- decoding -----------------------------------------------------------------------------------------------------

    def decode(self, data: bytes) -> str:
        """The text of ids given as little-endian unsigned 32-bit integers."""
        ids = np.frombuffer(data, "<u4")
        sizes = self.plain_len[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        plain = self.plain[np.arange(total) + np.repeat(self.plain_at[ids] - (ends - sizes), sizes)].tobytes()
        loud = np.flatnonzero(~self.silent[ids])
        if len(loud) and self.spaced[ids[loud[0]]]:
            plain = plain[1:]
        try:
            return plain.decode()
        except UnicodeDecodeError:
            return "".join(characters(plain))


def characters(data: bytes):
    """The characters of ``data``, each byte that belongs to none as U+FFFD."""
    at = 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                yield data[at : at + n].decode()
            except UnicodeDecodeError:
                continue
            at += n
            break
        else:
            yield "�"
            at += 1


@lru_cache(maxsize=2)
def loaded(proto: bytes) -> PieceModel:
    return PieceModel(proto)


def read_model(path: str) -> bytes:
    """The serialised model, read on the driver; executors get the bytes."""
    with open(path, "rb") as f:
        return f.read()


def encode_decode(df: DataFrame, model: bytes, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """``keep`` columns of ``df`` plus n_tokens, ids (array<int>, if ``with_ids``), ids_sha256 and decoded_sha256.

    The ids are exactly the library's, with begin and end; decoding starts again from the ids.
    """
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    text = free_name(df.select(*keep), "text")
    source = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias(text))
    fields = [f for f in source.schema.fields if f.name != text]
    names = [f.name for f in fields]
    added = [free_name(df.select(*keep), c) for c in ("n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256")]
    types = ["long", *["array<int>"] * with_ids, "string", "string"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"`{c}` {t}" for c, t in zip(added, types, strict=True))])

    def run(batches):
        import pyarrow as pa

        own = loaded(model)
        for batch in batches:
            for part in slices(batch, text, SMALL_SLICE_BYTES):
                data = own.encode(part.column(text).to_pylist())
                columns = [part.column(c) for c in names] + [pa.array([len(x) // 4 for x in data], pa.int64())]
                if with_ids:
                    ends = np.cumsum([len(x) // 4 for x in data])
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(np.frombuffer(b"".join(data), "<i4"))))
                columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in data]))
                columns.append(pa.array([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in data]))
                yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    return source.mapInArrow(tidy(run), schema)
