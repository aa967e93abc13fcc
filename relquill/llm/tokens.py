"""Words of many texts at once: boundaries and 64-bit hashes in numpy, without a Python object for each word."""

from __future__ import annotations

import numpy as np

_random = np.random.default_rng(20_240_101)
BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A word's bytes: all but ASCII white space; or letters, digits and all of other alphabets.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """STEP to the powers 0 to n - 1, modulo 2^64."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * STEP ** np.uint64(len(_powers))])
    return _powers[:n]


def word_hashes(texts: list[bytes], kind: np.ndarray = NOT_SPACE, prefix: int = 0, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, in lower-case ASCII unless not ``lower``, or of its first ``prefix`` bytes; index of its text), in order."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = kind[buffer]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
    starts = at[first]
    offset = at - np.repeat(starts, np.diff(np.r_[first, len(at)]))
    values = BYTE[LOWER[buffer[at]] if lower else buffer[at]] * powers(int(offset.max()) + 1)[offset]
    if prefix:
        values[offset >= prefix] = 0
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return mix(np.add.reduceat(values, first)), np.searchsorted(ends, starts, side="right")


def gram_hashes(words: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each n-gram of words, index of the word it ends with); no n-gram spans two texts."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = words[: len(words) - n + 1]
    for k in range(1, n):
        out = mix(out * STEP + words[k : len(words) - n + 1 + k])
    own = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :])
    return out[own] if n > 1 else out, own + n - 1


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes of each text's n-word shingles, sorted within the text; where each text's begin).

    A text of fewer words has one shingle, all of its words; a text without words has one, which is that of every such text.
    """
    words, text = word_hashes(texts, NOT_SPACE)
    sizes = np.bincount(text, minlength=len(texts))
    found, ends = gram_hashes(words, text, n)
    parts, owners = [found], [text[ends]]
    for k in range(n):  # shorter texts
        few = np.flatnonzero(sizes == k)
        if not len(few):
            continue
        if k:
            found, ends = gram_hashes(*((x[np.isin(text, few)]) for x in (words, text)), k)
            parts.append(mix(found + np.uint64(k)))
            owners.append(text[np.isin(text, few)][ends])
        else:
            parts.append(np.zeros(len(few), np.uint64))
            owners.append(few)
    found, text = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    first = np.r_[True, (found[1:] != found[:-1]) | (text[1:] != text[:-1])][: len(found)]
    return found[first], np.searchsorted(text[first], np.arange(len(texts)))
