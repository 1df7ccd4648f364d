"""Word n-grams of many texts at once, as 64-bit hashes in numpy arrays.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text with A-Z lower-cased. A
word's hash is a polynomial over its bytes, found for all words of a block by one running sum; an
n-gram's hash mixes its words' hashes by position. Two different n-grams share a hash with
probability near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U64 = np.uint64
_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MARKS = np.zeros(256, bool)
_MARKS[:128] = [not chr(c).isalnum() for c in range(128)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x632BE59BD9B4E019))
_PLACE = mix(np.arange(1, 65, dtype=U64) * U64(0xD1B54A32D192ED03)) | U64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_FORTH, _BACK = _powers(_BASE, _BLOCK + 1), _powers(_INVERSE, _BLOCK + 1)


def _pieces(buf: np.ndarray, between: np.ndarray) -> Iterator[tuple[int, int]]:
    """``buf`` in pieces of about a block that begin and end at a word boundary; a word longer than
    a block makes a longer piece."""
    spaces = None
    i = 0
    while i < len(buf):
        end = min(i + _BLOCK, len(buf))
        if end < len(buf):
            if spaces is None:
                spaces = np.flatnonzero(between[buf])
            k = int(np.searchsorted(spaces, end)) - 1
            if k >= 0 and spaces[k] > i:
                end = int(spaces[k])
            else:
                end = int(spaces[k + 1]) if k + 1 < len(spaces) else len(buf)
        yield i, end
        i = end


def _spans(block: np.ndarray, between: np.ndarray):
    """Starts and ends of the words of a piece, and what hashes its byte ranges (starts, ends)."""
    forth, back = _FORTH, _BACK
    if len(block) > _BLOCK:  # one word longer than a block
        forth, back = _powers(_BASE, len(block) + 1), _powers(_INVERSE, len(block) + 1)
    word = ~between[block]
    edges = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    sums = np.zeros(len(block) + 1, U64)
    np.cumsum(_BYTE[block] * forth[: len(block)], out=sums[1:])

    def hashed(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U64))

    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), hashed


def words(texts: Iterable[str | None], plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words of each text); a null text has none. With ``plain`` every ASCII
    character other than a letter or digit stands between words."""
    between = _MARKS if plain else _SPACE
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    buf = np.frombuffer(b"\n".join(parts).lower(), np.uint8)
    firsts = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))[:-1]
    found, at = [], []
    for i, end in _pieces(buf, between):
        starts, ends, hashed = _spans(buf[i:end], between)
        at.append(starts + i)
        found.append(hashed(starts, ends))
    if not found:
        return np.zeros(0, U64), np.zeros(len(parts), np.int64)
    at = np.concatenate(at)
    bounds = np.searchsorted(at, np.append(firsts, len(buf) + 1))
    return np.concatenate(found), np.diff(bounds)


def ngrams(hashes: np.ndarray, counts: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word within the text, hash) of every run of ``n`` words. With ``short`` a text
    of fewer words, but some, has its whole sequence as its one n-gram."""
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    sizes = np.maximum(counts - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), sizes)
    place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = first[text] + place
    value = np.full(len(at), n, U64)
    for k in range(n):
        value += mix(hashes[at + k] * _PLACE[k])
    if short:
        few = np.flatnonzero((counts > 0) & (counts < n))
        extra = np.array(counts[few], U64)
        for k in range(n - 1):
            has = counts[few] > k
            extra[has] += mix(hashes[first[few][has] + k] * _PLACE[k])
        text, place, value = np.concatenate((text, few)), np.concatenate((place, np.zeros(len(few), place.dtype))), np.concatenate((value, extra))
    return text, place, mix(value)


def distinct(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, value) pairs, in order."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def slices(sizes: Iterable[int], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items of at most ``most`` in sum, or one item."""
    start = total = 0
    i = -1
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if i >= start:
        yield start, i + 1


def stems(texts: Iterable[str | None], lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word and of its first bytes in each of ``lengths`` that it has."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    found, owner = [], []
    for i, body in enumerate(parts):
        buf = np.frombuffer(body.lower(), np.uint8)
        for lo, hi in _pieces(buf, _SPACE):
            starts, ends, hashed = _spans(buf[lo:hi], _SPACE)
            for length in (None, *lengths):
                a, b = starts, ends
                if length is not None:
                    a = starts[ends - starts >= length]
                    b = a + length
                found.append(hashed(a, b))
                owner.append(np.full(len(a), i))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(owner), np.concatenate(found)
