"""Hashes of words and of word shingles, computed over whole texts with numpy.

A word is a run of characters other than ASCII white space. A shingle is five words
in a row; a text of fewer words has one shingle of all its words, a text of none has
no shingle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

WORDS = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 20
_KEPT = 44
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
#: Factors of two independent hashes, each of words and of their runs.
FACTORS = (_BASE, 0xC2B2AE3D27D4EB4F)
_powers = {f: np.ones(1, np.uint64) for f in FACTORS}
_inverse = {f: np.ones(1, np.uint64) for f in FACTORS}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    made = x >> np.uint64(30)
    made ^= x
    made *= np.uint64(0xBF58476D1CE4E5B9)
    made ^= made >> np.uint64(27)
    made *= np.uint64(0x94D049BB133111EB)
    made ^= made >> np.uint64(31)
    return made


def _grow(size: int, factor: int) -> None:
    if len(_powers[factor]) < size:
        size = 1 << (size - 1).bit_length()
        steps = np.full(size, factor, np.uint64)
        steps[0] = 1
        _powers[factor] = np.cumprod(steps)
        steps[1:] = pow(factor, -1, 1 << 64)
        _inverse[factor] = np.cumprod(steps)


def _of_piece(raw: np.ndarray, factor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    _grow(raw.size + 1, factor)
    terms = raw.astype(np.uint64)
    terms += np.uint64(1)
    terms *= _powers[factor][: raw.size]
    sums = np.zeros(raw.size + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * _inverse[factor][starts])


def words(data: bytes, factor: int = _BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets of the starts and ends of all words, and a 64-bit hash of each."""
    if len(data) <= _PIECE:
        return _of_piece(np.frombuffer(data, np.uint8), factor)
    raw, found, at = np.frombuffer(data, np.uint8), [], 0
    while at < raw.size:  # pieces end at white space
        end = at + _PIECE
        while end < raw.size:
            gap = np.flatnonzero(_SPACE[raw[end : end + _PIECE]])
            if len(gap):
                end += int(gap[0])
                break
            end += _PIECE
        s, e, h = _of_piece(raw[at:end], factor)
        found.append((s + at, e + at, h))
        at = end
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def runs(hashes: np.ndarray, length: int, factor: int = _BASE) -> np.ndarray:
    """A hash of each run of so many words; other odd factors give independent ones."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, length):
        out *= np.uint64(factor)
        out += hashes[k : k + n]
    return mix(out)


def shingles(text: str, length: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    hashes = words(text.encode("utf-8", "replace"))[2]
    return np.unique(runs(hashes, min(length, len(hashes)) or 1))


class Laid(NamedTuple):
    """Texts laid out in a row, a blank between them, and the words of all of them."""

    data: bytes
    begins: np.ndarray  # of each text
    lengths: np.ndarray  # of each text, in bytes
    starts: np.ndarray  # of each word
    ends: np.ndarray
    hashes: np.ndarray
    owner: np.ndarray  # the number of its text


def laid_out(texts: list[str]) -> Iterator[Laid]:
    """The texts in groups of about a piece, laid out."""
    at = 0
    datas = [t.encode("utf-8", "replace") for t in texts]
    while at < len(datas):
        end, size = at, 0
        while end < len(datas) and (end == at or size + len(datas[end]) < _PIECE):
            size += len(datas[end]) + 1
            end += 1
        lengths = np.fromiter(map(len, datas[at:end]), np.int64, end - at)
        begins = np.cumsum(lengths + 1) - lengths - 1
        data = b" ".join(datas[at:end])
        starts, ends, hashes = words(data)
        yield Laid(data, begins, lengths, starts, ends, hashes, np.searchsorted(begins, starts, "right") - 1)
        at = end


def counted(texts: list[str], length: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of all texts: their hashes, how often each occurs in its text, and the number of distinct ones of each text.

    The texts are hashed in groups of about a piece. Of a hash the first 44 bits are kept, the
    others are 0.
    """
    return joined(counted_of(laid, length) for laid in laid_out(texts))


def joined(found: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``counted_of`` gives for several groups, as for one."""
    found = list(found)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def counted_of(laid: Laid, length: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``counted`` of the texts of one group."""
    n, hashes, text = len(laid.begins), laid.hashes, laid.owner
    count = np.bincount(text, minlength=n)
    grams = runs(hashes, length)
    inside = text[: len(grams)] == text[length - 1 :] if len(grams) else np.zeros(0, bool)
    grams, owner = grams[inside], text[: len(grams)][inside]
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < length))
    if len(short):  # texts of fewer words have one shingle of all of them
        grams = np.concatenate([grams, *(runs(hashes[first[i] : first[i] + count[i]], int(count[i])) for i in short)])
        owner = np.concatenate([owner, short])
    # one sort of one key: the text's number above the first 44 bits of the hash
    key = np.sort(owner.astype(np.uint64) << np.uint64(_KEPT) | grams >> np.uint64(64 - _KEPT))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    sizes = np.bincount((key[at] >> np.uint64(_KEPT)).astype(np.int64), minlength=n)
    return key[at] << np.uint64(64 - _KEPT), np.diff(np.append(at, len(key))), sizes


def numbered(hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A hash for each occurrence: the shingle's own for the first, others for the further ones.

    The Jaccard similarity of two such sets is the weighted one of the shingles with their counts.
    """
    if not len(times) or times.max() == 1:
        return hashes
    many = np.repeat(hashes, times)
    nth = (np.arange(len(many)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
    return np.where(nth == 0, many, mix(many + nth * np.uint64(0x9E3779B97F4A7C15)))
