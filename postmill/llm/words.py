"""Vectorised word splitting and 64-bit hashing over Arrow string columns.

Texts are read as UTF-8 bytes straight from the Arrow buffers, so a batch of documents
is split, lower-cased (A-Z only) and hashed by a handful of numpy passes with no Python
work per word. Equal words have equal hashes in every process; different words share one
with a chance of about 2**-64 for each pair, which the callers accept as identity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes handled at once; whole documents only, so a longer document is a chunk of its own.
CHUNK = 1 << 21


def _mixed(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return fmix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def fmix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of a well-known public hash: a bijection that spreads all bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(33))
        x = x * U64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> U64(33))
        x = x * U64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U64(33))


#: A random value for each byte and odd multipliers for each place in a window.
BYTE = _mixed(256, 11)
PLACE = _mixed(64, 29) | U64(1)
_BASE = U64(0x5851F42D4C957F2D)
_powers = np.ones(1, dtype=U64)

SPACES = b" \t\n\x0b\x0c\r"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
#: Words are runs of anything but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[list(SPACES)] = False
#: Words are runs of digits, a-z and anything beyond ASCII (after lower-casing).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Lines: runs of anything but the line feed; empty lines never count anywhere.
NOT_NEWLINE = np.ones(256, dtype=bool)
NOT_NEWLINE[10] = False


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            p = np.full(max(n, 2 * len(_powers)), _BASE, dtype=U64)
            p[0] = 1
            _powers = np.cumprod(p, dtype=U64)
    return _powers


@dataclass
class Words:
    """Words of consecutive documents: ``at[i]:at[i+1]`` are those of document i."""

    hashes: np.ndarray
    at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.counts)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n+1 offsets into them; nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK):
    """Ranges of documents of about ``limit`` bytes, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def _split(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray, word: np.ndarray) -> Words:
    low = fold[data]
    is_word = word[low]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(is_word)
    before[:1] = False
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.empty_like(is_word)
    after[-1:] = False
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    at = np.searchsorted(starts, offsets).astype(np.int64)
    if not len(starts):
        return Words(np.zeros(0, U64), at, starts, ends)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        value = BYTE[low[is_word]] * _power(int(lengths.max()))[place]
        hashes = fmix(np.add.reduceat(value, first) + lengths.astype(U64) * PLACE[0])
    return Words(hashes, at, starts, ends)


def split(col: pa.Array, word: np.ndarray = NOT_SPACE, lower: bool = True) -> Words:
    """Words of every text; ``starts`` and ``ends`` are byte offsets into ``utf8(col)``."""
    data, offsets = utf8(col)
    fold, parts, base = (LOWER if lower else SAME), [], 0
    for i, j in chunks(offsets):
        lo = offsets[i]
        w = _split(data[lo : offsets[j]], offsets[i : j + 1] - lo, fold, word)
        parts.append(Words(w.hashes, w.at + base, w.starts + lo, w.ends + lo))
        base += len(w.hashes)
    if not parts:
        return Words(np.zeros(0, U64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    at = np.concatenate([p.at[:-1] for p in parts] + [parts[-1].at[-1:]])
    return Words(np.concatenate([p.hashes for p in parts]), at, np.concatenate([p.starts for p in parts]), np.concatenate([p.ends for p in parts]))


def word_hash(text: str, word: np.ndarray = NOT_SPACE) -> np.ndarray:
    """Hashes of the words of one text, in order."""
    return split(pa.array([text], pa.large_string()), word).hashes


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of n words and the word index where it starts; none crosses a document."""
    total = len(w.hashes)
    if total < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    left = np.repeat(w.at[1:], w.counts) - np.arange(total)
    start = np.flatnonzero(left >= n)
    with np.errstate(over="ignore"):
        h = np.zeros(len(start), dtype=U64)
        for k in range(n):
            h += w.hashes[start + k] * PLACE[k + 1]
    return fmix(h), start


def per_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of flags[at[i]:at[i+1]]."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
