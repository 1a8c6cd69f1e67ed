"""NumPy helpers that the operators on whole texts share: mixing, grouping, folding texts to words."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18


def mix(x: np.ndarray, k: int) -> np.ndarray:
    x = x * np.uint64(k)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def give_back() -> None:
    """Return freed memory of this process to the system: Spark keeps idle Python workers, whose memory would add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in the GNU C library
    if trim is not None:
        trim(0)


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] numbers), start[1], ... in one array."""
    n = n.astype(np.int64)
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def split_by(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[o[0]]), o) for o in np.split(order, cuts) if len(o)]


_WS = np.ones(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


#: Bytes of plain words: digits, letters and everything from 0x80 on.
PLAIN = np.zeros(256, bool)
PLAIN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


#: Numbers of a letter at one of the first _DEEP places of a word.
_DEEP = 64
_LETTERS = mix((np.arange(_DEEP * 256, dtype=np.uint64) & ~np.uint64(255) | np.tile(_LOWER, _DEEP).astype(np.uint64)) + np.uint64(1), 0xE7037ED1A0B428DB)


def _placed(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The number of each byte at its place in its word. Every (place, byte) has a mixed number of its own."""
    near = place < _DEEP
    out = _LETTERS[np.where(near, place << 8 | x, 0)]
    if not near.all():
        far = np.flatnonzero(~near)
        out[far] = mix((place[far].astype(np.uint64) << np.uint64(8) | _LOWER[x[far]].astype(np.uint64)) + np.uint64(1), 0xE7037ED1A0B428DB)
    return out


def word_hashes(x: np.ndarray, starts: np.ndarray, letters: np.ndarray = _WS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (runs of `letters`, by default all but white space) of documents laid end to end,
    and the first word of each document.

    Words are the same number wherever they stand; x is worked on in chunks that end between words, a longer word in pieces.
    """
    n = len(x)
    inside = letters[x]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    before = np.r_[False, inside[:-1]] if n else inside
    first = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.r_[inside[1:], False] if n else inside
    stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
    out = np.empty(len(first), np.uint64)
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(stop, first[i] + CHUNK, "right")))
        a, b = int(first[i]), int(stop[j - 1])
        if b - a > CHUNK:
            total = np.uint64(0)
            for c in range(a, b, CHUNK):
                part = x[c : min(b, c + CHUNK)]
                total = np.add(total, _placed(part, np.arange(c - a, c - a + len(part))).sum(dtype=np.uint64), dtype=np.uint64)
            out[i] = total
        else:
            place = np.arange(b - a) - np.repeat(first[i:j] - a, np.diff(np.r_[first[i:j], b]))
            numbers = _placed(x[a:b], place)
            numbers[~inside[a:b]] = 0
            out[i:j] = np.add.reduceat(numbers, first[i:j] - a)
        i = j
    return mix(out + (stop - first).astype(np.uint64), 0x8EBC6AF09C88C6E3), np.searchsorted(first, starts)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles; a text of fewer words is one shingle, of none an empty set."""
    x = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum([0] + [len(t) for t in texts])
    w, at = word_hashes(x, starts)
    keys = [np.uint64(k | 1) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB)]
    full = np.zeros(max(0, len(w) - width + 1), np.uint64)
    for k in range(width):
        full += w[k : k + len(full)] * keys[k % 8] * np.uint64(2 * (k // 8) + 1)
    full = mix(full, 0xD6E8FEB86659FD93)
    out = []
    for d in range(len(texts)):
        a, b = at[d], at[d + 1]
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            short = (w[a:b] * np.array([keys[k % 8] for k in range(b - a)])).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + np.array([b - a], np.uint64), 0xA0761D6478BD642F))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
