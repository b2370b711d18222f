"""Words of many texts at once: NumPy passes over the bytes of an Arrow string column.

Texts lie end to end in one buffer with their offsets, as Arrow keeps them. A table gives each byte its classes; words are runs of bytes that
are no separator, and never cross from one text to the next. Words are told apart by a 64-bit hash, and words of equal hash are
compared byte by byte.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes after the last text, so that eight bytes can be read from any place.
PAD = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


class Words(NamedTuple):
    """Where words begin, and their sizes in bytes."""

    start: np.ndarray
    size: np.ndarray


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, padded, and its n + 1 offsets; a null is empty."""
    c = pc.cast(pc.fill_null(column, ""), pa.large_binary())
    offsets = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1] if len(c) else np.zeros(1, np.int64)
    raw = c.buffers()[2]
    data = np.zeros(int(offsets[-1] - offsets[0]) + PAD, np.uint8)
    if raw is not None:
        data[:-PAD] = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def class_table(**members: bytes) -> np.ndarray:
    """A table of byte classes: bit k of a byte's entry says whether it is in the k-th class."""
    table = np.zeros(256, np.uint8)
    for k, m in enumerate(members.values()):
        table[list(m)] |= 1 << k
    return table


def prefix_sums(flags: np.ndarray) -> np.ndarray:
    """0, then how many flags are set up to each place."""
    out = np.zeros(len(flags) + 1, np.int32 if len(flags) < 1 << 31 else np.int64)
    np.cumsum(flags, dtype=out.dtype, out=out[1:])
    return out


def find_words(apart: np.ndarray, offsets: np.ndarray) -> Words:
    """Words between the bytes that are set in `apart`; texts' ends part words too."""
    edge = np.zeros(len(apart) + 1, bool)
    edge[offsets] = True
    inner = ~apart
    first, last = inner.copy(), inner.copy()
    first[1:] &= apart[:-1] | edge[1:-1]
    last[:-1] &= apart[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return Words(start, np.flatnonzero(last) + 1 - start)


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray((len(data) - PAD + 1,), "<u8", np.ascontiguousarray(data), strides=(1,))


def mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A hash carried on by a number."""
    h = (h ^ x) * _ODD
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hash(data: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every batch."""
    at = _eight(data)
    h = mixed(words.size.astype(np.uint64), at[words.start] & _MASKS[np.minimum(words.size, 8)])
    live, k = np.flatnonzero(words.size > 8), 8
    while len(live):
        left = words.size[live] - k
        h[live] = mixed(h[live], at[words.start[live] + k] & _MASKS[np.minimum(left, 8)])
        live, k = live[left > 8], k + 8
    return h


def same_words(data: np.ndarray, words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Are words a[i] and b[i] equal, byte by byte?"""
    at, size = _eight(data), words.size[a]
    same = size == words.size[b]
    live, k = np.flatnonzero(same), 0
    while len(live):
        m = _MASKS[np.minimum(size[live] - k, 8)]
        ok = (at[words.start[a[live]] + k] & m) == (at[words.start[b[live]] + k] & m)
        same[live[~ok]] = False
        live, k = live[ok & (size[live] > k + 8)], k + 8
    return same


def distinct_within(data: np.ndarray, words: Words, group: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words in groups (numbers below 2^20): the places of one word of each kind in each group, and every word's number among these.

    Words are sorted by group and hash; neighbours of equal key are verified, and groups where two words share a key
    are told apart by the words themselves.
    """
    key = (group.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(order), bool)
    new[1:] = k[1:] != k[:-1]
    again = np.flatnonzero(~new)
    same = same_words(data, words, order[again], order[again - 1])
    number = np.empty(len(order), np.int64)
    if not same.all():
        return _distinct_by_bytes(data, words, group)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _distinct_by_bytes(data: np.ndarray, words: Words, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw, seen, first, number = data.tobytes(), {}, [], np.empty(len(group), np.int64)
    for k, (g, s, n) in enumerate(zip(group.tolist(), words.start.tolist(), words.size.tolist(), strict=True)):
        at = seen.setdefault((g, raw[s : s + n]), len(first))
        if at == len(first):
            first.append(k)
        number[k] = at
    return np.array(first, np.int64), number
