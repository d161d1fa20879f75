"""Word shingles of text batches as 64-bit hashes, computed on whole arrays of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import slices, utf8

SIZE = 5
RUN = 1 << 20
#: Keeps the first k of a block's 8 bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of rows that lie joined in data, and how many each row has.

    A word is a maximal run of digits, letters (A-Z as a-z) and bytes from 0x80 on; equal words have equal hashes, and
    every byte counts however long the word is.
    """
    low = _LOWER[data]
    is_word = _WORD[low]
    edge = np.zeros(len(data) + 1, bool)  # a word ends where its row does
    edge[bounds] = True
    begin = np.flatnonzero(is_word & ~(np.concatenate([[False], is_word[:-1]]) & ~edge[:-1]))
    end = np.flatnonzero(is_word & ~(np.concatenate([is_word[1:], [False]]) & ~edge[1:])) + 1
    size = end - begin
    out = np.zeros(len(begin), np.uint64)
    # Blocks of 8 bytes of all words at once, each mixed with the whole state so far; words that are through drop out.
    # No byte of a word is 0, so the last block's padding tells no two words alike.
    ahead = np.ndarray(len(low), "<u8", np.append(low, np.zeros(8, np.uint8)), strides=(1,))
    todo = np.arange(len(begin))
    k = 0
    while len(todo):
        block = ahead[begin[todo] + k] & _FIRST[np.minimum(size[todo] - k, 8)]
        out[todo] = mix64(out[todo] ^ block)
        k += 8
        todo = todo[size[todo] > k]
    out = mix64(out + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    count = np.diff(np.searchsorted(begin, bounds))
    return out, count


def shingle_hashes(words: np.ndarray, count: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `size` words of each row (a row of fewer words, but not none, is one run), and their counts."""
    n = np.where(count > 0, np.maximum(1, count - size + 1), 0)
    total = int(n.sum())
    row = np.repeat(np.arange(len(count)), n)
    first = np.cumsum(count) - count
    at = first[row] + np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    end = (first + count)[row]
    out = np.zeros(total, np.uint64)
    for j in range(size):
        inside = at + j < end
        w = words[np.minimum(at + j, max(0, len(words) - 1))] if total else words
        out = np.where(inside, mix64(out ^ w) + np.uint64(j + 1), out)
    return mix64(out), n


def shingle_sets(column: pa.Array, size: int = SIZE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows [a, b): the sorted distinct shingles of each row, joined, and their counts."""
    data, bounds = utf8(column)
    for a, b in slices(bounds, RUN):
        words, count = word_hashes(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        sh, n = shingle_hashes(words, count, size)
        row = np.repeat(np.arange(b - a), n)
        order = np.lexsort((sh, row))
        sh, row = sh[order], row[order]
        new = np.ones(len(sh), bool)
        new[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
        yield a, b, sh[new], np.bincount(row[new], minlength=b - a)
