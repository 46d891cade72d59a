"""Words of whole texts as 64-bit numbers, for many texts of an Arrow batch at once.

Used inside Spark tasks (mapInArrow). A word is a maximal run of word bytes; its
number is a keyed polynomial hash of its lower-cased (A-Z only) bytes. UTF-8 bytes
above 0x7F are word bytes in every pattern used here, so working on bytes equals
working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 20  # bytes of text handled at once; only a single text or word may make a chunk longer

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
STEP = U(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP**i and its inverse modulo 2**64 for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + 1)
        inverse = U(pow(int(STEP), -1, 2**64))
        for name, base in (("up", STEP), ("down", inverse)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Words(NamedTuple):
    number: np.ndarray   # uint64, one per word
    first: np.ndarray    # for each text, its first word; one more entry at the end
    start: np.ndarray    # byte offset of each word in the buffer
    end: np.ndarray


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its texts; null has no bytes."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    data = column.buffers()[2] if len(column) else None
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets.astype(np.int64)


def text_groups(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` bytes together, or one longer text.

    After the last range, memory that Arrow holds without need goes back, since a
    worker lives on beside the others of its executor.
    """
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j
    pa.default_memory_pool().release_unused()


def stretches(data: np.ndarray, begin: int, end: int, is_word: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Cuts one long text into ranges of about ``limit`` bytes that end where no word goes on; a longer word stays whole."""
    while begin < end:
        stop = min(end, begin + limit)
        while stop < end:
            part = is_word[LOWER[data[stop : min(end, stop + 4096)]]]
            outside = np.flatnonzero(~part)
            if len(outside):
                stop += int(outside[0])
                break
            stop += len(part)
        yield begin, stop
        begin = stop


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """The words of the texts data[offsets[i]:offsets[i+1]]."""
    numbers, starts, ends = [], [], []
    lo, stop = int(offsets[0]), int(offsets[-1])
    at = 0
    while lo < stop:
        hi = min(stop, lo + CHUNK)
        while hi < stop:  # a piece ends where a text ends or at a byte that is in no word
            nxt = hi + int(np.argmin(is_word[LOWER[data[hi : hi + 4096]]]))
            edge = int(offsets[np.searchsorted(offsets, hi)])
            if not is_word[LOWER[data[nxt]]] or edge <= hi + 4096:
                hi = min(edge, nxt) if not is_word[LOWER[data[nxt]]] else edge
                break
            hi = min(stop, hi + 4096)
        b = LOWER[data[lo:hi]]
        m = is_word[b]
        at = int(np.searchsorted(offsets, lo))
        cuts = offsets[at : int(np.searchsorted(offsets, hi))] - lo
        before = np.zeros(len(m) + 1, dtype=bool)
        before[1:] = m
        before[cuts] = False
        start = np.flatnonzero(m & ~before[:-1])
        after = np.zeros(len(m) + 1, dtype=bool)
        after[:-1] = m
        after[cuts] = False
        end = np.flatnonzero(m & ~after[1:]) + 1
        up, down = powers(len(b) + 1)
        total = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(BYTE[b] * up[: len(b)], out=total[1:])
        numbers.append(mix((total[end] - total[start]) * down[start]))
        starts.append(start + lo)
        ends.append(end + lo)
        lo = hi
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    number = np.concatenate(numbers) if numbers else np.zeros(0, np.uint64)
    return Words(number, np.searchsorted(start, offsets), start, end)


SHIFTS = [U(int(x) * 2 + 1) for x in _rng.integers(1, 2**62, 64)]


def shingles(number: np.ndarray, size: int) -> np.ndarray:
    """A number for every ``size`` words in a row; position i stands for words i to i+size-1."""
    n = len(number) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = number[:n] * SHIFTS[0]
    for k in range(1, size):
        total += mix(number[k : k + n] ^ SHIFTS[k])
    return mix(total)
