"""Words and hashed word shingles of whole texts, vectorised over Arrow batches.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return, after
lower-casing A to Z; on UTF-8 this is what ``bytes.lower().split()`` does. Hashes are 64 bits wide and depend on nothing
but the bytes, so every executor and every rerun agrees.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = 0x9E3779B97F4A7C15
#: Bytes of text handled at once inside a task; bounds the memory of the hash arrays (about 60 bytes per byte).
PIECE = 1 << 20
#: Powers that stay in memory between tasks.
KEPT = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_GOLD) + np.uint64(salt))


_BYTE = seeds(256, 17)
_ODD = int(seeds(1, 99)[0]) | 1
_INVERSE = pow(_ODD, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def settled(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, after which the task's memory goes back to the system: Python workers outlive their
    tasks, and what they still hold is missing to the next stage."""
    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            settle()

    return wrapped


def settle() -> None:
    for k in (0, 1):
        if len(_powers[k]) > KEPT:
            _powers[k] = _powers[k][:KEPT].copy()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


_handled = 0


def settle_after(size: int) -> None:
    """``settle`` once for every ``PIECE`` bytes of text that a worker has handled: a collection takes tens of milliseconds,
    more than a small group."""
    global _handled
    _handled += size
    if _handled >= PIECE:
        _handled = 0
        settle()


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_ODD, _INVERSE)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and where each text's words begin and end (one entry more than texts).

    A word's hash is a polynomial over its bytes, taken as a difference of running sums, so no word becomes a Python
    object.
    """
    joined = b"\n".join([*texts, b""])
    if not joined:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    raw = np.frombuffer(joined, dtype=np.uint8)
    upper = (raw >= 65) & (raw <= 90)
    raw = raw + (upper * np.uint8(32)).astype(np.uint8)
    space = _SPACE[raw]
    before = np.concatenate(([True], space[:-1]))
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    power, inverse = _power_tables(len(raw))
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[raw] * power[: len(raw)], dtype=np.uint64)))
        h = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(_GOLD))
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
    return h, np.searchsorted(starts, at)


def shingle_hashes(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles per text and their bounds; a text of 1 to k-1 words gives one, of all its words."""
    n = np.diff(bounds)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_bounds = np.concatenate(([0], np.cumsum(counts)))
    with np.errstate(over="ignore"):
        acc = mix(h + np.uint64(_GOLD))
        keep = max(len(h) - k + 1, 0)
        full = acc[:keep]
        for j in range(1, k):
            full = mix(full * np.uint64(_GOLD | 1) + h[j:j + keep])
        out = np.empty(out_bounds[-1], dtype=np.uint64)
        long = n >= k
        if long.any():
            lengths = counts[long]
            source = np.repeat(bounds[:-1][long] - np.cumsum(np.concatenate(([0], lengths[:-1]))), lengths) + np.arange(lengths.sum())
            target = np.repeat(out_bounds[:-1][long] - np.cumsum(np.concatenate(([0], lengths[:-1]))), lengths) + np.arange(lengths.sum())
            out[target] = full[source]
        for words in range(1, k):
            short = np.flatnonzero(n == words)
            if len(short):
                first = bounds[:-1][short]
                part = acc[first] + np.uint64(words)
                for j in range(1, words):
                    part = mix(part * np.uint64(_GOLD | 1) + h[first + j])
                out[out_bounds[:-1][short]] = mix(part)
    return out, out_bounds


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty for a null text or one without words."""
    h, bounds = word_hashes([t or b"" for t in texts])
    s, b = shingle_hashes(h, bounds, k)
    return [np.unique(s[b[i]:b[i + 1]]) for i in range(len(texts))]


def pieces(texts: list[bytes | None], limit: int = PIECE) -> Iterator[slice]:
    """Consecutive runs of texts of about ``limit`` bytes together, at least one text each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))
