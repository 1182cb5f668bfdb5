"""Words of many texts as numpy arrays of 64-bit hashes."""

from __future__ import annotations

import functools

import numpy as np

#: Bytes of text that a task handles at a time.
CHUNK = 1 << 21
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + ODD
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64))


def mapped(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[data] for bytes and a table of 256 bytes."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, x, np.uint64)))) for x in (ODD, np.uint64(pow(int(ODD), -1, 1 << 64))))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ODD and of its inverse, at least the first ``n`` of each."""
    return _powers(n) if n > CHUNK else _powers(CHUNK if n > 1 << 20 else 1 << 20)


def space_table() -> np.ndarray:
    """Which bytes separate words: 0x20 and 0x09 to 0x0D."""
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


def letter_gap_table() -> np.ndarray:
    """Which bytes separate terms: all but ASCII letters and the bytes of other scripts."""
    out = np.ones(256, bool)
    out[0x80:] = False
    for lo, hi in ((0x41, 0x5B), (0x61, 0x7B)):
        out[lo:hi] = False
    return out


def lower_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[0x41:0x5B] += 32
    return out


def chunks(texts: list, limit: int = CHUNK):
    """(start, end) slices of at most ``limit`` characters, or of one text."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def hash_words(texts: list, gaps: np.ndarray, lower: bool = True, begin: int = 0) -> tuple[np.ndarray, ...]:
    """(hashes of all words in order, bounds of each text's words).  ASCII letters fold to lower case.

    With ``begin``, a third array has the hashes of the words' first ``begin`` bytes.
    """
    data, starts_of = joined(texts)
    return hash_stretches(mapped(data, lower_table()) if lower else data, starts_of, gaps, begin)


def joined(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, each with a line end after it, and where each starts)."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"\n".join(raw) + b"\n", np.uint8), np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))


def hash_stretches(data: np.ndarray, starts_of: np.ndarray, gaps: np.ndarray, begin: int = 0) -> tuple[np.ndarray, ...]:
    """hash_words of bytes: the stretches between ``starts_of``, each ending in a gap."""
    edge = np.diff(mapped(data, gaps).view(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    if not len(start):
        none = np.empty(0, np.uint64), np.zeros(len(starts_of), np.int64)
        return (*none, none[0]) if begin else none
    end = end if len(end) == len(start) else np.append(end, len(data))
    up, down = powers(len(data))
    with np.errstate(over="ignore"):
        # sums over all bytes before; a word's own is a difference, moved back to where a word at 0 has it
        upto = np.empty(len(data) + 1, np.uint64)
        upto[0] = 0
        np.cumsum(byte_values()[data] * up[: len(data)], out=upto[1:])
        before, back = upto[start], down[start]
        hashes = mix((upto[end] - before) * back + (end - start).astype(np.uint64))
        bounds = np.searchsorted(start, starts_of)
        if begin:
            return hashes, bounds, mix((upto[np.minimum(end, start + begin)] - before) * back ^ ODD)
    return hashes, bounds


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``width`` words; a shorter text is one run, an empty one none."""
    n = len(hashes)
    with np.errstate(over="ignore"):
        run = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width):
            run = mix(run * ODD + hashes[k : n - width + 1 + k]) if len(run) else run
        out = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo >= width:
                out.append(np.unique(run[lo : hi - width + 1]))
            elif hi > lo:
                one = np.array([hi - lo], np.uint64)
                for h in hashes[lo:hi]:
                    one = mix(one * ODD + h)
                out.append(one)
            else:
                out.append(np.empty(0, np.uint64))
    return out
