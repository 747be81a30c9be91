"""Vectorised hashing of words and character n-grams over whole Arrow batches, in numpy.

A batch of texts is one byte array; nothing here loops over characters or words in Python.
"""

from __future__ import annotations

import numpy as np

from brindle.llm.common import ship_by_value

#: An odd multiplier for the rolling word hash and its inverse modulo 2**64.
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column, A-Z lowered, and the offsets of its texts.

    A null text is empty: Arrow gives it no bytes once nulls are filled.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = int(offsets[0]) if len(offsets) else 0
    return _FOLD[body[start : int(offsets[-1])]], offsets - start


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all bits before."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done, step = 1, np.uint64(base & ((1 << 64) - 1))
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done += more
        step = step * step
    return out[:n]


def word_spans(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word (one more at the end)."""
    inside = np.empty(len(body) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_BLANK[body], out=inside[1:-1])
    cuts = offsets[1:-1]
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    # A word that runs over the end of one text into the next is two words.
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(body))])
    cuts = cuts[inside[cuts] & inside[cuts + 1]] if len(cuts) else cuts
    if len(cuts):
        starts = np.sort(np.concatenate([starts, cuts]))
        ends = np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, finished by `mix`.

    Sums of byte * M**place are differences of a running sum, brought back to place 0 by the
    inverse power; blocks keep the running sum's memory bounded.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = int(starts[at])
            to = int(np.searchsorted(starts, low + block))
            to = max(to, at + 1)
            high = int(ends[to - 1])
            n = high - low
            run = np.empty(n + 1, dtype=np.uint64)
            run[0] = 0
            np.cumsum((body[low:high].astype(np.uint64) + np.uint64(1)) * powers(MULTIPLIER, n), out=run[1:])
            s, e = starts[at:to] - low, ends[at:to] - low
            sums = (run[e] - run[s]) * powers(INVERSE, n + 1)[s]
            out[at:to] = mix(sums + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            at = to
    return out


ship_by_value(__name__)
