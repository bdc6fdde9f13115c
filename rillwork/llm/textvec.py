"""Vectorised tokenising of Arrow string batches: word, line and run boundaries and 64-bit hashes as NumPy arrays.

Works on the UTF-8 bytes of a whole batch at once, so no Python string is made per word. Null texts count as empty.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_BASE, _KEY = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text that are handled at once; it bounds the size of the temporary arrays, not of a text.
CHUNK_BYTES = 1 << 19

WS = np.zeros(256, bool)
WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII letters and every byte of a multi-byte character.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LETTER[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h = h ^ (h >> np.uint64(27))
    h = h * _M2
    return h ^ (h >> np.uint64(31))


def blocks(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the runs' bytes, eight to a number and zeros after a run's end; each run's first number; each number's place in its run); no run is empty."""
    n = (lengths + 7) >> 3
    last = np.cumsum(n)
    place = np.arange(int(last[-1])) - np.repeat(last - n, n)
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    got = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))[np.repeat(starts, n) + 8 * place]
    left = np.repeat(lengths, n) - 8 * place
    short = np.flatnonzero(left < 8)
    got[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
    return got, last - n, place


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each run buf[starts:ends], none empty: blocks of eight bytes, each mixed with a key of its place, summed and mixed again. What must be exact compares bytes as well, see classes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    got, first, place = blocks(buf, starts, lengths)
    return mix(np.add.reduceat(mix(got ^ mix(place.astype(np.uint64) * _BASE + _KEY)), first) + lengths.astype(np.uint64))


def same_runs(buf: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the runs of equal lengths that start at a and at b have the same bytes."""
    if not len(a):
        return np.zeros(0, bool)
    x, first, _ = blocks(buf, a, lengths)
    return np.logical_and.reduceat(x == blocks(buf, b, lengths)[0], first)


def classes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each run, the same for two runs just if they have the same bytes: neighbours in the order of hashes are compared in full."""
    h = run_hashes(buf, starts, ends)
    order = np.argsort(h, kind="stable")
    new = np.concatenate((np.ones(min(1, len(h)), bool), h[order][1:] != h[order][:-1]))
    at = np.flatnonzero(~new)
    one, two = order[at - 1], order[at]
    alike = (ends - starts)[one] == (ends - starts)[two]
    alike[alike] = same_runs(buf, starts[one[alike]], starts[two[alike]], (ends - starts)[one[alike]])
    if not alike.all():
        seen: dict[bytes, int] = {}
        return np.array([seen.setdefault(buf[a:z].tobytes(), len(seen)) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    out = np.empty(len(h), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on through other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_chunks(texts: pa.Array | pa.ChunkedArray, size: int | None = None):
    """(first row, bytes, offsets) for slices of about size bytes, CHUNK_BYTES if not given; a longer text is a slice of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + (size or CHUNK_BYTES), "right")) - 1
        end = min(n, max(row + 1, end))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of True that don't cross a row's boundary."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(buf: np.ndarray, offsets: np.ndarray):
    """Runs of bytes other than ASCII white space."""
    return runs(~WS[buf], offsets)


def window_hashes(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of first word) of each k-word window within a row; its order matters."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _M2 + h[j : j + n]
    first = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(out[first]), first
