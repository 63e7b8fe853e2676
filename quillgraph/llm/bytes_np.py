"""Columns of texts as one array of bytes, for operators that work on whole batches with NumPy."""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; a longer text is worked on alone.
CHUNK = 1 << 18
_R = np.uint64(0x9E3779B97F4A7C15)


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first row, end row, bytes, offsets (n + 1) of slices with about `most` bytes. Nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        e = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, e, data[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a]
        a = e


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all hang on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Keeps the first bytes of a little-endian word: by how many.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes. A span's 8-byte words are mixed together
    with their place before they are added up, so no pattern of bytes makes sums collide."""
    n = ends - starts
    words = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).data, 0, (1,))
    out = mixed((words[starts] & _FIRST[np.minimum(n, 8)]) + _R)
    long = np.flatnonzero(n > 8)
    if len(long):
        blocks = (n[long] - 1) // 8
        first = blocks.cumsum() - blocks
        place = np.arange(blocks.sum()) - np.repeat(first, blocks) + 1
        at = np.repeat(starts[long], blocks) + 8 * place
        word = words[at] & _FIRST[np.minimum(np.repeat(ends[long], blocks) - at, 8)]
        out[long] += np.add.reduceat(mixed(mixed(word) + place.astype(np.uint64) * _R), first)
    return mixed(out + n.astype(np.uint64) * _R)


def word_spans(space: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts and ends of the runs without space, which texts' borders cut; and of each text the number
    of runs before it (n + 1)."""
    inside = np.zeros(len(space) + 2, bool)
    inside[1:-1] = ~space
    begins = inside[1:-1] & ~inside[:-2]
    finishes = inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(space))]
    begins[cuts] = inside[1:-1][cuts]
    finishes[cuts - 1] = inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(starts, offsets)
