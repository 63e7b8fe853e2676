"""A table from pieces of text to their token ids, in arrays: what a worker remembers takes tens of bytes a
piece, is bounded by pieces and by bytes, and whole blocks of pieces are looked up at a time."""
from collections.abc import Callable

import numpy as np

from .bytes_np import span_hashes


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype: str):
        self.room, self.n = np.zeros(1024, dtype), 0

    def append(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.room):
            self.room = np.concatenate([self.room, np.zeros(max(len(x), len(self.room)), self.room.dtype)])
        self.room[self.n : self.n + len(x)] = x
        self.n += len(x)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each span, in a row."""
    ends = lengths.cumsum()
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class PieceTable:
    """teach(data, starts, lengths) gives the ids of pieces in a row and how many each has. The bytes of
    all pieces are compared with those that the table was taught, so that equal hashes of different
    pieces can't go unseen."""

    def __init__(self, teach: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], most: int, most_bytes: int = 1 << 25):
        self.teach, self.most, self.most_bytes = teach, most, most_bytes
        self.forget()

    def forget(self) -> None:
        self.mask = (1 << 12) - 1
        self.table = np.full(self.mask + 1, -1, np.int32)
        self.keys, self.data, self.data_at, self.ids, self.ids_at = Grown("u8"), Grown("u1"), Grown("i8"), Grown("u4"), Grown("i8")
        self.data_at.append(np.zeros(1, "i8"))
        self.ids_at.append(np.zeros(1, "i8"))

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The piece with each key, or -1."""
        at = (keys & np.uint64(self.mask)).astype(np.int64)
        out = self.table[at]
        off = np.flatnonzero((out >= 0) & (self.keys.room[out] != keys))
        while len(off):
            at[off] = (at[off] + 1) & self.mask
            out[off] = self.table[at[off]]
            off = off[(out[off] >= 0) & (self.keys.room[out[off]] != keys[off])]
        return out

    def learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Distinct new keys, and the bytes of their pieces."""
        for i in range(0, len(keys), 2000):
            a, n = starts[i : i + 2000], lengths[i : i + 2000]
            ids, each = self.teach(data, a, n)
            self.data_at.append(n.cumsum() + self.data.n)
            self.ids_at.append(each.cumsum() + self.ids.n)
            self.data.append(data[spread(a, n)])
            self.ids.append(ids)
        self.keys.append(keys)
        first = self.keys.n - len(keys)
        if 2 * self.keys.n > self.mask:
            self.mask = (1 << (4 * self.keys.n).bit_length()) - 1
            self.table, first = np.full(self.mask + 1, -1, np.int32), 0
        place = np.arange(first, self.keys.n, dtype=np.int32)
        at = (self.keys.room[first : self.keys.n] & np.uint64(self.mask)).astype(np.int64)
        while len(place):
            free = self.table[at] < 0
            self.table[at[free]] = place[free]
            left = self.table[at] != place
            at, place = (at[left] + 1) & self.mask, place[left]

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of data[start:end] of all spans in a row, and how many each has; None where two
        different pieces have one hash."""
        keys, lengths = span_hashes(data, starts, ends), ends - starts
        if self.keys.n > self.most // 2 and self.keys.n + len(keys) > self.most or self.data.n > self.most_bytes:
            self.forget()
        place = self.places(keys)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            first = missing[first]
            self.learn(new, data, starts[first], lengths[first])
            place[missing] = self.places(keys[missing])
        at = self.data_at.room
        if not np.array_equal(at[place + 1] - at[place], lengths) or not np.array_equal(self.data.room[spread(at[place], lengths)], data[spread(starts, lengths)]):
            return None
        at = self.ids_at.room
        each = at[place + 1] - at[place]
        return self.ids.room[spread(at[place], each)], each
