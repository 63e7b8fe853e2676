r"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string the last token of its encoding is unique; prefix i ends in token t iff
t's bytes end there and t may follow the last token of the prefix before t. Encoder.last_tokens stores
that table, so appending bytes or re-encoding after an edit redoes only the prefixes behind the change,
and the tokens are read off backwards. Two tokens may follow each other iff no merge that BPE would make
earlier crosses the border between them; that is decided by undoing merges on both sides.

A text is split by a pattern first; each piece is encoded separately. Whole blocks of texts are split and
looked up with NumPy in a table of the pieces that the worker has met; new pieces go through the prefix
table. What a worker remembers is bounded by bytes, and it gives the pieces back at the end of a task,
whatever ends it.

Defined cases: null and empty texts have no tokens. Very long texts are encoded whole, in parts that end
where the pattern ends a piece. Repeated rows and ids are encoded each. Only doc_id and the text column
are read, whatever else the table holds.
"""
import base64
import contextlib
import ctypes
import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import CHUNK, chunks
from .pieces import PieceTable, spread

#: Pieces, and bytes of pieces, that a worker remembers before it starts anew.
PIECES, PIECE_BYTES = 400_000, 1 << 23
#: Places for pairs of tokens whose answers are kept, 8 bytes each.
PAIRS = 1 << 20
#: Fixed value: the pattern that splits() finds the pieces of.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: Whether two tokens may follow each other, of pairs met lately: pair * 2 + answer, at pair % PAIRS.
        self.allowed = array("q", [-1]) * PAIRS
        #: Finds all tokens that end at each byte (bytes as characters of the same numbers).
        self.tokens_in = ahocorasick.Automaton()
        for b, r in ranks.items():
            self.tokens_in.add_word(b.decode("latin-1"), (r, len(b)))
        self.tokens_in.make_automaton()
        #: token -> the two tokens that its last merge joined; a token that no merge makes is whole.
        self.halves: dict[int, tuple[int, int]] = {}
        #: two tokens -> the token that a merge of them makes.
        self.merged: dict[tuple[int, int], int] = {}
        for b, r in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) > 1 and len(parts := self.plain(b, below=r)) == 2:
                self.halves[r] = (parts[0], parts[1])
                self.merged[parts[0], parts[1]] = r

        self.tokens = b"".join(self.bytes_of.get(i, b"") for i in range(max(self.bytes_of, default=-1) + 1))
        self.span = max(self.bytes_of, default=0) + 1
        self.token_at = np.cumsum([0, *(len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of, default=-1) + 1))])

    def plain(self, text: bytes, below: int | None = None) -> list[int]:
        """BPE by its definition: merge the pair of lowest rank, again and again."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (below is None or r < below) and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE, given the bytes of both, leaves a border between them. Going back in time, the
        later of the two last merges beside the border is undone; a merge across the border that comes
        before the merges undone so far would have happened first."""
        #: Merges across the border must rank below this to come first; on the border of equal ranks the left one is first.
        limit = float("inf")
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < limit:
                ok = False
                break
            l, r = self.halves.get(left), self.halves.get(right)
            if l is None and r is None:
                ok = True
                break
            if r is None or (l is not None and left > right):
                limit, left = left, l[1]
            else:
                limit, right = right + 1, r[0]
        return ok

    def last_tokens(self, text: bytes, known: list[int] | None = None, same: int = 0) -> list[int]:
        """table[i]: the last token of the encoding of text[: i + 1]. known: the table of an earlier
        text that has the first `same` bytes in common; only what lies behind is computed."""
        table = list(known[:same]) if known else []
        n, same = len(text), len(table)
        table += [-1] * (n - same)
        allowed, span = self.allowed, self.span
        found = same - 1
        # tokens that end behind the change may begin as far in front of it as the longest token is long
        for end, (t, size) in self.tokens_in.iter(text.decode("latin-1"), max(0, same - self.longest + 1)):
            if end <= found:
                continue
            if size <= end:
                pair = table[end - size] * span + t
                if (answer := allowed[pair % PAIRS]) >> 1 != pair:
                    answer = pair * 2 + self.may_follow(table[end - size], t)
                    allowed[pair % PAIRS] = answer
                if not answer & 1:
                    continue
            if end != found + 1:
                break
            table[end] = t
            found = end
        if found != n - 1:
            raise ValueError("the vocabulary lacks a byte of the text")
        return table

    def read_off(self, table: list[int]) -> list[int]:
        out, end = [], len(table)
        while end:
            out.append(table[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """A piece that is a token as a whole is that token, as in the public library."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self.read_off(self.last_tokens(piece))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and where each id's begin (n + 1)."""
        first = self.token_at[ids]
        n = self.token_at[ids.astype(np.int64) + 1] - first
        return np.frombuffer(self.tokens, np.uint8)[spread(first, n)], np.concatenate([[0], n.cumsum()])


_KIND = np.full(256, 9, np.uint8)  # of bytes: white space, letter, digit, mark, not read here
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = 1
_KIND[48:58] = 2
_KIND[[*range(0, 9), *range(14, 28), *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = 3


def splits(data: np.ndarray, kind: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Where a piece of SPLIT begins, of texts in a row. kind: of each byte; fresh (n + 1): where a text
    begins, and at the end. A run of one kind is a piece, but the last of some white space in front of
    other bytes stands alone, a space there joins what follows, and an apostrophe that is the first of its piece
    takes s, t, re, ve, m, ll or d along."""
    n = len(data)
    begin = fresh.copy()
    begin[1:n] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(begin[:n] & ~fresh[:n] & (kind != 0))
    at = at[kind[at - 1] == 0]
    begin[at - 1] = True
    begin[at[data[at - 1] == 32]] = False
    q = np.flatnonzero((data == 39) & begin[:n])
    q = q[~fresh[q + 1]]
    q = q[kind[q + 1] == 1]
    x = data[q + 1]
    two = ~fresh[np.minimum(q + 2, n)]
    y = np.where(two, data[np.minimum(q + 2, n - 1)], 0)
    short = (x == 115) | (x == 116) | (x == 109) | (x == 100)
    long = ((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108)
    begin[q[short | long] + 1] = False
    begin[np.concatenate([q[short] + 2, q[long] + 3])] = True
    return begin[:n]


class BlockEncoder:
    """Texts to ids, a block at a time."""

    def __init__(self, encoder: Encoder, pattern: str, pieces: int = PIECES):
        self.encoder, self.pattern, self.simple = encoder, regex.compile(pattern), pattern == SPLIT
        self.known = PieceTable(self.taught, pieces, PIECE_BYTES)

    def close(self) -> None:
        """Gives the tables' memory back: an idle worker holds none of it."""
        self.known.forget()
        with contextlib.suppress(AttributeError, OSError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)

    def taught(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new pieces in a row, and how many each has."""
        ids = [self.encoder.encode_piece(data[a : a + n].tobytes()) for a, n in zip(starts.tolist(), lengths.tolist())]
        return np.array([t for x in ids for t in x], "<u4"), np.array([len(x) for x in ids])

    def by_pattern(self, text: bytes) -> np.ndarray:
        """Where the pattern's matches begin in a text."""
        n = np.array([len(p.encode()) for p in self.pattern.findall(text.decode())])
        return n.cumsum() - n

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in a row, and how many each has."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(n, np.int64)
        fresh = np.zeros(len(data) + 1, bool)
        fresh[offsets] = True
        if self.simple:
            kind = _KIND[data]
            second = np.flatnonzero(data[:-1] == 0xC3) + 1
            odd = np.concatenate([np.flatnonzero(kind == 9), second[(data[second] == 0x97) | (data[second] == 0xB7)]])
            begin = splits(data, kind, fresh)
            others = np.unique(np.searchsorted(offsets, odd, "right") - 1)
        else:
            begin, others = fresh[:-1].copy(), np.flatnonzero(np.diff(offsets))
        for k in others:
            a, e = offsets[k], offsets[k + 1]
            begin[a:e] = False
            begin[a + self.by_pattern(data[a:e].tobytes())] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))
        found = self.known.look_up(data, starts, ends)
        if found is None:  # two pieces with one hash: each by itself
            found = self.taught(data, starts, ends - starts)
        ids, each = found
        before = np.concatenate([[0], each.cumsum()])
        return ids, np.diff(before[np.searchsorted(starts, offsets)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """block(), but a very long text goes in parts, which begin with white space behind other bytes."""
        if not self.simple or len(offsets) > 2 or len(data) <= 4 * CHUNK:
            return self.block(data, offsets)
        space = _KIND[data] == 0
        cuts = np.flatnonzero(space[1:] & ~space[:-1] & (data[:-1] < 128)) + 1
        last = cuts[-1] if len(cuts) else 0
        cuts = np.unique(np.concatenate([[0], cuts[np.searchsorted(cuts, np.arange(CHUNK, last, CHUNK))], [len(data)]]).astype(np.int64))
        ids = np.concatenate([self.block(data[a:e], np.array([0, e - a]))[0] for a, e in zip(cuts, cuts[1:])])
        return ids, np.array([len(ids)])


def encoded_blocks(batches: Iterator[pa.RecordBatch], enc: BlockEncoder) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """doc_id, ids of all texts in a row, how many each has, of batches of (doc_id, text)."""
    try:
        for b in batches:
            for a, e, data, offsets in chunks(b.column(1)):
                yield b.column(0).slice(a, e - a), *enc.encode(data, offsets)
    finally:
        enc.close()


@cache
def encoder_of(path: str) -> Encoder:
    """Once per worker."""
    return Encoder(read_ranks(path))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids, count in encoded_blocks(batches, BlockEncoder(encoder_of(path), pattern)):
            each = [x.tobytes() for x in np.split(ids, count.cumsum()[:-1])]
            yield pa.record_batch([doc_id, pa.array(count, pa.int64()), pa.array(each, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with the column decoded (binary) instead of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(path)
        for b in batches:
            out = [enc.decode(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: texts are encoded, and the ids decoded again, in
    one pass; neither ids nor bytes leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = BlockEncoder(encoder_of(path), pattern)
        for doc_id, ids, count in encoded_blocks(batches, enc):
            decoded, at = enc.encoder.decoded(ids)
            ends = count.cumsum()
            ids_sha = [hashlib.sha256(ids[a:e]).hexdigest() for a, e in zip(ends - count, ends)]
            decoded_sha = [hashlib.sha256(decoded[at[a] : at[e]]).hexdigest() for a, e in zip(ends - count, ends)]
            yield pa.record_batch([doc_id, pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
