r"""Token ids in directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level 0 has every id's first chunk, level 1 the second
chunk of those ids that have one, and so on. A bitmap per level tells which chunks continue; a directory
of ranks, one entry per 512 bits, leads from a position to its place on the next level. So any one id is
read by a few look-ups (Segment.__getitem__), with no block to decode.

A segment holds some documents in ascending order: a magic word, its length, its place (the range of
doc_ids that it is from and its number there), the table of documents, then each level. A file is some
segments of one range, each followed by one line feed. Places are numbers in the segments, so no order of
file names is relied on.

Defined cases: null and empty texts hold the end id only. Rows that share a doc_id stand side by side, in
the order of their texts; null ids come first, as in Spark's order. A very long text is a segment of its
own. Other columns are not read.
"""
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytes_np import CHUNK, chunks
from .common import read_blobs, shared_dir, stored, write_blobs
from .pieces import PieceTable, spread

MAGIC, WIDTH, PER_RANK = b"DACS", 8, 512
#: Documents and bytes of text of one segment; a block of texts that reaches either is its last.
SEGMENT_DOCS, SEGMENT_BYTES = 512, 1_000_000
#: Segments of one file: about 40 MB, unless single texts are longer.
FILE_SEGMENTS = 64
#: Words, and pieces of words, that a worker remembers before it starts anew.
WORDS, PIECES = 100_000, 1_000_000


def write_segment(doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray, place: tuple[int, int] = (0, 0)) -> bytes:
    """known: 0 where a document has no id. place: range, number in the range."""
    levels, rest = [], ids.astype("<u4")
    while len(rest):
        more = rest >= 1 << WIDTH
        bits = np.packbits(more, bitorder="little")
        ranks = np.concatenate([[0], np.add.reduceat(more, np.arange(0, len(more), PER_RANK), dtype=np.int64).cumsum()[:-1]]).astype("<u4")
        levels.append(struct.pack("<II", len(rest), len(ranks)) + (rest & 255).astype("u1").tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> WIDTH
    body = struct.pack("<IIB", len(doc_ids), len(ids), len(levels)) + doc_ids.astype("<i8").tobytes() + known.astype("u1").tobytes() + lengths.astype("<u4").tobytes() + b"".join(levels)
    return MAGIC + struct.pack("<QQQ", len(body), *place) + body


class Segment:
    def __init__(self, body: memoryview, place: tuple[int, int]):
        self.place = place
        n, self.total, depth = struct.unpack_from("<IIB", body)
        at = 9
        self.doc_ids = np.frombuffer(body, "<i8", n, at)
        self.known = np.frombuffer(body, "u1", n, at + 8 * n)
        self.lengths = np.frombuffer(body, "<u4", n, at + 9 * n)
        at += 13 * n
        self.levels = []
        for _ in range(depth):
            size, n_ranks = struct.unpack_from("<II", body, at)
            at += 8
            chunks = np.frombuffer(body, "u1", size, at)
            bits = np.frombuffer(body, "u1", -(-size // 8), at + size)
            ranks = np.frombuffer(body, "<u4", n_ranks, at + size + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += size + len(bits) + 4 * n_ranks

    def __getitem__(self, i: int) -> int:
        """The i-th id, without the others."""
        if not 0 <= i < self.total:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // PER_RANK
            first = block * PER_RANK // 8
            before = np.unpackbits(bits[first : (i >> 3) + 1], bitorder="little")[: i - block * PER_RANK]
            i, shift = int(ranks[block]) + int(before.sum()), shift + WIDTH
        return value

    def ids(self) -> np.ndarray:
        out = np.zeros(0, "<u4")
        for chunks, bits, _ in reversed(self.levels):
            value = chunks.astype("<u4")
            value[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= out << WIDTH
            out = value
        return out


def read_segments(data) -> Iterator[Segment]:
    """The segments of a file's bytes, which aren't copied."""
    at, view = 0, memoryview(data)
    while at < len(view):
        if view[at : at + 4] != MAGIC:
            raise ValueError("no segment where one is due")
        n, part, number = struct.unpack_from("<QQQ", view, at + 4)
        yield Segment(view[at + 28 : at + 28 + n], (part, number))
        at += 29 + n


class WordEncoder:
    """The ids of the public library's tokenizer, word by word. Its normaliser and its splitting never
    look across a space or a line feed, so a text's ids are its words' ids in a row.

    A word that is new to a worker is lower-cased and split as the library does, if all its characters
    are ones on which normal forms have no effect, so that words that differ in capitals or marks share
    their pieces; new pieces go through the library many at a time, and the ids that end a piece divide
    what comes back. All other new words go through the library whole."""

    #: ASCII and the letters up to U+017F that lower-case to one character, without white space.
    PLAIN = regex.compile(r"[\x21-\x7e\xa1-\u012f\u0131-\u017f]+")
    #: Fixed value: the splitting pattern of the vocabulary file.
    PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str, words: int = WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known, self.pieces = Tokenizer.from_file(path), words, {"": b""}, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        split, whole = [], []
        for w in words:
            # letters, with one mark behind them at most: most words, and no pattern is needed
            body, mark = (w[:-1], [w[-1]]) if w[-1] in ".,!?;:" else (w, [])
            if body.isalpha() and max(body) <= "\u017f" and "\u0130" not in body:
                split.append((w, [body.lower(), *mark]))
            elif self.PLAIN.fullmatch(w) and "<|" not in w:
                split.append((w, self.PIECE.findall(w.lower())))
            else:
                whole.append(w)
        if whole:
            self.known.update(zip(whole, (x.tobytes() for x in self.library(whole))))
        new = list({p for _, ps in split for p in ps}.difference(self.pieces))
        for i in range(0, len(new), 2000):
            some = new[i : i + 2000]
            ids = self.library([" ".join(some)])[0]
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some) or cuts[-1] != len(ids):
                raise ValueError("the vocabulary doesn't mark the ends of pieces")
            data, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
            self.pieces.update(zip(some, (data[a:b] for a, b in zip(at, at[1:]))))
        get = self.pieces.__getitem__
        for w, ps in split:
            self.known[w] = get(ps[0]) if len(ps) == 1 else b"".join(map(get, ps))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known = {"": b""}
        if len(self.pieces) > self.most:
            self.pieces = {}
        split = [(t.lower() if t.isascii() and "<|" not in t else t).replace("\n", " ").split(" ") for t in texts]
        new = set().union(*split).difference(self.known)
        if new:
            self.learn(new)
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


_CLASS = np.full(256, 4, np.uint8)  # of bytes: white space, letter, digit, mark, not read here
_CLASS[[9, 10, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = 1
_CLASS[48:58] = 2
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3


class PieceEncoder:
    """The ids of the public library's tokenizer for whole blocks of texts. Bytes are lower-cased and cut
    into the pieces of WordEncoder.PIECE with NumPy; a hash table leads from pieces to their ids. New
    pieces go through the library. The bytes of all pieces are compared with those that the table was
    taught, so that equal hashes of different pieces can't go unseen.

    Texts with other characters than ASCII's and the letters from U+00C0 to U+00FF are left to WordEncoder,
    as are those with the strings of special tokens."""

    def __init__(self, path: str, most: int = PIECES):
        self.words = WordEncoder(path)
        self.known = PieceTable(self.taught, most)

    def taught(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new pieces in a row, and how many each has."""
        line = np.full(lengths.sum() + len(lengths), 32, np.uint8)
        line[np.arange(lengths.sum()) + np.repeat(np.arange(len(lengths)), lengths)] = data[spread(starts, lengths)]
        ids = self.words.library([line.tobytes().decode()])[0]
        cuts = np.flatnonzero(self.words.ends[ids]) + 1
        if len(cuts) != len(lengths) or cuts[-1] != len(ids):
            raise ValueError("the vocabulary doesn't mark the ends of pieces")
        return ids, np.diff(cuts, prepend=0)

    def pieces(self, data: np.ndarray, kind: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """starts and ends of the pieces of lower-cased bytes. borders: where a text begins."""
        n = len(data)
        fresh = np.zeros(n + 1, bool)
        fresh[borders] = True
        fresh[-1] = True
        begin = np.ones(n + 1, bool)
        begin[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begin |= fresh
        begin[:n] &= kind != 0
        # a lone apostrophe takes s, t, m, d, re, ve or ll along
        q = np.flatnonzero((data == 39) & begin[:n])
        q = q[(q + 1 < n) & ~fresh[q + 1]]
        after = lambda k: np.where((q + k < n), data[np.minimum(q + k, n - 1)], 0)
        x, y = after(1), after(2)
        long = (((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))) & ~fresh[np.minimum(q + 2, n)]
        short = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        begin[q[short | long] + 1] = False
        rest = np.concatenate([q[short] + 2, q[long] + 3])
        rest = rest[rest < n]
        begin[rest[kind[rest] == 1]] = True
        space = np.ones(n + 1, bool)
        space[:n] = kind == 0
        return np.flatnonzero(begin[:n]), np.flatnonzero(~space[:n] & (begin[1:] | space[1:])) + 1

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in a row, and how many each has."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(n, np.int64)
        kind = _CLASS[data]
        low = data.copy()
        low[(data >= 65) & (data <= 90)] += 32
        second = np.flatnonzero(data[:-1] == 0xC3) + 1
        low[second[(data[second] <= 0x9E) & (data[second] != 0x97)]] += 32
        odd = [np.flatnonzero(kind == 4), second[(data[second] == 0x97) | (data[second] == 0xB7)], np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))]
        others = np.unique(np.searchsorted(offsets, np.concatenate(odd), "right") - 1)
        for k in others:
            kind[offsets[k] : offsets[k + 1]] = 0
        borders = offsets[:-1][offsets[:-1] < len(data)]
        starts, ends = self.pieces(low, kind, borders)
        found = self.known.look_up(low, starts, ends)
        if found is None:
            own = np.zeros(0, "<u4")
            count, others = np.zeros(n, np.int64), np.arange(n)
        else:
            own, each = found
            before = np.concatenate([[0], each.cumsum()])
            count = np.diff(before[np.searchsorted(starts, offsets)])
        if not len(others):
            return own, count
        # the texts that are left to the other encoder take their places between those
        own = np.split(own, count.cumsum()[:-1])
        for k, x in zip(others, self.words.encode([data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in others])):
            own[k] = np.frombuffer(x, "<u4")
        return np.concatenate(own), np.array([len(x) for x in own])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """block(), but a very long text goes in parts that end before white space."""
        if len(offsets) > 2 or len(data) <= 4 * CHUNK:
            return self.block(data, offsets)
        spaces = np.flatnonzero((data == 32) | (data == 10))
        cuts = np.unique(np.concatenate([[0], spaces[np.searchsorted(spaces, np.arange(CHUNK, spaces[-1] if len(spaces) else 0, CHUNK))], [len(data)]]).astype(np.int64))
        ids = np.concatenate([self.block(data[a:e], np.array([0, e - a]))[0] for a, e in zip(cuts, cuts[1:])])
        return ids, np.array([len(ids)])


@cache
def piece_encoder(path: str) -> PieceEncoder:
    """Once per worker."""
    return PieceEncoder(path)


def with_end(ids: np.ndarray, count: np.ndarray, end_id: int) -> np.ndarray:
    """The end id behind each text's ids."""
    out = np.full(len(ids) + len(count), end_id, "<u4")
    out[np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)] = ids
    return out


def write_ids(docs: DataFrame, to: str, tokenizer: str, end_id: int, text: str = "text") -> None:
    """Files of segments under to, in ascending doc_id order within and across files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = piece_encoder(tokenizer)
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        number, part = 0, TaskContext.get().partitionId()

        def segment() -> pa.RecordBatch:
            doc_ids = pa.chunked_array([d for d, _, _ in held])
            blob = write_segment(
                doc_ids.fill_null(0).to_numpy(), doc_ids.is_valid().to_numpy(), np.concatenate([n for _, n, _ in held]), np.concatenate([x for _, _, x in held]), (part, number)
            )
            return pa.record_batch([pa.array([blob], pa.binary())], ["segment"])

        size = 0
        for b in batches:
            for i, e, data, offsets in chunks(b.column(1)):
                ids, count = enc.encode(data, offsets)
                held.append((b.column(0).slice(i, e - i), count + 1, with_end(ids, count, end_id)))
                size += len(data)
                if sum(len(d) for d, _, _ in held) >= SEGMENT_DOCS or size >= SEGMENT_BYTES:
                    yield segment()
                    held, size, number = [], 0, number + 1
        if held:
            yield segment()

    rows = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    in_order = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    write_blobs(in_order.mapInArrow(run, "segment binary"), "segment", to, "\n", FILE_SEGMENTS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            before, first = 0, None
            for s in read_segments(content.as_buffer()):
                first = s.place if first is None else first
                ids, ends = s.ids(), s.lengths.astype("i8").cumsum()
                starts = ends - s.lengths
                crc = [zlib.crc32(ids[a:e].tobytes()) for a, e in zip(starts, ends)]
                n = len(starts)
                same = lambda v, kind: pa.array([v] * n, kind)
                yield pa.record_batch(
                    [same(first[0], pa.int64()), same(first[1], pa.int64()), pa.array(s.doc_ids, pa.int64(), mask=s.known == 0), pa.array(starts + before, pa.int64()), pa.array(s.lengths, pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "number", "doc_id", "start", "n_tokens", "ids_crc32"],
                )
                before += s.total


def read_ids(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files under path. What a file's
    documents have before them in other files comes from the files' totals, one row a file: a range, and
    the number of the file's first segment there."""
    rows = stored(read_blobs(spark, path).mapInArrow(_read, "part long, number long, doc_id long, start long, n_tokens long, ids_crc32 long"))
    files = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("total"))
    files = files.withColumn("before", F.sum("total").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))).select("part", "number", F.coalesce("before", F.lit(0)).alias("before"))
    return rows.join(files, ["part", "number"]).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    path = shared_dir(docs.sparkSession)
    write_ids(docs, path, tokenizer, end_id)
    return read_ids(docs.sparkSession, path)
