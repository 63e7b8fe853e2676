r"""Quality classifier: votes of the nearest labelled texts in a latent-semantic space.

Terms are of three sorts: triples of byte classes (letters, digits, marks ...) with pairs of equal
neighbouring words and lines; words; and runs of four bytes, both lower-cased in ASCII and hashed into
HASHED places. Counts are damped and weighted by rarity, each sort gets its share of the length, and the
whole is projected on the first right singular vectors of the labelled texts' matrix. The labelled vectors are broadcast; every document's
cosine with each of them is computed exactly, block by block, and the NEIGHBOURS nearest vote with
weights that fall with the distance.

Defined cases: a null text counts as empty. A text without terms (empty) is like no labelled text and
gets the labelled texts' mean. Without labels the score is 0.5. Labels of a doc_id that is labelled more
than once are averaged and rounded up; of several texts under a labelled doc_id the first in the alphabet is
learned. Of labelled texts that tie for the last place among the nearest any may vote. Very long texts are
read whole. Repeated rows are scored each; other columns are not read.
"""
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import chunks, mixed, span_hashes, word_spans
from .common import crc_mod

#: Labelled texts that are learned from at most: the bound of the sample and of what is broadcast.
LABELLED = 3000
NEIGHBOURS, DIMENSIONS, SHARPNESS, BLOCK = 25, 64, 16, 2048
CLASSES, HASHED = 16, 2048
#: Where the sorts of terms begin, and their lengths in a text's vector.
SORTS, LENGTHS = [0, CLASSES**3 + 2, CLASSES**3 + 2 + HASHED, CLASSES**3 + 2 + 2 * HASHED], [1.0, 0.5, 0.5]
TERMS = SORTS[-1]

#: Byte classes: 0 space, 1 line feed, 2 lower case, 3 upper case, 4 digit, 5-13 marks of their own, 14 other, 15 above ASCII.
_CLASS = np.full(256, 14, np.int32)
_CLASS[[32, 9, 11, 12, 13]] = 0
_CLASS[10] = 1
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
for _k, _c in enumerate(b".,!#*$%&|"):
    _CLASS[_c] = 5 + _k
_CLASS[128:] = 15


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x terms."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    if not len(data):
        return out
    text = np.repeat(np.arange(n), np.diff(offsets))
    kind = _CLASS[data]
    if len(data) > 2:
        whole = text[:-2] == text[2:]
        key = text[:-2] * CLASSES**3 + kind[:-2] * CLASSES**2 + kind[1:-1] * CLASSES + kind[2:]
        out[:, : CLASSES**3] = np.bincount(key[whole], minlength=n * CLASSES**3).reshape(n, -1)
    for k, cut in enumerate((kind <= 1, kind == 1)):
        starts, ends, _ = word_spans(cut, offsets)
        if len(starts) > 1:
            h, of = span_hashes(data, starts, ends), text[starts]
            twice = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
            out[:, CLASSES**3 + k] = np.bincount(of[1:][twice], minlength=n)
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    placed = lambda h, of: np.bincount(of * HASHED + (h >> np.uint64(40)).astype(np.int64) % HASHED, minlength=n * HASHED).reshape(n, HASHED)
    starts, ends, _ = word_spans(kind <= 1, offsets)
    out[:, SORTS[1] : SORTS[2]] = placed(span_hashes(low, starts, ends), text[starts])
    if len(low) > 3:
        four = sum(low[k : len(low) - 3 + k].astype(np.uint64) << np.uint64(8 * k) for k in range(4))
        whole = text[:-3] == text[3:]
        out[:, SORTS[2] :] = placed(mixed(four[whole]), text[:-3][whole])
    return out


def weighted(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """counts (which are overwritten) as vectors of length 1."""
    np.log1p(counts, out=counts)
    counts *= rarity
    for a, e, length in zip(SORTS, SORTS[1:], LENGTHS):
        counts[:, a:e] *= length / np.maximum(np.linalg.norm(counts[:, a:e], axis=1, keepdims=True), 1e-9)
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    return counts


@dataclass
class Model:
    rarity: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return unit(weighted(counts, self.rarity) @ self.axes)

    def score(self, column: pa.Array) -> np.ndarray:
        out = []
        for _, _, data, offsets in chunks(column, 1 << 18):
            for a in range(0, len(offsets) - 1, 256):
                at = offsets[a : a + 257]
                out.append(self.votes(self.latent(term_counts(data[at[0] : at[-1]], at - at[0]))))
        return np.concatenate(out) if out else np.zeros(0)

    def votes(self, x: np.ndarray) -> np.ndarray:
        sims = labels = np.zeros((len(x), 0), np.float32)
        for a in range(0, len(self.vectors), BLOCK):
            sims = np.hstack([sims, x @ self.vectors[a : a + BLOCK].T])
            labels = np.hstack([labels, np.broadcast_to(self.labels[a : a + BLOCK], (len(x), len(self.labels[a : a + BLOCK])))])
            if sims.shape[1] > NEIGHBOURS:
                top = np.argpartition(-sims, NEIGHBOURS - 1, axis=1)[:, :NEIGHBOURS]
                sims, labels = np.take_along_axis(sims, top, 1), np.take_along_axis(labels, top, 1)
        w = np.maximum(sims, 0).astype(float) ** SHARPNESS
        total = w.sum(axis=1)
        mean = float(self.labels.mean())
        return np.where(total > 1e-9, (w * labels).sum(axis=1) / np.maximum(total, 1e-9), mean)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(texts: list[str], labels: list[int], seed: int = 5) -> Model | None:
    if not texts:
        return None
    counts = np.zeros((len(texts), TERMS), np.float32)
    for a, e, data, offsets in chunks(pa.array(texts, pa.string())):
        for i in range(a, e, 256):
            at = offsets[i - a : i - a + 257]
            counts[i : min(i + 256, e)] = term_counts(data[at[0] : at[-1]], at - at[0])
    rarity = np.log((1 + len(texts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    x = weighted(counts, rarity)
    # a randomised SVD: a few passes over the matrix, then a small exact one
    q = np.random.default_rng(seed).standard_normal((TERMS, min(DIMENSIONS + 16, len(texts)))).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    axes = (q @ np.linalg.svd(x @ q, full_matrices=False)[2].T)[:, :DIMENSIONS].astype(np.float32)
    return Model(rarity, axes, unit(x @ axes).astype(np.float32), np.array(labels, np.float32))


def learn(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Model | None:
    """docs(doc_id, text), labels(doc_id, label): at most bound labelled rows, those with the least
    hashes of doc_id."""
    own = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label"))
    few = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("label").alias("label"))
    got = sorted(rows.toLocalIterator(), key=lambda r: r["doc_id"])
    return fit([r["text"] for r in got], [r["label"] for r in got])


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, held_out, text) as doc_id, held_out, score."""
    if model is None:
        return docs.select("doc_id", "held_out", F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.clip(shared.value.score(b.column(2)), 0, 1), pa.float64())], ["doc_id", "held_out", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from the labels that aren't held out."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 0)
    known = labels.filter(crc_mod(F.col("doc_id"), 5) != 0).select(F.col("doc_id").cast("long"), F.col("quality").alias("label"))
    scored = classify(rows, learn(rows.select("doc_id", "text"), known))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
