r"""Language identification by bit-sliced Bloom filters of n-grams.

One table of slots serves all languages: bit l of a slot is slot s of language l's Bloom filter, in as many
words a slot as the languages need. Looking an n-gram up is an AND of a few slots, whose result has a bit
for every language that contains the n-gram. Per text and language the hits are counted; the share of hits that the filter's fill would give
by chance is taken off, and the language with the most is the prediction.

N-grams are 4 bytes of the lower-cased text in which all but letters counts as one space; a space may
stand first or last only. A language contains an n-gram if it is in LEAST_SHARE of its learned texts.

Defined cases: text that is null or without a letter is "und" with score 0. A text whose letters give no
n-gram at all, or no language any hit, gets the language learned from most texts, with score 0. Ties go
to the language first in the alphabet. With nothing to learn from, all is "und". Very long texts are read
whole. Repeated rows are predicted each; identify() passes other columns through, but for the text and
columns named lang_pred and score, which it replaces.
"""
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import chunks, mixed
from .common import crc_mod

#: Texts per language that are learned from, about: the bound of the sample.
SAMPLE_PER_LANGUAGE = 1500
HASHES, SLOT_BITS = 3, 20
#: Labels that are learned at most: each 64 take 8 MB of the table, so this bounds it to 256 MB.
LANGUAGES = 2048
#: Codes of a language that are held before equal ones are counted.
PENDING = 1 << 20
LEAST_SHARE, LEAST_TEXTS = 0.004, 2

#: ASCII letters and all bytes of longer characters stay; the rest is space.
_KEEP = np.full(256, 32, np.uint8)
for _b in [*range(97, 123), *range(128, 256)]:
    _KEEP[_b] = _b


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of lower-cased texts, and of each text the number of codes before it."""
    n = len(offsets) - 1
    # one space before each text and one behind the last
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    b = np.full(len(data) + n + 1, 32, np.uint8)
    b[np.arange(len(data)) + text_of + 1] = _KEEP[data]
    if len(b) < 4:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    letter = b != 32
    valid = np.flatnonzero(letter[1:-2] & letter[2:-1])
    w = b.astype(np.uint32)
    codes = w[valid] | w[valid + 1] << 8 | w[valid + 2] << 16 | w[valid + 3] << 24
    return codes, np.searchsorted(valid, offsets + np.arange(n + 1))


def slots(codes: np.ndarray) -> list[np.ndarray]:
    h = mixed(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return [((h >> np.uint64(SLOT_BITS * k)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    chance: np.ndarray
    usual: int

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of lower-cased texts: index of the language, score."""
        best, score = [], []
        for _, _, data, offsets in chunks(column):
            codes, at = grams(data, offsets)
            n = np.diff(at).astype(float)
            hits = np.empty((len(n), len(self.languages)))
            places = slots(codes)
            bits = 8 * self.table.itemsize
            for word in range(self.table.shape[1]):
                found = self.table[places[0], word]
                for s in places[1:]:
                    found &= self.table[s, word]
                for k in range(word * bits, min((word + 1) * bits, len(self.languages))):
                    total = np.concatenate([[0], np.cumsum((found >> found.dtype.type(k % bits)) & found.dtype.type(1), dtype=np.int64)])
                    hits[:, k] = total[at[1:]] - total[at[:-1]]
            true = np.maximum(0, (hits - n[:, None] * self.chance) / (1 - self.chance))
            top = true.argmax(axis=1)
            most = true.max(axis=1)
            top[most <= 0] = self.usual
            best.append(top)
            score.append(np.clip(most / np.maximum(n, 1), 0, 1))
        return (np.concatenate(best), np.concatenate(score)) if best else (np.zeros(0, int), np.zeros(0))


class Learner:
    """Counts, text by text, in how many texts of a language an n-gram is."""

    def __init__(self):
        self.texts: dict[str, int] = {}
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.pending: dict[str, list[np.ndarray]] = {}

    def add(self, lang: str, text: str) -> None:
        """A lower-cased text."""
        self.texts[lang] = self.texts.get(lang, 0) + 1
        for _, _, data, offsets in chunks(pa.array([text], pa.string())):
            self.pending.setdefault(lang, []).append(np.unique(grams(data, offsets)[0]))
        if sum(map(len, self.pending.get(lang, ()))) > PENDING:
            self.counted(lang)

    def counted(self, lang: str) -> tuple[np.ndarray, np.ndarray]:
        """The language's n-grams and how many texts have each."""
        codes, n = self.known.get(lang, (np.zeros(0, np.uint32), np.zeros(0, np.int64)))
        new = self.pending.pop(lang, [])
        every, place = np.unique(np.concatenate([codes, *new]), return_inverse=True)
        weights = np.concatenate([n, np.ones(sum(map(len, new)), np.int64)])
        self.known[lang] = every.astype(np.uint32), np.bincount(place, weights, len(every)).astype(np.int64)
        return self.known[lang]

    def kept(self, lang: str) -> np.ndarray:
        """The n-grams that the language contains."""
        codes, n = self.counted(lang)
        return codes[n >= max(min(LEAST_TEXTS, self.texts[lang]), LEAST_SHARE * self.texts[lang])]

    def model(self) -> "Model | None":
        names = sorted(self.texts)
        if not names:
            return None
        bits = next((b for b in (8, 16, 32) if b >= len(names)), 64)
        kind = np.dtype(f"u{bits // 8}")
        table = np.zeros((1 << SLOT_BITS, -(-len(names) // bits)), kind)
        for k, name in enumerate(names):
            for s in slots(self.kept(name)):
                table[s, k // bits] |= kind.type(1 << k % bits)
        fill = np.array([((table[:, k // bits] >> kind.type(k % bits)) & kind.type(1)).mean() for k in range(len(names))])
        return Model(names, table, np.minimum(fill**HASHES, 0.999), max(range(len(names)), key=lambda k: self.texts[names[k]]))


def learn(docs: DataFrame, text: str, lang: str, pick, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """A model from about per_language of the rows of each language in docs, chosen by the hash of pick."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.lower(text).alias("text"), F.col(lang).alias("lang"), F.pmod(F.xxhash64(pick), F.lit(1 << 20)).alias("h"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if not counts:
        return None
    if len(counts) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    least = F.create_map(*(F.lit(x) for name, n in sorted(counts.items()) for x in (name, int((1 << 20) * min(1.0, per_language / n)))))
    keep = F.col("h") < F.element_at(least, F.col("lang"))
    learner = Learner()
    for r in known.filter(keep).select("lang", "text").toLocalIterator():
        learner.add(r["lang"], r["text"])
    return learner.model()


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs' columns with lang_pred and score."""
    if model is None:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            top, score = m.predict(b.column(b.num_columns - 2))
            some = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            names = np.array([*m.languages, "und"], object)[np.where(some, top, len(m.languages))]
            yield pa.record_batch([*b.columns[:-2], pa.array(names, pa.string()), pa.array(np.where(some, score, 0.0))], [*own, "lang_pred", "score"])

    ready = docs.select(*own, F.lower(text).alias("__text"), has_letter.alias("__some"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in own)
    return ready.mapInArrow(run, f"{schema}, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that aren't held out."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang").withColumn("held_out", crc_mod(F.col("doc_id"), 3) == 1)
    model = learn(rows.filter(~F.col("held_out")), "text", "lang", F.col("doc_id"))
    return identify(rows.select("doc_id", "held_out", "text"), model)
