"""Scores of triples and of all entities: column expressions, and blocks of NumPy in Arrow batches."""
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predictors import ConvE, Predictor

#: Rows of a block of vectors: a product of two blocks of 64 doubles takes 2 MB in and 32 MB between.
BLOCK = 2048
#: Shares that the tails of best_products() are dealt in, and tails a share beyond which there are more: a task
#: holds those of one, 128 MB of 64 doubles each.
PARTS, PART = 4, 1 << 18


def constraint_scores(rows: DataFrame, entities: DataFrame, relations: DataFrame, p: Predictor) -> DataFrame:
    """rows(h, r, neg and either t or none) with score; without t every entity is scored. A negated
    constraint has the negative score."""
    heads = entities.select(F.col("id").alias("h"), F.col("emb").alias("eh"))
    rels = relations.select(F.col("id").alias("r"), F.col("emb").alias("er"))
    tails = entities.select(F.col("id").alias("t"), F.col("emb").alias("et"))
    both = rows.join(heads, "h").join(rels, "r")
    # without tails all entities are asked for: the product is the result
    both = both.join(tails, "t") if "t" in rows.columns else both.crossJoin(tails)
    s = p.score(F.col("eh"), F.col("er"), F.col("et"))
    return both.select(*rows.columns, *([] if "t" in rows.columns else ["t"]), F.when(F.col("neg"), -s).otherwise(s).alias("score"))


def rankings(queries: DataFrame, entities: DataFrame, p: float = 2) -> DataFrame:
    """query_id, entity_id, rank (from 0) by distance of queries(query_id, emb) to every entity."""
    from ..functions.predictors import norm, sub

    all_pairs = queries.select("query_id", F.col("emb").alias("q")).crossJoin(entities.select(F.col("id").alias("entity_id"), "emb"))  # the result is all pairs
    scored = all_pairs.select("query_id", "entity_id", F.round(-norm(sub(F.col("q"), F.col("emb")), p), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id")
    return scored.select("query_id", "entity_id", "score", (F.row_number().over(w) - 1).alias("rank"))


def blocks(rows: DataFrame, columns: list[str], size: int, prefix: str) -> DataFrame:
    """Rows of numbers and of vectors (column emb last) packed into matrices of `size` rows at most, as bytes:
    one row a block, of vectors of one length. Nothing moves between partitions."""
    names = [f"{prefix}{c}" for c in [*columns, "emb"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), size):
                part = b.iloc[i : i + size]
                for _, same in part.groupby(part["emb"].map(len)):
                    yield pd.DataFrame({n: [np.stack(same[c].to_numpy()).tobytes()] for n, c in zip(names, [*columns, "emb"])})

    return rows.select(*columns, "emb").mapInPandas(run, ", ".join(f"{n} binary" for n in names))


def top_tails(rows: DataFrame, entities: DataFrame, k: int, size: int = BLOCK) -> DataFrame:
    """rows(query_id, emb: an estimated tail): query_id, entity_id, score, rank of the k entities with
    the largest products. Blocks of queries meet blocks of entities, whatever the number of either; only the k
    best of each block leave the worker. Ties go to the smaller id."""
    q = blocks(rows.select(F.col("query_id").cast("long"), F.col("emb").cast("array<double>")), ["query_id"], size, "q_")
    e = blocks(entities.select(F.col("id").cast("long"), F.col("emb").cast("array<double>")), ["id"], size, "e_")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q_id, q_emb, e_id, e_emb in zip(b["q_query_id"], b["q_emb"], b["e_id"], b["e_emb"]):
                queries, ids = np.frombuffer(q_id, np.int64), np.frombuffer(e_id, np.int64)
                by_id = np.argsort(ids, kind="stable")
                s = np.round(np.frombuffer(q_emb).reshape(len(queries), -1) @ np.frombuffer(e_emb).reshape(len(ids), -1)[by_id].T, 6)
                m = min(k, len(ids))
                # all that reach the k-th largest score, then the first k of them by score and id
                least = -np.partition(-s, m - 1, axis=1)[:, m - 1 : m]
                row, col = np.nonzero(s >= least)
                order = np.lexsort((col, -s[row, col], row))
                row, col = row[order], col[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[place < m], col[place < m]
                yield pd.DataFrame({"query_id": queries[row], "entity_id": ids[by_id][col], "score": s[row, col]})

    # the product of blocks, of a stated set of queries, is what is asked for
    best = q.crossJoin(e).mapInPandas(run, "query_id long, entity_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id")
    return best.withColumn("rank", (F.row_number().over(w) - 1).cast("long")).filter(F.col("rank") < k)


def raise_in_order(best: np.ndarray, x: np.ndarray, t: np.ndarray, row: np.ndarray, col: np.ndarray) -> None:
    """best[col] becomes the product of x[row] and t[col] where that is larger; its terms are added up in the order of
    places, as predictors.total() does."""
    for i in range(0, len(row), 1 << 12):
        some_x, some_t = x[row[i : i + (1 << 12)]], t[col[i : i + (1 << 12)]]
        total = np.zeros(len(some_x))
        for k in range(x.shape[1]):
            total += some_x[:, k] * some_t[:, k]
        np.maximum.at(best, col[i : i + (1 << 12)], total)


def largest_products(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For each row of t its largest product with a row of x, its terms added up in the order of places: a matrix
    product finds the rows that may be largest, which are added up again."""
    x = np.unique(x, axis=0)  # copies would all be largest
    s = x @ t.T
    best = s.max(axis=0)
    with np.errstate(invalid="ignore", over="ignore"):
        # either order of a sum is off by this / 4 at most
        off = 4 * x.shape[1] * np.finfo(float).eps * np.linalg.norm(x, axis=1).max() * np.linalg.norm(t, axis=1)
        sure = ~np.isfinite(best) | ~np.isfinite(off)
        row, col = np.nonzero((s >= best - off) & ~sure)
    out = np.where(sure, best, -np.inf)
    raise_in_order(out, x, t, row, col)
    return out


class Best:
    """For each row of t its largest product with the rows of all blocks x that add() was given, as largest_products()
    has it. Products in floats are enough to leave out what is surely not larger than the best so far."""

    #: Norms between which neither floats, of vectors that are scaled to about 1, nor doubles leave their range.
    RANGE = (1e-140, 1e140)
    #: Rows of x and of t that are multiplied at once: their products are 4 MB of floats, which a cache may hold.
    ROWS, COLS = 512, 2048
    #: Rows of x for a row of t, on average, that floats may leave in doubt; doubles decide about more.
    DOUBTS = 8

    def __init__(self, t: np.ndarray):
        self.best = np.full(len(t), -np.inf)
        with np.errstate(invalid="ignore", over="ignore"):
            size = np.linalg.norm(t, axis=1)
            fit = (size > self.RANGE[0]) & (size < self.RANGE[1])
        self.fit, self.odd = np.nonzero(fit)[0], np.nonzero(~fit)[0]
        self.t, size = t[self.fit], size[self.fit]
        # those that don't fit may be many, as vectors of zeros, and alike
        self.others, self.alike = np.unique(t[self.odd], axis=0, return_inverse=True) if len(self.odd) else (None, None)
        # by powers of two, so that nothing but the floats' own rounding is lost
        self.scale = np.exp2(-np.frexp(size)[1].astype(float))
        self.floats, self.size = (self.t * self.scale[:, None]).astype(np.float32), size * self.scale

    def add(self, x: np.ndarray) -> None:
        if len(self.odd):
            self.best[self.odd] = np.maximum(self.best[self.odd], largest_products(x, self.others)[self.alike.reshape(-1)])
        if len(self.fit):
            self.best[self.fit] = self.raised(self.best[self.fit], x)

    def raised(self, best: np.ndarray, x: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", over="ignore"):
            most = np.sqrt(np.einsum("ij,ij->i", x, x).max())
        if not self.RANGE[0] < most < self.RANGE[1]:
            return np.maximum(best, largest_products(x, self.t))
        scale = np.exp2(-float(np.frexp(most)[1]))
        floats = (x * scale).astype(np.float32)
        # a product in floats is off by half of this at most, in whatever order it is added up
        off = 2 * (x.shape[1] + 4) * np.finfo(np.float32).eps * (most * scale) * self.size
        for j in range(0, len(best), self.COLS):
            part = slice(j, j + self.COLS)
            for i in range(0, len(x), self.ROWS):
                s = floats[i : i + self.ROWS] @ self.floats[part].T
                top = s.max(axis=0)
                # only a row that may be the largest here and larger than the best so far counts
                least = np.maximum(top, best[part] * (scale * self.scale[part])) - off[part]
                at = np.nonzero(top >= least)[0]
                row, col = np.nonzero((s if len(at) == len(top) else s[:, at]) >= least[at])
                if len(row) > self.DOUBTS * len(at):
                    best[j + at] = np.maximum(best[j + at], largest_products(x[i : i + self.ROWS], self.t[j + at]))
                else:
                    raise_in_order(best, x, self.t, i + row, j + at[col])
        return best


def tail_blocks(tails: DataFrame, size: int) -> DataFrame:
    """tails(r, emb) as blocks() packs them, each of one r and without copies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (r, _), same in b.groupby(["r", b["emb"].map(len)]):
                x = np.unique(np.stack(same["emb"].to_numpy()), axis=0)
                for i in range(0, len(x), size):
                    yield pd.DataFrame({"q_r": [r], "q_n": [len(x[i : i + size])], "q_emb": [x[i : i + size].tobytes()]})

    return tails.mapInPandas(run, "q_r long, q_n long, q_emb binary")


def best_products(tails: DataFrame, entities: DataFrame, size: int = 2 * BLOCK) -> DataFrame:
    """tails(r, emb) and entities(id, emb) as r, entity_id, score: the largest product of an entity's vector
    with one of the tails of r, by blocks. A task passes the blocks of tails that it holds over one block of entities
    after the other, and only the largest products leave it: PARTS rows an entity, and one more for each PART tails
    beyond. No row where there is no product, as of vectors that are null, have nulls, or differ in length."""
    whole = lambda rows, c: rows.select(F.col(c).cast("long"), F.col("emb").cast("array<double>").alias("emb")).filter(F.col(c).isNotNull() & F.col("emb").isNotNull() & ~F.exists("emb", F.isnull))
    cores, n = tails.sparkSession.sparkContext.defaultParallelism, tails.count()
    # few partitions make full blocks; these are packed once and dealt, whatever they meet
    few = max(cores, -(-n // size))
    q = tail_blocks(whole(tails, "r").coalesce(few), size).repartition(max(PARTS, -(-n // PART)))
    e = blocks(whole(entities, "id").coalesce(few), ["id"], size, "e_").repartition(2 * cores)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done() -> Iterator[pd.DataFrame]:
            for r, best in found.items():
                yield pd.DataFrame({"r": r, "entity_id": ids, "score": best.best})

        now, ids, found = None, None, {}
        for b in batches:
            for q_r, q_n, q_emb, e_id, e_emb in zip(b["q_r"], b["q_n"], b["q_emb"], b["e_id"], b["e_emb"]):
                if now != (e_id, e_emb):
                    yield from done()
                    now, ids, found = (e_id, e_emb), np.frombuffer(e_id, np.int64), {}
                    t = np.frombuffer(e_emb).reshape(len(ids), -1)
                x = np.frombuffer(q_emb).reshape(q_n, -1)
                if x.shape[1] == t.shape[1]:
                    if q_r not in found:
                        found[q_r] = Best(t)
                    found[q_r].add(x)
        yield from done()

    # the product of blocks is what is asked for: every tail with every entity; it goes by entities, also if few
    best = e.hint("shuffle_replicate_nl").crossJoin(q).mapInPandas(run, "r long, entity_id long, score double")
    return best.groupBy("r", "entity_id").agg(F.max("score").alias("score"))


def conve_scores(rows: DataFrame, model: ConvE) -> DataFrame:
    """rows(h, r, t, eh, er, et) as h, r, t, score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                vec = [np.stack(b[c].to_numpy()) for c in ("eh", "er", "et")]
                yield b[["h", "r", "t"]].assign(score=model.score(*vec))

    return rows.mapInPandas(run, "h long, r long, t long, score double")
