"""Link predictors as column expressions over arrays of doubles.

score() is each model's own value; rank_sign says whether more or less is better. tail() and head()
estimate the other end's vector. distance norms are p-norms.
"""
from dataclasses import dataclass, field
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Column


def total(x: Vec) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def add(a: Vec, b: Vec) -> Vec:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Vec, b: Vec) -> Vec:
    return F.zip_with(a, b, lambda x, y: x - y)


def mul(a: Vec, b: Vec) -> Vec:
    return F.zip_with(a, b, lambda x, y: x * y)


def dot(a: Vec, b: Vec) -> Column:
    return total(mul(a, b))


def norm(x: Vec, p: float = 2) -> Column:
    if p == 1:
        return total(F.transform(x, F.abs))
    if p == 2:
        return F.sqrt(total(F.transform(x, lambda v: v * v)))
    return F.pow(total(F.transform(x, lambda v: F.pow(F.abs(v), F.lit(float(p))))), F.lit(1.0 / p))


def cosine(a: Vec, b: Vec) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def halves(x: Vec, n: int) -> tuple[Vec, Vec]:
    return F.slice(x, 1, n), F.slice(x, n + 1, n)


@dataclass(frozen=True)
class Predictor:
    name: str
    score: Callable[[Vec, Vec, Vec], Column]
    tail: Callable[[Vec, Vec], Vec]
    head: Callable[[Vec, Vec], Vec] | None = None
    rank_sign: int = 1
    #: Where rank_sign times the score is the product of tail() and a part of the other end's vector: that part.
    factor: Callable[[Vec], Vec] | None = None


def transe(p: float = 2) -> Predictor:
    return Predictor("transe", lambda h, r, t: -norm(sub(add(h, r), t), p), add, lambda t, r: sub(t, r))


def distmult() -> Predictor:
    """The score is the negated product sum, as its contract has it: less is better."""
    return Predictor("distmult", lambda h, r, t: -total(mul(mul(h, r), t)), mul, mul, rank_sign=-1, factor=lambda t: t)


def complex_(dim: int) -> Predictor:
    def tail(h: Vec, r: Vec) -> Vec:
        (a, b), (c, d) = halves(h, dim), halves(r, dim)
        return F.concat(sub(mul(a, c), mul(b, d)), add(mul(a, d), mul(b, c)))

    return Predictor("complex", lambda h, r, t: dot(tail(h, r), t), tail, factor=lambda t: t)


def cubic_penalty(x: Vec, dim: int) -> Column:
    """Sum of cubed moduli."""
    a, b = halves(x, dim)
    return total(F.zip_with(a, b, lambda u, v: F.pow(F.sqrt(u * u + v * v), F.lit(3.0))))


def rotate(dim: int, inverse: bool = False) -> Predictor:
    """The score is the distance: less is better. head() turns the same way as tail(), unless inverse
    asks for the true inverse turn. The first half of a relation's vector are its angles."""

    def turned(x: Vec, r: Vec, sign: int = 1) -> Vec:
        (a, b), w = halves(x, dim), F.transform(F.slice(r, 1, dim), lambda v: v * sign)
        c, s = F.transform(w, F.cos), F.transform(w, F.sin)
        return F.concat(sub(mul(a, c), mul(b, s)), add(mul(a, s), mul(b, c)))

    return Predictor("rotate", lambda h, r, t: norm(sub(turned(h, r), t)), turned, lambda t, r: turned(t, r, -1 if inverse else 1), rank_sign=-1)


def swtranse(dim: int, particles: int, p: float = 2) -> Predictor:
    """Sliced Wasserstein: entities have `particles` values for each of dim dimensions, relations one, which
    moves them all; the particles of each dimension are sorted before they are compared."""
    block = lambda x, d: F.array_sort(F.slice(x, d * particles + 1, F.lit(particles)))
    spread = lambda r: F.flatten(F.transform(F.slice(r, 1, dim), lambda v: F.array_repeat(v, particles)))
    moved = lambda h, r: add(h, spread(r))

    def score(h: Vec, r: Vec, t: Vec) -> Column:
        m = moved(h, r)
        return -total(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: norm(sub(block(m, d), block(t, d)), p)))

    return Predictor("swtranse", score, moved, lambda t, r: sub(t, spread(r)))


def relation_estimate(h: Vec, t: Vec) -> Vec:
    return sub(t, h)


def rescal(dim: int) -> Predictor:
    """Bilinear: a relation is a matrix, row after row."""
    cell = lambda m, i, j: F.get(m, i * dim + j)
    index = lambda: F.sequence(F.lit(0), F.lit(dim - 1))
    tail = lambda h, r: F.transform(index(), lambda j: total(F.transform(index(), lambda i: F.get(h, i) * cell(r, i, j))))
    head = lambda t, r: F.transform(index(), lambda i: total(F.transform(index(), lambda j: cell(r, i, j) * F.get(t, j))))
    return Predictor("rescal", lambda h, r, t: dot(tail(h, r), F.slice(t, 1, dim)), tail, head, factor=lambda t: F.slice(t, 1, dim))


@dataclass(frozen=True)
class ConvE:
    """Convolutional scorer, inference only: batch norms (without scale and shift) use running means and
    variances, nothing is dropped out. Vectors have one leading bias and height * width further values; a
    head's grid stands on top of the relation's. Weights are NumPy arrays: kernels [channels, k, k] and
    their biases, dense [channels * rows * columns, height * width] and its bias."""

    width: int
    height: int
    kernels: object
    kernel_bias: object
    dense: object
    bias: object
    #: (mean, variance) by channel and by output.
    norm_channels: tuple
    norm_outputs: tuple
    stride: int = 1
    padding: int = 0
    size: int = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "size", self.width * self.height + 1)
        shape = (self.kernels.shape[0] * self.outputs(2 * self.height) * self.outputs(self.width), self.size - 1)
        if self.dense.shape != shape:
            raise ValueError(f"dense weights of {self.dense.shape}, not {shape}")

    def outputs(self, n: int) -> int:
        """Places of the kernel along n values."""
        return (n - self.kernels.shape[1] + 2 * self.padding) // self.stride + 1

    def tail(self, h, r):
        """Estimated tails of rows of heads and relations: NumPy arrays [rows, size]."""
        import numpy as np

        normed = lambda x, mean, var: (x - mean) / np.sqrt(var + 1e-5)
        grid = lambda x: x[:, 1:].reshape(-1, self.height, self.width)
        x = np.pad(np.concatenate([grid(h), grid(r)], axis=1), ((0, 0), *[(self.padding, self.padding)] * 2))
        windows = np.lib.stride_tricks.sliding_window_view(x, self.kernels.shape[1:], axis=(1, 2))[:, :: self.stride, :: self.stride]
        conv = np.einsum("bijkl,nkl->bnij", windows, self.kernels) + self.kernel_bias[:, None, None]
        conv = np.maximum(normed(conv, *(v[:, None, None] for v in self.norm_channels)), 0)
        out = np.maximum(normed(conv.reshape(len(x), -1) @ self.dense + self.bias, *self.norm_outputs), 0)
        return np.hstack([np.ones((len(x), 1)), out])

    def score(self, h, r, t):
        return (self.tail(h, r) * t).sum(axis=1)

    @classmethod
    def seeded(cls, dim: int, aspect: int = 2, channels: int = 32, filter_size: int = 3, stride: int = 1, padding: int = 0, seed: int = 0) -> "ConvE":
        """Random weights and running statistics; the grid is `aspect` times as wide as high."""
        import numpy as np

        height = int(((dim - 1) / aspect) ** 0.5)
        if height * height * aspect != dim - 1:
            raise ValueError("the dimension isn't 1 + aspect * height^2")
        g, width = np.random.default_rng(seed), height * aspect
        places = lambda n: (n - filter_size + 2 * padding) // stride + 1
        flat = channels * places(2 * height) * places(width)
        small = lambda *n: g.normal(0, 0.1, n)
        stats = lambda n: (small(n), g.uniform(0.5, 1.5, n))
        return cls(width, height, small(channels, filter_size, filter_size), small(channels), small(flat, dim - 1), small(dim - 1), stats(channels), stats(dim - 1), stride, padding)


def initial_vectors(spark, n: int, width: int, kind: str = "xavier", scale: float = 1.0, seed: int = 0):
    """id, emb of n vectors: Xavier's uniform or standard normal values, times scale. A value hangs on seed,
    id and place only, however the rows are dealt."""
    if kind not in ("xavier", "normal"):
        raise ValueError(f"no distribution {kind!r}")
    uniform = lambda i, k: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i, F.lit(k)), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    if kind == "xavier":
        reach = (6.0 / (n + width)) ** 0.5
        value = lambda i: (uniform(i, 0) * 2 - 1) * (reach * scale)
    else:
        value = lambda i: F.sqrt(F.ln(uniform(i, 0)) * -2) * F.cos(uniform(i, 1) * 6.283185307179586) * scale
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), value).alias("emb"))


#: Width of entity and relation vectors by dimension, and how they begin.
INITIAL = {
    "transe": (lambda d: (d, d), "xavier", 1.0),
    "distmult": (lambda d: (d, d), "xavier", 1.0),
    "rescal": (lambda d: (d, d * d), "xavier", 1.0),
    "conve": (lambda d: (d, d), "xavier", 1.0),
    "complex": (lambda d: (2 * d, 2 * d), "normal", 1.0),
    "rotate": (lambda d: (2 * d, d), "normal", 1e-3),
}


def initial(spark, name: str, entities: int, relations: int, dim: int, particles: int = 1, seed: int = 0):
    """Entity and relation vectors (id, emb) that a predictor starts from."""
    if name == "swtranse":
        return initial_vectors(spark, entities, dim * particles, seed=seed), initial_vectors(spark, relations, dim, seed=seed + 1)
    if name not in INITIAL:
        raise ValueError(f"no predictor {name!r}")
    widths, kind, scale = INITIAL[name]
    e, r = widths(dim)
    return initial_vectors(spark, entities, e, kind, scale, seed), initial_vectors(spark, relations, r, kind, scale, seed + 1)


def get(name: str, **config) -> Predictor | ConvE:
    makers = {"transe": transe, "distmult": distmult, "complex": complex_, "rotate": rotate, "swtranse": swtranse, "rescal": rescal, "conve": ConvE.seeded}
    if name.lower() not in makers:
        raise ValueError(f"no predictor {name!r}")
    return makers[name.lower()](**config)
