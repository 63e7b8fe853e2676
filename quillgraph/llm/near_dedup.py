r"""Near-duplicate classes by SetSketch registers.

A text's set holds 64-bit hashes of its distinct 5-word shingles. Each of REGISTERS registers keeps the
minimum of exponential variates of the set's elements, on a scale of powers of BASE, truncated to a byte:
registers of a union are the maxima, and two sets agree in a register with about their similarity.

1. Rows with equal sets (128-bit digests) become one node.
2. BANDS bands of ROWS registers are hashed; nodes that share a band's key share a bucket.
3. Every member of a bucket is paired with the bucket's least node only, so pairs grow with the rows and
   not with the squares of groups. A pair's similarity is estimated by maximum likelihood over its
   registers jointly, with both set sizes known; pairs far below the threshold go, the others are
   verified on their full sets.
4. Verified links are contracted to components; only pairs across components still matter. In buckets
   that hold several, each member's shingles that no other such member has are counted. What a pair has
   in common is bounded by the rest of either set, and so is its similarity.
5. Every member of such a bucket is paired with the one that shares most of its set (the centre of a
   group of edited copies), and links are contracted again. Last, what remains is compared across
   components. By the bound the smaller set of a pair must have a share of 2t / (1 + t) in common with
   others, so the many copies of a page whose edits are all their own drop out one by one, before any two
   meet. The others meet in cells of CELL by CELL members, so that no task gets a large bucket whole;
   pairs that the bound lets through, also where it is taken for each of PARTS parts of the sets by
   itself, are estimated and verified. A bucket takes at most (members outside its largest
   component) times (members) comparisons of counts, and only such as have a set that may be the smaller.

So components are those of all candidate pairs, and hardly any pair below the threshold is tested on full
sets. Elements are hashes of 64 bits: two sets of a million elements that share none seem to share one in
about 2 of 10^8 cases, and one element changes no verdict but that of a pair exactly at the threshold.

At similarity 0.85 a pair shares no bucket with probability (1 - 0.85^6)^36, 4 in 10^8; at 0.8, 2 in 10^5.

Defined cases: a text without words, or null, has the empty set and is linked with nothing; with fewer
words than a shingle the whole sequence is its one element. Rows that share a doc_id are one document:
links of any of them count for all. Rows without a doc_id take part, and get their component's least id,
or null where none has an id. Ties of main components and centres go to the larger node number, which no
result hangs on. Very long texts are read whole, each by itself. Other columns are not read, and
deduplicated() passes them through.
"""
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_np import chunks, mixed, span_hashes, word_spans
from .common import fresh, stored

SHINGLE = 5
BANDS, ROWS = 36, 6
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.1, 20.0, 255
#: How far below the threshold an estimate may lie before the pair goes: five standard errors.
MARGIN = 0.12
#: Parts that sets are divided into by hash, to bound what two of them share part by part.
PARTS = 128
#: Ids of 8 bytes up to which a list of documents is broadcast rather than shuffled with the texts.
BROADCAST_IDS = 500_000
#: Members of a bucket on either side of a cell in which they are compared.
CELL = 2000
#: Links (16 bytes each) up to which one task labels components; rounds of joins over all executors beyond.
TASK_LINKS = 1_000_000
#: A set is common from so many copies on, and from so large a share of all rows: at most HOT_SHARE sets are.
HOT_COPIES, HOT_SHARE = 10_000, 10_000

_draw = np.random.default_rng(20240229)
_XOR = _draw.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_MUL = _draw.integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_MIX = _draw.integers(0, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = _LOWER[data]
    starts, ends, before = word_spans(_SPACE[data], offsets)
    w = span_hashes(data, starts, ends)
    n = len(w) - SHINGLE + 1
    h = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for k in range(SHINGLE):
            h += w[k : n + k] * _MIX[k]
        h = mixed(h)
    out = []
    for a, b in zip(before[:-1], before[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(h[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mixed((w[a:b] * _MIX[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """sets x REGISTERS; the empty set has zeros."""
    out = np.zeros((len(sets), REGISTERS), np.uint8)
    full = [k for k, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        some, size = [], 0
        while at < len(full) and (not some or size < 1 << 16):
            some.append(full[at])
            size += len(sets[full[at]])
            at += 1
        x = (np.concatenate([sets[k] for k in some]) >> np.uint64(32)).astype(np.uint32)
        first = np.concatenate([[0], np.cumsum([len(sets[k]) for k in some])[:-1]])
        least = np.empty((REGISTERS, len(some)), np.uint32)
        v = np.empty_like(x)
        for i in range(REGISTERS):
            np.bitwise_xor(x, _XOR[i], out=v)
            np.multiply(v, _MUL[i], out=v)
            least[i] = np.minimum.reduceat(v, first)
        exponential = -np.log1p(-(least + 0.5) / 2**32) / RATE
        out[some] = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype(np.uint8).T
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


_GRID = np.linspace(0, 1, 101)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarities of pairs of register rows, by likelihood over a grid of values."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * _GRID), p(v - u * _GRID)
    tiny = 1e-12
    like = more[:, None] * np.log(np.maximum(up, tiny)) + less[:, None] * np.log(np.maximum(down, tiny)) + same[:, None] * np.log(np.maximum(1 - up - down, tiny))
    like[_GRID[None, :] > np.minimum(u / v, v / u) + 1e-9] = -np.inf
    return _GRID[like.argmax(axis=1)]


def text_sets(docs: DataFrame, text: str) -> DataFrame:
    """key (SHA-256 of the text), set (digest of its set) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                keys = [hashlib.sha256(data[a:e]).hexdigest() for a, e in zip(offsets, offsets[1:])]
                sets = [hashlib.sha256(s.tobytes()).digest()[:16] for s in shingle_sets(data, offsets)]
                yield pa.record_batch([pa.array(keys, pa.string()), pa.array(sets, pa.binary())], ["key", "set"])

    return docs.select(text).mapInArrow(run, "key string, set binary")


def sketched(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, n, digest (of the set), regs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                sets = shingle_sets(data, offsets)
                regs = registers(sets)
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.sha256(s.tobytes()).digest()[:16] for s in sets], pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())],
                    ["doc_id", "n", "digest", "regs"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, digest binary, regs binary")


def full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """node, elements of the wanted nodes. A node's set is read off one document that has it: the one
    with the least id, and of rows that share this id those whose set has the node's digest."""
    own = stored(nodes.join(wanted, "node").select("node", F.col("first_id").alias("doc_id"), "digest"))
    # the digests of null ids can't be found by id; such documents are looked up by a join on nulls
    few = own.count() <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    ids = own.select("doc_id").distinct()
    rows = rows.join(F.broadcast(ids) if few else ids, rows["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                sets = shingle_sets(data, offsets)
                yield pa.record_batch([pa.array([hashlib.sha256(s.tobytes()).digest()[:16] for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "elements"])

    sets = rows.select("text").mapInArrow(run, "digest binary, elements binary")
    slim = own.select("node", "digest")
    return sets.join(F.broadcast(slim) if few else slim, "digest").select("node", "elements").dropDuplicates(["node"])


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and registers don't rule the similarity out."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in slices(batch):
                regs = [np.frombuffer(b"".join(x.column(k).to_pylist()), np.uint8).reshape(-1, REGISTERS) for k in (4, 5)]
                sizes = [x.column(k).to_numpy().astype(float) for k in (2, 3)]
                keep = estimate(*regs, *sizes) >= percent / 100 - MARGIN
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def _similar(x: pa.RecordBatch, a: int, b: int, percent: int, among: np.ndarray) -> list[bool]:
    """Of the rows in among, whether the sets in columns a and b are as similar as that."""
    keep = np.zeros(x.num_rows, bool)
    for i in among:
        s, t = (np.frombuffer(x.column(k)[int(i)].as_buffer(), np.uint64) for k in (a, b))
        both = len(np.intersect1d(s, t, assume_unique=True))
        keep[i] = 100 * both >= percent * (len(s) + len(t) - both)
    return keep


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("elements").alias(f"s{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = _similar(x, 2, 3, percent, np.arange(x.num_rows))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def tested(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """likely() and verified() in one pass, where registers and sets of all nodes are at hand:
    known(node, n, regs, elements)."""
    side = lambda x: known.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"), F.col("elements").alias(f"s{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in slices(batch):
                regs = [np.frombuffer(b"".join(x.column(k).to_pylist()), np.uint8).reshape(-1, REGISTERS) for k in (4, 5)]
                sizes = [x.column(k).to_numpy().astype(float) for k in (2, 3)]
                near = np.flatnonzero(estimate(*regs, *sizes) >= percent / 100 - MARGIN)
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(_similar(x, 6, 7, percent, near), pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "na", "nb", "ra", "rb", "sa", "sb").mapInArrow(run, "a long, b long")


def least_connected(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links u - v, ascending, and the least node that each is connected with."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    place = place.reshape(2, -1)
    least = np.arange(len(nodes))
    while True:
        # the larger of the labels at a link's ends is tied to the smaller; then labels follow labels to their end
        ends = least[place]
        if (ends[0] == ends[1]).all():
            return nodes, nodes[least]
        np.minimum.at(least, ends.max(axis=0), ends.min(axis=0))
        while (least[least] != least).any():
            least = least[least]


def components(links: DataFrame) -> DataFrame:
    """node, comp (the least node it is connected with) for the nodes of links(a, b) that aren't the least
    themselves. Up to TASK_LINKS links one task takes them all, because a round costs the driver as much for
    few links as for many."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    if edges.count() > TASK_LINKS:
        return contracted(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if read:
            nodes, least = least_connected(*map(np.concatenate, zip(*read)))
            other = nodes != least
            yield pa.record_batch([pa.array(nodes[other]), pa.array(least[other])], ["node", "comp"])

    return stored(edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, comp long"))


def contracted(edges: DataFrame) -> DataFrame:
    """components() of edges(u, v) with u > v by alternating star contractions, each round written out, until
    a round changes nothing."""
    mark = None
    while True:
        # large star: a node's larger neighbours are tied to its least neighbour
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and its smaller neighbours are tied to the least of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(tied.unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(r):
            break
        mark = tuple(r)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def labelled(members: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return members.withColumn("comp", F.col("node"))
    return members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def unsettled(members: DataFrame, comps: DataFrame) -> DataFrame:
    """key, band, node, leader, comp, main of the buckets of more than one component and two nodes; main: the
    component with the most members."""
    rows = labelled(members, comps)
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    keys = per.groupBy("key").agg(F.count("*").alias("comps"), F.sum("n").alias("size"), F.max(F.struct("n", "comp")).getField("comp").alias("main")).filter("comps > 1 and size > 2")
    return rows.join(keys.select("key", "main"), "key").select("key", "band", "node", "leader", "comp", "main")


def common_sizes(sets: DataFrame) -> DataFrame:
    """node, n, c, parts: how many elements a set has, how many of them some other set has too, and how
    many of those each of PARTS parts holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                elements = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
                node = np.repeat(part.column(0).to_numpy(), [len(e) for e in elements])
                yield pa.record_batch([pa.array(node), pa.array(np.concatenate(elements))], ["node", "element"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in slices(batch, 64):
                n, parts = [], []
                for elements, own in zip(x.column(1), x.column(2)):
                    e = np.frombuffer(elements.as_buffer(), np.int64)
                    common = np.setdiff1d(e, own.values.to_numpy(), assume_unique=True) if own.is_valid else e
                    n.append(len(e))
                    parts.append(np.bincount(common & (PARTS - 1), minlength=PARTS))
                yield pa.record_batch(
                    [x.column(0), pa.array(n, pa.int64()), pa.array([int(p.sum()) for p in parts], pa.int64()), pa.array([p.tolist() for p in parts], pa.list_(pa.int32()))],
                    ["node", "n", "c", "parts"],
                )

    own = sets.select("node", "elements").mapInArrow(run, "node long, element long").groupBy("element").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    # as many as the node's set has at most
    alone = own.filter("n = 1").groupBy("node").agg(F.collect_list("element").alias("alone"))
    return sets.join(alone, "node", "left").select("node", "elements", "alone").mapInArrow(count, "node long, n long, c long, parts array<int>")


def possible(x: str, y: str, percent: int):
    """Whether sets of nx and ny elements, of which cx and cy at most are in another set, can be as
    similar as that."""
    both = F.least(f"c{x}", f"c{y}")
    return 100 * both >= percent * (F.col(f"n{x}") + F.col(f"n{y}") - both)


def possible_by_parts(x: str, y: str, percent: int):
    """The same with a closer bound: no part holds more of the common elements than either set has there."""
    both = F.aggregate(F.zip_with(f"parts{x}", f"parts{y}", lambda p, q: F.least(p, q)), F.lit(0), lambda total, k: total + k)
    return 100 * both >= percent * (F.col(f"n{x}") + F.col(f"n{y}") - both)


def central(rows: DataFrame) -> DataFrame:
    """key, centre: the bucket's member with the largest part of its set in common with others."""
    return rows.groupBy("key").agg(F.max(F.struct((F.col("c") / F.col("n")).alias("part"), "node")).getField("node").alias("centre"))


def with_centre(rows: DataFrame, centres: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket's centre with its members in other components."""
    named = rows.join(centres, "key")
    middle = named.filter("node = centre").select("key", F.col("node").alias("y"), F.col("comp").alias("compy"), F.col("n").alias("ny"), F.col("c").alias("cy"))
    x = named.filter("node <> centre and node <> leader and centre <> leader").select("key", F.col("node").alias("x"), F.col("comp").alias("compx"), F.col("n").alias("nx"), F.col("c").alias("cx"))
    return x.join(middle, "key").filter(F.col("compx") != F.col("compy")).filter(possible("x", "y", percent)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def left_over(rows: DataFrame, centres: DataFrame, nodes: DataFrame, parts: DataFrame, percent: int) -> DataFrame | None:
    """Pairs of members of a bucket that are in different components and weren't tested with its least
    node or its centre; None where no such members meet. Of a pair, x has the smaller set (or, of equal
    ones, the smaller node); with nx <= ny, possible() asks for 2 * percent * nx <= (100 + percent) * cx.
    Members of the largest component are met by the others only. Nodes that share several buckets meet in
    the one of the first band in which their registers agree."""
    some = rows.join(centres, "key").filter("node <> leader and node <> centre").filter(100 * F.col("c") >= percent * F.col("n"))
    some = some.withColumn("smaller", (100 + percent) * F.col("c") >= 2 * percent * F.col("n")).withColumn("inner", F.col("comp") == F.col("main"))
    cells = lambda n: F.ceil(n / CELL).cast("int")
    counted = some.groupBy("key").agg(
        F.count_if(~F.col("inner")).alias("outer"), cells(F.count_if(F.col("smaller") & ~F.col("inner"))).alias("xo"), cells(F.count_if(F.col("smaller") & F.col("inner"))).alias("xi"),
        cells(F.count("*")).alias("ya"), cells(F.count_if(~F.col("inner"))).alias("yo"),
    ).filter("outer > 0 and xo + xi > 0").drop("outer")
    # read four times below
    some = stored(some.join(counted, "key").join(nodes.select("node", "regs"), "node").join(parts, "node"))
    if some.isEmpty():
        return None
    side = lambda x: [F.col("node").alias(x), F.col("comp").alias(f"comp{x}"), F.col("n").alias(f"n{x}"), F.col("c").alias(f"c{x}"), F.col("regs").alias(f"regs{x}"), F.col("parts").alias(f"parts{x}")]
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = lambda which, across, down: some.filter(which).filter(f"smaller and {across} > 0 and {down} > 0").select("key", "band", F.col("inner").alias("within"), *side("x"), own(across).alias("i"), every(down).alias("j"))
    y = lambda which, across, down: some.filter(which).filter(f"{across} > 0 and {down} > 0").select("key", F.lit(across == "xi").alias("within"), *side("y"), own(down).alias("j"), every(across).alias("i"))
    # x outside the largest component meets all, x inside it those outside
    xs = x("not inner", "xo", "ya").unionByName(x("inner", "xi", "yo"))
    ys = y("true", "xo", "ya").unionByName(y("not inner", "xi", "yo"))
    part = lambda regs, k: F.substring(regs, k * ROWS + 1, F.lit(ROWS))
    before = F.exists(F.slice(F.array(*map(F.lit, range(BANDS))), F.lit(1), F.col("band")), lambda k: part(F.col("regsx"), k) == part(F.col("regsy"), k))
    in_order = (F.col("nx") < F.col("ny")) | (F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y"))
    wanted = (F.col("compx") != F.col("compy")) & in_order & possible("x", "y", percent) & ~before & possible_by_parts("x", "y", percent)
    return xs.join(ys, ["key", "within", "i", "j"]).filter(wanted).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def classes(docs: DataFrame, percent: int = 80, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    out = _with_class(*_classed(docs, percent, text))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _with_class(rows: DataFrame, of_set: DataFrame) -> DataFrame:
    """doc_id, n, component_id (null where the set is empty) of every row. Copies of one text share a
    digest: common ones, of which there is a bounded number, are looked up where they are."""
    slim = rows.select("doc_id", "n", "digest")
    common = F.col("copies") > max(HOT_COPIES, rows.count() // HOT_SHARE)
    hot = F.broadcast(of_set.filter(common).select("digest", F.col("component_id").alias("hot_id"), F.lit(True).alias("is_hot")))
    own = slim.filter("n > 0").join(hot, "digest", "left")
    near = own.filter("is_hot").select("doc_id", "n", F.col("hot_id").alias("component_id"))
    far = own.filter("is_hot is null").select("doc_id", "n", "digest").join(of_set.filter(~common).select("digest", "component_id"), "digest", "left").select("doc_id", "n", "component_id")
    return near.unionAll(far).unionAll(slim.filter("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("component_id")))


def _classed(docs: DataFrame, percent: int, text: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, n, digest, regs of every row; digest, copies, component_id, comp of every set but the empty one."""
    rows = stored(sketched(docs, text))
    # rows that share an id are one document, so their nodes are tied below
    nodes = stored(
        rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id())
    )
    key = lambda k: F.xxhash64(F.lit(k), F.substring("regs", k * ROWS + 1, ROWS))
    bands = nodes.select("node", F.posexplode(F.array(*map(key, range(BANDS)))).alias("band", "key"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("leader")).filter("size > 1")
    members = stored(bands.join(buckets.select("key", "leader"), "key").select("key", "band", "node", "leader"))

    several = stored(rows.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("z")).filter("a <> z").select("doc_id"))
    same_id = rows.filter("n > 0").join(several, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(nodes.select("digest", "node"), "digest")
    shared = same_id.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("doc_id", "a")
    ties = same_id.join(shared, "doc_id").filter("node <> a").select("a", F.col("node").alias("b"))
    pairs = stored(likely(members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), nodes, percent))
    sets = stored(full_sets(docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), text))
    links = verified(pairs, sets, percent)
    links = stored(links if several.isEmpty() else links.unionAll(ties))
    comps = components(links)

    # each step is written out once and ends here where it finds nothing: what the driver plans and broadcasts
    # stays in its memory for a while
    rest = stored(unsettled(members, comps))
    if not rest.isEmpty():
        comps = _settled(rest, links, comps, docs, nodes, percent, text)
    of_node = labelled(nodes.select("node", "digest", "first_id", "copies"), comps)
    least = of_node.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    return rows, stored(of_node.join(least, "comp").select("digest", "copies", "component_id", "comp"))


def _settled(rest: DataFrame, links: DataFrame, comps: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int, text: str) -> DataFrame:
    """comps with the links among rest, the members of unsettled buckets."""
    known = stored(full_sets(docs, nodes, rest.select("node").distinct(), text).join(nodes.select("node", "n", "regs"), "node"))
    common = stored(common_sizes(known.select("node", "elements")))
    rest = stored(rest.join(common.select("node", "n", "c"), "node"))
    centres = stored(central(rest))
    pairs = stored(with_centre(rest, centres, percent))
    more = None if pairs.isEmpty() else stored(tested(pairs, known, percent))
    if more is not None and not more.isEmpty():
        links = links.unionAll(more)
        comps = components(links)
        now = stored(labelled(rest.drop("comp", "main"), comps))
        per = now.groupBy("key", "comp").agg(F.count("*").alias("members"))
        main = per.groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("members", "comp")).getField("comp").alias("main")).filter("comps > 1").select("key", "main")
        rest = now.join(main, "key")
    pairs = left_over(rest, centres, nodes, common.select("node", "parts"), percent)
    more = None if pairs is None else stored(tested(pairs, known, percent))
    return comps if more is None or more.isEmpty() else components(links.unionAll(more))


def deduplicated(docs: DataFrame, percent: int = 80, text: str = "text") -> DataFrame:
    """One document of each class: that with the least doc_id. Of rows that are equal in doc_id and text one
    stays; rows that share a doc_id and differ in text are one document and stay or go together. Rows
    without a doc_id go where their class has one; of a class without any, one row stays. Texts without
    words are no copies of anything and stay."""
    rows, of_set = _classed(docs, percent, text)
    gone = stored(_with_class(rows, of_set).filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct())
    few = gone.count() <= BROADCAST_IDS
    named = docs.filter(F.col("doc_id").isNotNull())
    out = named.join(F.broadcast(gone) if few else gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
    # rows with one id and one text: only where there are some are they brought together
    key, mark = fresh(docs, "__key"), fresh(docs, "__mark")
    row_key = F.xxhash64(F.col("doc_id"), F.col(text)), F.xxhash64(F.lit(1), F.col(text), F.col("doc_id"))
    again = rows.filter("n > 0 and doc_id is not null").groupBy("doc_id", "digest").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id").distinct()
    again = stored(again.withColumnRenamed("doc_id", key))
    if not again.isEmpty():
        few = again.count() <= BROADCAST_IDS
        some = out.join(F.broadcast(again) if few else again, F.col("doc_id").cast("long") == F.col(key), "left_semi")
        rest = out.join(F.broadcast(again) if few else again, F.col("doc_id").cast("long") == F.col(key), "left_anti")
        some = some.withColumns({key: row_key[0], mark: row_key[1]})
        worded = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        out = rest.unionByName(some.filter(worded).dropDuplicates([key, mark]).drop(key, mark)).unionByName(some.filter(~worded).drop(key, mark))
    nameless = docs.filter(F.col("doc_id").isNull())
    if nameless.isEmpty():
        return out.select(*docs.columns)
    return out.unionByName(_nameless(nameless, of_set, text)).select(*docs.columns)


def _nameless(docs: DataFrame, of_set: DataFrame, text: str) -> DataFrame:
    """Of docs without a doc_id those without words, and one for each class that no id is in."""
    digest, comp = fresh(docs, "__digest"), fresh(docs, "__comp")
    worded = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.filter(worded).withColumn(digest, F.sha2(F.col(text), 256))
    found = text_sets(docs.filter(worded), text).distinct()
    free = found.join(of_set.filter("component_id is null").select(F.col("digest").alias("set"), F.col("comp").alias(comp)), "set")
    chosen = stored(free.groupBy(comp).agg(F.min("key").alias(digest)).select(digest))
    kept = keyed.join(F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen, digest, "left_semi").dropDuplicates([digest]).drop(digest)
    return docs.filter(~worded).unionByName(kept)
