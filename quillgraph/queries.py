"""The graph engine's queries with their SQL for DuckDB."""
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .functions import predictors, tnorm
from .functions.predictors import Predictor
from .operators import beam, graphalgo, message, metric, ragged, scoring, store
from .plans import exact, language
from .plans.language import CONSTANT, kind_of
from .sources import graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KG = f"WITH kg AS (SELECT * FROM {sql.star()})"
VG = f"WITH kg AS (SELECT * FROM {sql.VECTOR})"

# --- graph store -----------------------------------------------------------------------------------

for _name, (_keys, _values) in store.VIEWS.items():
    _columns = ", ".join(_keys + _values)
    query(f"store_{_name}", f"{VG} SELECT DISTINCT {_columns} FROM kg")(lambda s, d, n=_name: store.view(graph.vector_graph(s, d), n))


@query("store_lookup", f"{KG} SELECT DISTINCT h, r, t FROM kg WHERE (h, r) IN (SELECT 2000000000 + n_nationkey, 1 FROM nation WHERE n_regionkey = 0)")
def _(s, d):
    wanted = table(s, d, "nation").filter("n_regionkey = 0").select((F.lit(2 * 10**9).cast("long") + F.col("n_nationkey")).alias("h"), F.lit(1).cast("long").alias("r"))
    return store.look_up(graph.star(s, d), "hr2t", wanted)


@query("store_present", f"{VG} SELECT h, r, t FROM (SELECT i AS h, 2 * j AS r, (i * 7 + j) % 100 AS t FROM range(200) a(i), range(7) b(j)) WHERE (h, r, t) IN (SELECT h, r, t FROM kg)")
def _(s, d):
    some = s.range(200).select(F.col("id").alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("j"))
    return store.present(some.select("h", (2 * F.col("j")).alias("r"), ((F.col("h") * 7 + F.col("j")) % 100).alias("t")), graph.vector_graph(s, d))


query("store_coo", f"{KG} SELECT h, t, r FROM kg")(lambda s, d: store.coo(graph.star(s, d)))
query("store_triples", f"{KG} SELECT h, r, t FROM kg")(lambda s, d: graph.star(s, d))
query("store_inverse", f"{VG} SELECT h, r, t FROM kg UNION ALL SELECT t, xor(r, 1), h FROM kg")(lambda s, d: graph.with_inverse(graph.vector_graph(s, d)))


@query("store_relation_sizes", f"{KG} SELECT r, xor(r, 1) AS inverse, count(*) AS n, count(DISTINCT h) AS heads, count(DISTINCT t) AS tails FROM kg GROUP BY r")
def _(s, d):
    return graph.star(s, d).groupBy("r").agg(F.count("*").alias("n"), F.count_distinct("h").alias("heads"), F.count_distinct("t").alias("tails")).withColumn("inverse", store.inverse(F.col("r")))


@query("store_mask", f"{VG} SELECT e.id AS h, r.id AS r, EXISTS (SELECT 1 FROM kg WHERE kg.h = e.id AND kg.r = r.id) AS present FROM (SELECT DISTINCT h AS id FROM kg UNION SELECT t FROM kg) e, (SELECT DISTINCT r AS id FROM kg) r")
def _(s, d):
    kg = graph.vector_graph(s, d)
    return store.head_relation_mask(kg, graph.entity_ids(kg), kg.select(F.col("r").alias("id")).distinct())


@query("index_encode", "SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT DISTINCT p_name AS name FROM part)")
def _(s, d):
    return graph.encode_names(table(s, d, "part"), "p_name")


@query(
    "index_registered",
    """WITH held AS (SELECT n_name AS name, n_nationkey::BIGINT AS id FROM nation), given AS (SELECT r_name AS name, min(100000 + r_regionkey) AS id FROM region WHERE r_name NOT IN (SELECT name FROM held) GROUP BY r_name),
    new AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_brand NOT IN (SELECT name FROM held)), n AS (SELECT (SELECT count(*) FROM held) + (SELECT count(*) FROM given) AS n)
    SELECT name, id FROM held UNION ALL SELECT name, id FROM given UNION ALL SELECT name, n + row_number() OVER (ORDER BY name) - 1 FROM new, n""",
)
def _(s, d):
    held = table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("id"))
    given = table(s, d, "region").select(F.col("r_name").alias("name"), (F.lit(100000).cast("long") + F.col("r_regionkey")).alias("id"))
    new = table(s, d, "part").select(F.col("p_brand").alias("name"), F.lit(None).cast("long").alias("id"))
    return graph.registered(held, given.unionByName(new).unionByName(held.select("name", (F.col("id") + 7).alias("id"))))


@query("index_id_names", "SELECT id // 2 AS id, name FROM (SELECT n_nationkey AS id, n_name AS name FROM nation) WHERE id % 2 = 0")
def _(s, d):
    names = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return graph.id_names(names, names)[1]


# --- exact answers ---------------------------------------------------------------------------------

_REGION, _NATION, _CUSTOMER, _SUPPLIER = (lambda k, c=c: c * 10**9 + k for c in (1, 2, 3, 4))
#: Bindings of the shapes on the star graph; the other shapes run on the vector graph, both ways.
STAR_INSTANCES: dict[str, list[dict[str, int]]] = {
    "1p": [{"r1": 3, "s1": _REGION(k)} for k in (0, 1)],
    "2p": [{"r1": 3, "s1": _REGION(0), "r2": 1}],
    "3p": [{"r1": 3, "s1": _REGION(0), "r2": 11, "r3": 8}],
    "2i": [{"r1": 8, "s1": _SUPPLIER(k), "r2": 8, "s2": _SUPPLIER(k + 1)} for k in (1, 3, 5)],
    "3i": [{"r1": 8, "s1": _SUPPLIER(1), "r2": 8, "s2": _SUPPLIER(2), "r3": 8, "s3": _SUPPLIER(3)}],
    "ip": [{"r1": 8, "s1": _SUPPLIER(1), "r2": 8, "s2": _SUPPLIER(2), "r3": 9}],
    "pi": [{"r1": 11, "s1": _NATION(k), "r2": 8, "r3": 8, "s2": _SUPPLIER(2)} for k in (1, 2, 3)],
    "2in": [{"r1": 8, "s1": _SUPPLIER(1), "r2": 8, "s2": _SUPPLIER(2)}],
    "3in": [{"r1": 8, "s1": _SUPPLIER(1), "r2": 8, "s2": _SUPPLIER(2), "r3": 8, "s3": _SUPPLIER(3)}],
    "inp": [{"r1": 3, "s1": _REGION(0), "r2": 0, "s2": _CUSTOMER(3), "r3": 1}],
    "pin": [{"r1": 11, "s1": _NATION(k), "r2": 8, "r3": 8, "s2": _SUPPLIER(2)} for k in (1, 2, 3)],
    "pni_beta": [{"r1": 11, "s1": _NATION(k), "r2": 8, "r3": 8, "s2": _SUPPLIER(2)} for k in (1, 2, 3)],
    "2u": [{"r1": 8, "s1": _SUPPLIER(1), "r2": 8, "s2": _SUPPLIER(2)}],
    "up": [{"r1": 8, "s1": _SUPPLIER(1), "r2": 8, "s2": _SUPPLIER(2), "r3": 9}],
    "up-dnf": [{"r1": 8, "s1": _SUPPLIER(1), "r2": 8, "s2": _SUPPLIER(2), "r3": 9}],
}
VECTOR_INSTANCES = [{"r1": 0, "r2": 2, "r3": 4, "r4": 6, "r5": 8, "r6": 10, "s1": s, "s2": s + 1, "s3": s + 2} for s in (1, 5, 9)]


def exact_query(name: str) -> None:
    text = language.CATALOGUE[name]
    q = language.Query.read(text)
    on_star = name in STAR_INSTANCES
    rows = STAR_INSTANCES[name] if on_star else [{k: x[k] for k in q.names} for x in VECTOR_INSTANCES]

    relations = {n: sorted({x[n] for x in rows}) for n in q.names if n.startswith("r")}

    def run(s: SparkSession, d: str) -> DataFrame:
        # answers are distinct anyway, so the triples of an atom needn't be
        of = (lambda ids: graph.star(s, d, ids, distinct=False)) if on_star else (lambda ids: graph.vector_graph(s, d, ids, both=True, distinct=False))
        return exact.answers(q, graph.binding_rows(s, rows), of, lambda: graph.entity_ids(of(None)), relations).withColumnRenamed("f", "entity_id")

    query("shape_" + name.replace("-", "_"), sql.exact(text, sql.star() if on_star else sql.VECTOR_BOTH, rows))(run)


for _name in language.CATALOGUE:
    exact_query(_name)


def flagship(s: SparkSession, d: str) -> DataFrame:
    return QUERIES["shape_inp"](s, d)


def _literal(rows: list[tuple], names: str) -> str:
    show = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) x({names})"


def _rows(s: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    made = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r))) for r in rows))
    return s.range(1).select(F.explode(made).alias("x")).select("x.*")


#: Hand-worked cases of the grammar and of the normal form.
PARSED = [
    ("r1(s1,e1)&r2(e1,e2)&r3(e2,f)", "(r1(s1,e1))&((r2(e1,e2))&(r3(e2,f)))"),
    ("a(s1,f)&b(s2,f)|c(s3,f)", "(a(s1,f))&((b(s2,f))|(c(s3,f)))"),
    ("((r1(s1,f)))", "r1(s1,f)"),
    ("!(r1(s1,f))&r2(s2,f)", "(!(r1(s1,f)))&(r2(s2,f))"),
]
NORMALISED = [
    ("(r1(s1,e1)|r2(s2,e1))&r3(e1,f)", "((r1(s1,e1))&(r3(e1,f)))|((r2(s2,e1))&(r3(e1,f)))"),
    ("r1(s1,f)", "((r1(s1,f)))"),
    ("(a(s1,f)|b(s2,f))&(c(s3,f)|!d(s4,f))", "((a(s1,f))&(c(s3,f)))|((a(s1,f))&(!(d(s4,f))))|((b(s2,f))&(c(s3,f)))|((b(s2,f))&(!(d(s4,f))))"),
]
query("language_parse", _literal(PARSED, "text, canonical"))(lambda s, d: _rows(s, [(t, language.canonical(t)) for t, _ in PARSED], ["text", "canonical"]))
query("language_normal_form", _literal(NORMALISED, "text, normal"))(lambda s, d: _rows(s, [(t, language.normal_form(language.parse(t)).text()) for t, _ in NORMALISED], ["text", "normal"]))
query("language_catalogue", _literal([(n, len(language.Query.read(t).atoms), language.Query.read(t).num_variables) for n, t in language.CATALOGUE.items()], "name, atoms, variables"))(
    lambda s, d: _rows(s, [(n, len(set(re.findall(r"r\d\([^()]*\)", t))), len({v for v in ("e1", "e2", "e3", "f") if v in t})) for n, t in language.CATALOGUE.items()], ["name", "atoms", "variables"])
)


def _graph_parts(part: int):
    q = language.Query.read(language.CATALOGUE["up"])
    return lambda s, d: exact.query_graph(q, graph.binding_rows(s, STAR_INSTANCES["up"]), inverse=True)[part]


_S1, _S2 = _SUPPLIER(1), _SUPPLIER(2)
query("query_graph_nodes", _literal([(0, 0, 0, _S1, 0), (0, 0, 1, "x", 1), (0, 0, 2, "x", 2), (0, 1, 0, _S2, 0), (0, 1, 1, "x", 1), (0, 1, 2, "x", 2)], "query_id, conj_id, node_id, entity_id, kind").replace("'x'", "NULL"))(_graph_parts(0))
query("query_graph_edges", _literal([(0, c, e, s, t, r, False) for c in (0, 1) for e, s, t, r in ((0, 0, 1, 8), (2, 1, 0, 9), (1, 1, 2, 9), (3, 2, 1, 8))], "query_id, conj_id, edge_id, src, dst, rel, neg"))(_graph_parts(1))

# --- fuzzy logic -----------------------------------------------------------------------------------

for _name, _and, _or in (("product", "a * b", "1 - (1 - a) * (1 - b)"), ("godel", "least(a, b)", "1 - least(1 - a, 1 - b)")):
    def _norms(s, d, n=_name):
        t = tnorm.get(n)
        ab = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 5).alias("a"), (F.col("l_tax") * 5).alias("b"))
        return ab.select("l_orderkey", "l_linenumber", F.round(t.conjunction(F.col("a"), F.col("b")), 6).alias("both"), F.round(t.disjunction(F.col("a"), F.col("b")), 6).alias("either"), F.round(t.negation(F.col("a")), 6).alias("no"))

    query(f"tnorm_{_name}", f"SELECT l_orderkey, l_linenumber, round({_and}, 6) AS both, round({_or}, 6) AS either, round(1 - a, 6) AS no FROM (SELECT *, l_discount * 5 AS a, l_tax * 5 AS b FROM lineitem)")(_norms)

# --- link predictors -------------------------------------------------------------------------------

_N = "range(1, 65)"
_H = "range(1, 33)"
_CT = f"[h[i] * r[i] - h[i + 32] * r[i + 32] for i in {_H}] || [h[i] * r[i + 32] + h[i + 32] * r[i] for i in {_H}]"
_RT = f"[h[i] * cos(r[i]) - h[i + 32] * sin(r[i]) for i in {_H}] || [h[i] * sin(r[i]) + h[i + 32] * cos(r[i]) for i in {_H}]"
_MT = "[list_sum([h[i] * r[(i - 1) * 8 + j] for i in range(1, 9)]) for j in range(1, 9)]"
_SORTED = "list_sort([{0} for k in range(1, 9)])"
#: name: predictor, tail and score in SQL over h, r, t (with x the estimated tail).
MODELS: dict[str, tuple[Predictor, str, str]] = {
    "transe": (predictors.transe(), f"[h[i] + r[i] for i in {_N}]", f"-sqrt(list_sum([(x[i] - t[i]) ** 2 for i in {_N}]))"),
    "transe_l1": (predictors.transe(1), f"[h[i] + r[i] for i in {_N}]", f"-list_sum([abs(x[i] - t[i]) for i in {_N}])"),
    "distmult": (predictors.distmult(), f"[h[i] * r[i] for i in {_N}]", f"-list_sum([x[i] * t[i] for i in {_N}])"),
    "complex": (predictors.complex_(32), _CT, f"list_sum([x[i] * t[i] for i in {_N}])"),
    "rotate": (predictors.rotate(32), _RT, f"sqrt(list_sum([(x[i] - t[i]) ** 2 for i in {_N}]))"),
    "rescal": (predictors.rescal(8), _MT, "list_sum([x[i] * t[i] for i in range(1, 9)])"),
    "swtranse": (
        predictors.swtranse(8, 8),
        f"[h[i] + r[(i - 1) // 8 + 1] for i in {_N}]",
        f"-list_sum([sqrt(list_sum([({_SORTED.format('x[q * 8 + k]')}[m] - {_SORTED.format('t[q * 8 + k]')}[m]) ** 2 for m in range(1, 9)])) for q in range(0, 8)])",
    ),
}
_JOINED = f"FROM {sql.VECTOR} g JOIN {sql.VECTORS} a ON a.id = g.h JOIN {sql.VECTORS} b ON b.id = g.r JOIN {sql.VECTORS} c ON c.id = g.t"


def _embedded(s: SparkSession, d: str) -> DataFrame:
    """h, r, t of the vector graph's triples with their vectors."""
    v = graph.vectors(s, d)
    out = graph.vector_graph(s, d)
    for k in "hrt":
        out = out.join(v.select(F.col("id").alias(k), F.col("emb").alias(f"e{k}")), k)
    return out


def _predictor_queries(name: str, p: Predictor, tail: str, score: str) -> None:
    query(f"score_{name}", f"SELECT gh AS h, gr AS r, gt AS t, round({score}, 6) AS score FROM (SELECT *, {tail} AS x FROM (SELECT g.h AS gh, g.r AS gr, g.t AS gt, a.emb AS h, b.emb AS r, c.emb AS t {_JOINED}))")(
        lambda s, d: _embedded(s, d).select("h", "r", "t", F.round(p.score(F.col("eh"), F.col("er"), F.col("et")), 6).alias("score"))
    )
    if name != "transe_l1":
        def tails(s, d):
            v = graph.vectors(s, d)
            hr = store.view(graph.vector_graph(s, d), "h2r").join(v.select(F.col("id").alias("h"), F.col("emb").alias("eh")), "h").join(v.select(F.col("id").alias("r"), F.col("emb").alias("er")), "r")
            x = p.tail(F.col("eh"), F.col("er"))
            return hr.select("h", "r", F.posexplode(x).alias("i", "v")).select("h", "r", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))

        query(f"tail_{name}", f"SELECT h, r, i::BIGINT AS i, round(x[i + 1], 6) AS v FROM (SELECT gh AS h, gr AS r, x, unnest(range(0, len(x))) AS i FROM (SELECT gh, gr, {tail} AS x FROM (SELECT g.h AS gh, g.r AS gr, a.emb AS h, b.emb AS r FROM (SELECT DISTINCT h, r FROM {sql.VECTOR}) g JOIN {sql.VECTORS} a ON a.id = g.h JOIN {sql.VECTORS} b ON b.id = g.r)))")(tails)


for _name, _model in MODELS.items():
    _predictor_queries(_name, *_model)

COMPLEX = predictors.complex_(32)


@query("head_transe", f"SELECT h, r, t, round(list_sum([(c.emb[i] - b.emb[i]) * i for i in {_N}]), 5) AS probe FROM (SELECT g.h, g.r, g.t {_JOINED}) JOIN {sql.VECTORS} b ON b.id = r JOIN {sql.VECTORS} c ON c.id = t")
def _(s, d):
    head = predictors.transe().head(F.col("et"), F.col("er"))
    return _embedded(s, d).select("h", "r", "t", F.round(predictors.total(F.transform(head, lambda v, i: v * (i + 1))), 5).alias("probe"))


@query("penalty_complex", f"SELECT id, round(list_sum([sqrt(emb[i] ** 2 + emb[i + 32] ** 2) ** 3 for i in {_H}]), 6) AS penalty FROM {sql.VECTORS}")
def _(s, d):
    return graph.vectors(s, d).select("id", F.round(predictors.cubic_penalty(F.col("emb"), 32), 6).alias("penalty"))


@query("constraint_triples", f"SELECT gh AS h, gr AS r, gt AS t, neg, round(CASE WHEN neg THEN -s ELSE s END, 6) AS score FROM (SELECT *, (gh + gt) % 2 = 1 AS neg, list_sum([x[i] * t[i] for i in {_N}]) AS s FROM (SELECT *, {_CT} AS x FROM (SELECT g.h AS gh, g.r AS gr, g.t AS gt, a.emb AS h, b.emb AS r, c.emb AS t {_JOINED})))")
def _(s, d):
    v = graph.vectors(s, d)
    rows = graph.vector_graph(s, d).withColumn("neg", (F.col("h") + F.col("t")) % 2 == 1)
    return scoring.constraint_scores(rows, v, v, COMPLEX).withColumn("score", F.round("score", 6))


@query("rank_all", f"SELECT query_id, entity_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) - 1 AS rank FROM (SELECT a.id AS query_id, b.id AS entity_id, round(-sqrt(list_sum([(a.emb[i] - b.emb[i]) ** 2 for i in {_N}])), 6) AS score FROM {sql.VECTORS} a, {sql.VECTORS} b WHERE a.id % 50 = 0)")
def _(s, d):
    v = graph.vectors(s, d)
    return scoring.rankings(v.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "emb"), v)


_TOP = f"SELECT * FROM (SELECT query_id, entity_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) - 1 AS rank FROM (SELECT a.id AS query_id, b.id AS entity_id, round(list_sum([a.emb[i] * b.emb[i] for i in {_N}]), 6) AS score FROM {sql.VECTORS} a, {sql.VECTORS} b)) WHERE rank < 10"
query("top_tails_arrow", _TOP)(lambda s, d: scoring.top_tails(graph.vectors(s, d).select(F.col("id").alias("query_id"), "emb"), graph.vectors(s, d), 10))


@query("score_conve")
def _(s, d):
    return scoring.conve_scores(_embedded(s, d).select("h", "r", "t", "eh", "er", "et"), predictors.ConvE.seeded(64, aspect=7)).withColumn("score", F.round("score", 6))


# --- beam search -----------------------------------------------------------------------------------

BEAM = 8


def _beam_instances(q: language.Query) -> list[dict[str, int]]:
    return [{k: x[k] for k in q.names} for x in VECTOR_INSTANCES]


def _score_sql(base: str, r: int, sign: str = "") -> str:
    """query_id, entity_id, v: base score of a source and the triple's score, best over sources."""
    return f"""SELECT query_id, entity_id, max(y + {sign}s) AS v FROM (SELECT query_id, y, e.id AS entity_id, list_sum([x[i] * e.emb[i] for i in {_N}]) AS s FROM (SELECT query_id, y, {_CT} AS x FROM (SELECT q.query_id, q.y, a.emb AS h, b.emb AS r FROM ({base}) q JOIN v a ON a.id = q.src JOIN v b ON b.id = {r})), v e) GROUP BY query_id, entity_id"""


def _from(term: str) -> str:
    return " UNION ALL ".join(f"SELECT {i}::BIGINT AS query_id, {x[term]} AS src, 1.0::DOUBLE AS y" for i, x in enumerate(VECTOR_INSTANCES))


def _sum(*parts: str) -> str:
    return f"SELECT query_id, entity_id, round(sum(v), 6) AS score FROM ({' UNION ALL '.join(parts)}) GROUP BY query_id, entity_id"


def _cut(rows: str) -> str:
    return f"SELECT query_id, entity_id AS src, score AS y FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS n FROM ({rows})) WHERE n <= {BEAM}"


_P1 = _score_sql(_from("s1"), 0)
def _beam_query(name: str) -> None:
    q = language.Query.read(language.CATALOGUE[name])

    def run(s: SparkSession, d: str) -> DataFrame:
        v = graph.vectors(s, d)
        return beam.scores(q, graph.binding_rows(s, _beam_instances(q)), v, v, COMPLEX, BEAM)

    def part(clause: list) -> str:
        made: dict[str, str] = {}

        def source(term: str) -> str:
            """query_id, src, y: a constant, the best of a variable, or all entities where nothing leads to it."""
            if kind_of(term) == CONSTANT:
                return _from(term)
            if term not in made:
                made[term] = _cut(scored(term)) if steps[term] else f"SELECT i AS query_id, id AS src, 1.0::DOUBLE AS y FROM range({len(VECTOR_INSTANCES)}) t(i), v"
            return made[term]

        def scored(term: str) -> str:
            return _sum(*(_score_sql(source(src), VECTOR_INSTANCES[0][name] ^ inverse, "-" if neg else "") for src, name, inverse, neg in steps[term]))

        steps = sql.beam_steps(clause)
        return scored("f")

    parts = [part(c) for c in language.clauses(language.parse(language.CATALOGUE[name]))]
    oracle = parts[0] if len(parts) == 1 else f"SELECT query_id, entity_id, max(score) AS score FROM ({' UNION ALL '.join(f'({x})' for x in parts)}) GROUP BY query_id, entity_id"
    query("beam_" + name.replace("-", "_"), f"WITH v AS MATERIALIZED (SELECT * FROM {sql.VECTORS}) {oracle}")(run)


for _name in language.CATALOGUE:
    _beam_query(_name)


@query("beam_2u_tconorm", f"""WITH v AS MATERIALIZED (SELECT * FROM {sql.VECTORS}) SELECT query_id, entity_id, round(1 - (1 - a) * (1 - b), 6) AS score
    FROM (SELECT query_id, entity_id, 1 / (1 + exp(-score)) AS a FROM ({_sum(_P1)})) JOIN (SELECT query_id, entity_id, 1 / (1 + exp(-score)) AS b FROM ({_sum(_score_sql(_from('s2'), 2))})) USING (query_id, entity_id)""")
def _(s, d):
    q, v = language.Query.read(language.CATALOGUE["2u"]), graph.vectors(s, d)
    either = beam.t_conorm(tnorm.get("product"))
    return beam.scores(q, graph.binding_rows(s, _beam_instances(q)), v, v, COMPLEX, BEAM, either).withColumn("score", F.round("score", 6))


# --- message passing -------------------------------------------------------------------------------

SHARED = [0.1] * 64
_LM = language.Query.read(language.CATALOGUE["2p"])


def _shape(s: SparkSession, inverse: bool = True) -> tuple[DataFrame, DataFrame]:
    return exact.query_graph(_LM, graph.binding_rows(s, _beam_instances(_LM)), inverse)


@query(
    "message_round",
    f"""WITH v AS (SELECT * FROM {sql.VECTORS}), q AS (SELECT * FROM (VALUES (0, 1), (1, 5), (2, 9)) x(query_id, s1)),
    m AS (SELECT query_id, {_CT} AS x, a.emb AS own FROM (SELECT query_id, a.emb AS h, b.emb AS r FROM q JOIN v a ON a.id = s1 JOIN v b ON b.id = 0) JOIN q USING (query_id) JOIN v a ON a.id = s1),
    f AS (SELECT {_CT} AS x FROM (SELECT [0.1 for i in {_N}] AS h, emb AS r FROM v WHERE id = 2))
    SELECT query_id::BIGINT AS query_id, 0 AS node_id, i, round(0.1 * own[i + 1], 6) AS x FROM m, range(64) k(i)
    UNION ALL SELECT query_id, 1, i, round(0.01 + m.x[i + 1], 6) FROM m, range(64) k(i)
    UNION ALL SELECT query_id, 2, i, round(0.01 + f.x[i + 1], 6) FROM q, f, range(64) k(i)""",
)
def _(s, d):
    v = graph.vectors(s, d)
    nodes, edges = _shape(s, inverse=False)
    x = message.round_sums(message.initial(nodes, v, SHARED), edges, v, COMPLEX)
    return x.select("query_id", "node_id", F.posexplode("x").alias("i", "x")).select("query_id", "node_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("message_scores")
def _(s, d):
    v = graph.vectors(s, d)
    return message.scores(*_shape(s), v, v, COMPLEX, SHARED, rounds=_LM.num_variables).withColumn("score", F.round("score", 6))


@query("message_scores_layers")
def _(s, d):
    g = np.random.default_rng(3)
    layers = [(g.normal(0, 0.1, (64, 64)), np.zeros(64)) for _ in range(2)]
    v = graph.vectors(s, d)
    return message.scores(*_shape(s), v, v, COMPLEX, SHARED, _LM.num_variables, lambda x: message.layered_update(x, layers)).withColumn("score", F.round("score", 6))


@query("cosine_all", f"SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.emb, b.emb), 6) AS score FROM {sql.VECTORS} a, {sql.VECTORS} b WHERE a.id % 100 = 0")
def _(s, d):
    v = graph.vectors(s, d)
    return message.cosines(v.filter("id % 100 = 0").select(F.col("id").alias("a"), "emb"), v.select(F.col("id").alias("b"), "emb")).select("a", "b", F.round("score", 6).alias("score"))


# --- losses and metrics ----------------------------------------------------------------------------

_SCORED = "SELECT user_id AS query_id, event_id, value AS score, event_id % 3 = 0 AS positive FROM events WHERE value IS NOT NULL"


def _scored(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").filter("value is not null").select(F.col("user_id").alias("query_id"), F.col("value").alias("score"), (F.col("event_id") % 3 == 0).alias("positive"))


@query("loss_softmax", f"WITH x AS ({_SCORED}), n AS (SELECT query_id, m, m + ln(sum(exp(score - m))) AS z FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM x) GROUP BY query_id, m) SELECT round(avg(z - score), 6) AS loss FROM x JOIN n USING (query_id) WHERE positive")
def _(s, d):
    return message.loss("softmax", _scored(s, d)).select(F.round("loss", 6).alias("loss"))


@query("loss_nce", f"WITH x AS ({_SCORED}), p AS (SELECT query_id, max(score) / 50 AS p FROM x WHERE positive GROUP BY query_id), n AS (SELECT query_id, score / 50 AS n FROM x WHERE NOT positive), t AS (SELECT query_id, p, max(greatest(p, n)) AS m FROM p JOIN n USING (query_id) GROUP BY query_id, p) SELECT round(avg(z), 6) AS loss FROM (SELECT query_id, -p + m + ln(sum(exp(n - m)) + exp(p - m)) AS z FROM t JOIN n USING (query_id) GROUP BY query_id, p, m)")
def _(s, d):
    x = _scored(s, d)
    pos = x.filter("positive").groupBy("query_id").agg(F.max("score").alias("pos"))
    both = pos.join(x.filter("not positive").select("query_id", F.col("score").alias("neg")), "query_id")
    return message.contrastive_loss(both, 50.0).select(F.round("loss", 6).alias("loss"))


@query("loss_multi_hot", "SELECT round(avg(CASE WHEN l_returnflag = 'R' THEN -ln(p) ELSE -ln(1 - p) END), 6) AS loss FROM (SELECT *, (l_discount + 0.01) / 1.1 AS p FROM lineitem)")
def _(s, d):
    rows = table(s, d, "lineitem").select(((F.col("l_discount") + 0.01) / 1.1).alias("p"), (F.col("l_returnflag") == "R").alias("hit"))
    return beam.multi_hot_loss(rows).select(F.round("loss", 6).alias("loss"))


_METRIC = f"""WITH v AS MATERIALIZED (SELECT * FROM {sql.VECTORS}), s AS ({_sum(_P1)}),
a AS (SELECT DISTINCT q AS query_id, t AS entity_id, t % 2 = 0 AS hard FROM {sql.VECTOR}, (VALUES (0, 1), (1, 5), (2, 9)) x(q, s1) WHERE h = s1 AND r = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) - 1 AS raw FROM s),
f AS (SELECT query_id, entity_id, hard, raw - (row_number() OVER (PARTITION BY query_id ORDER BY raw) - 1) AS rank FROM k JOIN a USING (query_id, entity_id))
SELECT '1p' AS type, query_id, round(avg(1 / (1 + rank)), 6) AS mrr, round(avg((rank < 1)::INT), 6) AS hit1, round(avg((rank < 3)::INT), 6) AS hit3, round(avg((rank < 10)::INT), 6) AS hit10 FROM f WHERE hard GROUP BY query_id"""


@query("metric_filtered", _METRIC)
def _(s, d):
    q = language.Query.read(language.CATALOGUE["1p"])
    inst = graph.binding_rows(s, _beam_instances(q))
    kg = graph.vector_graph(s, d)
    found = exact.answers(q, inst, kg, graph.entity_ids(kg)).select("query_id", F.col("f").alias("entity_id"), (F.col("f") % 2 == 0).alias("hard"))
    hard = found.filter("hard").select("query_id").distinct()
    types = inst.join(hard, "query_id", "left_semi").select("query_id", F.lit("1p").alias("type"))
    m = metric.metrics(QUERIES["beam_1p"](s, d), found, types)
    return m.select("type", "query_id", *(F.round(c, 6).alias(c) for c in ("mrr", "hit1", "hit3", "hit10")))


# --- ragged matrices -------------------------------------------------------------------------------

_M = "(SELECT l_orderkey AS row_index, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos, l_suppkey % 5 AS value FROM lineitem)"


def _matrix(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("row_index"), (F.row_number().over(w) - 1).alias("pos"), (F.col("l_suppkey") % 5).alias("value"))


RAGGED: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "size": (ragged.size, f"SELECT count(*) AS n_values, max(row_index) + 1 AS n_rows FROM {_M}"),
    "valid": (ragged.valid, f"SELECT min(row_index) = 0 AND count(DISTINCT row_index) = max(row_index) + 1 AS valid FROM {_M}"),
    "offsets": (ragged.offsets, f"SELECT row_index, (sum(n) OVER (ORDER BY row_index) - n)::BIGINT AS offset FROM (SELECT row_index, count(*) AS n FROM {_M} GROUP BY row_index)".replace("AS offset", 'AS "offset"')),
    "sorted": (ragged.place, f"SELECT row_index, row_number() OVER (PARTITION BY row_index ORDER BY value) - 1 AS pos, value FROM {_M}"),
    "sorted_desc": (lambda m: ragged.place(m, True), f"SELECT row_index, row_number() OVER (PARTITION BY row_index ORDER BY value DESC) - 1 AS pos, value FROM {_M}"),
    "first_of_runs": (ragged.first_of_runs, f"SELECT row_index, pos, value FROM (SELECT *, lag(value) OVER (PARTITION BY row_index ORDER BY pos) AS p FROM {_M}) WHERE p IS DISTINCT FROM value"),
    "repeats": (ragged.repeats, f"SELECT row_index, pos, value FROM (SELECT *, lag(value) OVER (PARTITION BY row_index ORDER BY pos) AS p FROM {_M}) WHERE p = value"),
    "row": (lambda m: ragged.row(m, 7), f"SELECT pos, value FROM {_M} WHERE row_index = 7"),
    "at_places": (lambda m: ragged.at_places(m, m.select((F.col("row_index") * 3).alias("place")).distinct()), f"SELECT place, row_index, value FROM (SELECT *, row_number() OVER (ORDER BY row_index, pos) - 1 AS place FROM {_M}) WHERE place IN (SELECT row_index * 3 FROM {_M})"),
    "samples": (lambda m: ragged.samples(ragged.to_arrays(m).withColumnRenamed("row_index", "row"), "values"), f"SELECT dense_rank() OVER (ORDER BY row_index) - 1 AS row_index, pos, value FROM {_M}"),
    "product": (lambda m: ragged.row_product(m, m.filter("pos < 2")), f"SELECT a.row_index, a.value AS \"left\", b.value AS \"right\" FROM {_M} a JOIN {_M} b ON a.row_index = b.row_index AND b.pos < 2"),
    "expanded": (lambda m: ragged.expanded(m.filter("pos = 0"), m), f"SELECT a.row_index, b.pos, a.value FROM {_M} a JOIN {_M} b ON a.row_index = b.row_index AND a.pos = 0"),
    "top": (lambda m: ragged.top(ragged.place(m), 2), f"SELECT * FROM (SELECT row_index, row_number() OVER (PARTITION BY row_index ORDER BY value) - 1 AS pos, value FROM {_M}) WHERE pos < 2"),
    "gather": (lambda m: ragged.gather(m, m.select("row_index").distinct().select((F.col("row_index") * 2).alias("new_index"), "row_index")), f"SELECT row_index * 2 AS row_index, pos, value FROM {_M}"),
    "appended": (lambda m: ragged.appended(m, m.filter("pos = 0")), f"SELECT * FROM {_M} UNION ALL SELECT * FROM {_M} WHERE pos = 0"),
    "dense_rows": (lambda m: ragged.dense_ids(m, "row_index", name="new_index"), f"SELECT *, dense_rank() OVER (ORDER BY row_index) - 1 AS new_index FROM {_M}"),
    "pair_ids": (lambda m: ragged.dense_ids(m.select("pos", "value"), "pos", "value"), f"SELECT pos, value, dense_rank() OVER (ORDER BY pos, value) - 1 AS id FROM {_M}"),
    "aggregated": (lambda m: ragged.aggregated(m.withColumn("score", F.col("pos") * 1.5), "score", "max"), f"SELECT row_index, value, max(pos * 1.5)::DOUBLE AS score FROM {_M} GROUP BY row_index, value"),
    "to_arrays": (lambda m: ragged.to_arrays(m).select("row_index", F.array_join("values", ",").alias("values")), f"SELECT row_index, string_agg(value::VARCHAR, ',' ORDER BY pos) AS \"values\" FROM {_M} GROUP BY row_index"),
    "padded": (lambda m: ragged.from_dense(ragged.to_arrays(m, -1), "row_index", "values"), f"SELECT row_index, pos, value FROM {_M}"),
    "ranges": (lambda m: ragged.ranges(m.filter("pos = 0"), "row_index", F.col("value"), F.lit(4).cast("long")), f"SELECT row_index, unnest(range(value, 4)) AS value FROM {_M} WHERE pos = 0"),
    "first_places": (lambda m: graphalgo.first_places(m.select("value", (F.col("row_index") * 10 + F.col("pos")).alias("pos"))), f"SELECT value, min(row_index * 10 + pos) AS first FROM {_M} GROUP BY value"),
}
for _name, (_f, _sql) in RAGGED.items():
    query(f"ragged_{_name}", _sql)(lambda s, d, f=_f: f(_matrix(s, d)))

# --- graph algorithms ------------------------------------------------------------------------------

#: Rounds of the walk that the query asks for.
WALK_ROUNDS = 6

_EDGES = f"(SELECT DISTINCT h AS src, t AS dst FROM {sql.star()} WHERE r IN (3, 1, 4))"


def _edges(s: SparkSession, d: str) -> DataFrame:
    return graph.star(s, d).filter(F.col("r").isin(3, 1, 4)).select(F.col("h").alias("src"), F.col("t").alias("dst")).distinct()


def _region0(s: SparkSession) -> DataFrame:
    return s.range(1).select(F.lit(_REGION(0)).cast("long").alias("node"))


query("hop_forward", f"SELECT DISTINCT dst AS node FROM {_EDGES} WHERE src = {_REGION(0)}")(lambda s, d: graphalgo.one_hop(_edges(s, d), _region0(s)))
query("hop_backward", f"SELECT DISTINCT src AS node FROM {_EDGES} WHERE dst = {_NATION(0)}")(lambda s, d: graphalgo.one_hop(_edges(s, d), s.range(1).select(F.lit(_NATION(0)).cast("long").alias("node")), "backward"))
_BFS = f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {_EDGES}), w AS (SELECT {_REGION(0)}::BIGINT AS node, 0 AS level UNION SELECT e.dst, level + 1 FROM w JOIN e ON e.src = w.node WHERE level < 8) SELECT node, min(level) AS level FROM w GROUP BY node"
query("bfs", _BFS)(lambda s, d: graphalgo.bfs(_edges(s, d), _region0(s)))
_WALK = f"(SELECT row_number() OVER (ORDER BY h, t) AS pos, h AS src, t AS dst FROM {sql.VECTOR} WHERE r = 0)"


def _walk_sql(rounds: int) -> str:
    """The walk, round by round."""
    out = [f"WITH e0 AS MATERIALIZED {_WALK}, v0 AS (SELECT DISTINCT src AS node FROM e0 WHERE src < 3), l0 AS (SELECT node, 0 AS level FROM v0)"]
    for k in range(1, rounds + 1):
        out.append(f"o{k} AS MATERIALIZED (SELECT * FROM e{k - 1} WHERE src IN (SELECT node FROM v{k - 1}) AND EXISTS (SELECT 1 FROM e0 WHERE src NOT IN (SELECT node FROM v{k - 1}) OR dst NOT IN (SELECT node FROM v{k - 1}))), t{k} AS MATERIALIZED (SELECT DISTINCT arg_min(dst, pos) AS node FROM o{k} GROUP BY src)")
        out.append(f"v{k} AS MATERIALIZED (SELECT node FROM v{k - 1} UNION SELECT node FROM t{k}), e{k} AS MATERIALIZED (SELECT * FROM e{k - 1} WHERE pos NOT IN (SELECT pos FROM o{k} WHERE dst IN (SELECT node FROM t{k})))")
        out.append(f"l{k} AS (SELECT node, {k} AS level FROM t{k})")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(rounds + 1)).join(("SELECT * FROM (", ")"))


@query("expansion", _walk_sql(WALK_ROUNDS))
def _(s, d):
    e = graph.vector_graph(s, d, [0]).select(F.col("h").alias("src"), F.col("t").alias("dst"))
    e = graph.numbered(e, "src", "dst", name="pos", start=1)
    return graphalgo.expansion_levels(e, e.filter("src < 3").select(F.col("src").alias("node")).distinct(), WALK_ROUNDS)


_DAG = f"(SELECT DISTINCT least(h, t) AS src, greatest(h, t) AS dst FROM {sql.VECTOR} WHERE h <> t AND h < 40 AND t < 40)"


@query("topological_dag", f"WITH RECURSIVE e AS MATERIALIZED {_DAG}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), w AS (SELECT node, 0 AS level FROM n WHERE node NOT IN (SELECT dst FROM e) UNION SELECT e.dst, level + 1 FROM w JOIN e ON e.src = w.node) SELECT node, max(level) AS level FROM w GROUP BY node")
def _(s, d):
    kg = graph.vector_graph(s, d).filter("h <> t and h < 40 and t < 40")
    e = kg.select(F.least("h", "t").alias("src"), F.greatest("h", "t").alias("dst")).distinct()
    roots = e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")), "node", "left_anti")
    return graphalgo.topological_levels(e, roots)


query("topological", f"WITH e AS (SELECT * FROM {_EDGES}) SELECT DISTINCT * FROM (SELECT 1000000000 + r_regionkey AS node, 0 AS level FROM region UNION ALL SELECT 2000000000 + n_nationkey, 1 FROM nation UNION ALL SELECT 3000000000 + c_custkey, 2 FROM customer UNION ALL SELECT e.dst, 3 FROM e JOIN customer ON e.src = 3000000000 + c_custkey)")(
    lambda s, d: graphalgo.topological_levels(_edges(s, d), table(s, d, "region").select((F.lit(10**9).cast("long") + F.col("r_regionkey")).alias("node")))
)
