"""Exact answers: a clause becomes joins, anti joins and semi joins on the triples.

Instances are rows (query_id and a column per relation and constant name), so one plan answers any
number of instances of a shape. Positive atoms are joined from the constants outwards; columns that no
later atom needs are dropped with their duplicates at once. Negated atoms are anti joins after the
positive ones; variables that only they have range over the entities.

Triples may be a table, or a function from relation ids to a table: then each atom reads only the relations
that the instances give it, however the graph is stored. Entities may be a function too, which is called
where a variable ranges over them.
"""
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import CONSTANT, Atom, Clause, Query, kind_of


Triples = DataFrame | Callable[[list[int]], DataFrame]
Entities = DataFrame | Callable[[], DataFrame]
#: Different ids of one relation name that are read one by one; beyond it the whole graph is.
RELATIONS = 1000


def _order(positive: tuple[Atom, ...]) -> list[Atom]:
    """An atom with the most bound ends is next; ties keep the order of writing."""
    left, bound, out = list(positive), set(), []
    while left:
        a = max(left, key=lambda a: sum(t in bound or kind_of(t) == CONSTANT for t in (a.head, a.tail)))
        left.remove(a)
        out.append(a)
        bound |= {a.head, a.tail}
    return out


def _matched(rows: DataFrame, triples: DataFrame, a: Atom, how: str) -> DataFrame:
    t = triples.select(F.col("h").alias("__h"), F.col("r").alias("__r"), F.col("t").alias("__t"))
    on = F.col("__r") == F.col(a.relation)
    ends = [(x, c) for x, c in ((a.head, "__h"), (a.tail, "__t"))]
    for x, c in ends:
        if x in rows.columns:
            on = on & (F.col(c) == F.col(x))
    if a.head == a.tail:
        t = t.filter("__h = __t")
    out = rows.join(t, on, how)
    if how == "inner":
        for x, c in ends:
            if x not in rows.columns:
                out = out.withColumn(x, F.col(c))
        out = out.drop("__h", "__r", "__t")
    return out


def relation_ids(query: Query, instances: DataFrame) -> dict[str, list[int]]:
    """The ids that the instances bind to each relation name; names with more than RELATIONS are left out."""
    names = list(dict.fromkeys(a.relation for c in query.clauses for a in c.positive + c.negative))
    found = instances.agg(*(F.slice(F.collect_set(n), 1, RELATIONS + 1).alias(n) for n in names)).first()  # as many as a graph has relations
    return {n: sorted(found[n]) for n in names if len(found[n]) <= RELATIONS}


def clause_rows(clause: Clause, free: list[str], instances: DataFrame, triples: Triples, entities: Entities, relations: dict[str, list[int]] | None = None) -> DataFrame:
    """query_id and the free variables, distinct."""
    rows = instances
    every = lambda x: (entities if isinstance(entities, DataFrame) else entities()).select(F.col("id").alias(x))
    of = lambda a: triples if isinstance(triples, DataFrame) else triples((relations or {}).get(a.relation))
    todo = [(a, "inner") for a in _order(clause.positive)] + [(a, "left_anti") for a in clause.negative]
    for k, (a, how) in enumerate(todo):
        if how == "left_anti":
            for x in dict.fromkeys((a.head, a.tail)):
                if x not in rows.columns:
                    rows = rows.crossJoin(every(x))  # unsafe variable: ranges over all entities
        later = {x for b, _ in todo[k + 1 :] for x in (b.relation, b.head, b.tail)} | set(free) | {"query_id"}
        ends_here = how == "inner" and all(x in rows.columns or x not in later for x in (a.head, a.tail))
        rows = _matched(rows, of(a), a, "left_semi" if ends_here else how)
        keep = [c for c in rows.columns if c in later]
        if len(keep) < len(rows.columns):
            rows = rows.select(*keep).distinct()
    for x in free:
        if x not in rows.columns:
            rows = rows.crossJoin(every(x))
    if clause.contradicts:
        rows = rows.filter(F.lit(False))
    return rows.select("query_id", *free).distinct()


def answers(query: Query, instances: DataFrame, triples: Triples, entities: Entities, relations: dict[str, list[int]] | None = None) -> DataFrame:
    """query_id and one column per free variable, distinct over the disjuncts. Of a sentence: the ids of
    the instances for which it holds. relations: the ids that the instances bind to each relation name,
    for triples that are a function; they are looked up where they aren't given."""
    if relations is None and not isinstance(triples, DataFrame):
        relations = relation_ids(query, instances)
    missing = [n for n in query.names if n not in instances.columns]
    if missing:
        raise ValueError(f"instances bind no {missing}")
    free = [t for t, k in query.terms.items() if k == 2]
    out = None
    for c in query.clauses:
        names = dict.fromkeys(x for a in c.positive + c.negative for x in (a.relation, a.head, a.tail) if x in query.names)
        part = clause_rows(c, free, instances.select("query_id", *names), triples, entities, relations)
        out = part if out is None else out.unionByName(part)
    return out.distinct() if len(query.clauses) > 1 else out


def query_graph(query: Query, instances: DataFrame, inverse: bool = False) -> tuple[DataFrame, DataFrame]:
    """The shape as tables. Nodes: query_id, conj_id, node_id (by first appearance), entity_id (null for
    variables), kind. Edges: query_id, conj_id, edge_id, src, dst, rel, neg; with inverse, each edge also
    the other way with the inverse relation and the same sign."""
    nodes, edges = [], []
    for k, c in enumerate(query.clauses):
        terms = list(dict.fromkeys(t for a in c.positive + c.negative for t in (a.head, a.tail)))
        for i, t in enumerate(terms):
            nodes.append(F.struct(F.lit(k).alias("conj_id"), F.lit(i).alias("node_id"), (F.col(t).cast("long") if kind_of(t) == CONSTANT else F.lit(None).cast("long")).alias("entity_id"), F.lit(kind_of(t)).alias("kind")))
        both = [(a, a in c.negative) for a in dict.fromkeys(c.positive + c.negative)]
        for i, (a, neg) in enumerate(both):
            edges.append(F.struct(F.lit(k).alias("conj_id"), F.lit(i).alias("edge_id"), F.lit(terms.index(a.head)).alias("src"), F.lit(terms.index(a.tail)).alias("dst"), F.col(a.relation).cast("long").alias("rel"), F.lit(neg).alias("neg")))
            if inverse:
                edges.append(F.struct(F.lit(k).alias("conj_id"), F.lit(i + len(both)).alias("edge_id"), F.lit(terms.index(a.tail)).alias("src"), F.lit(terms.index(a.head)).alias("dst"), F.col(a.relation).cast("long").bitwiseXOR(F.lit(1)).alias("rel"), F.lit(neg).alias("neg")))
    table = lambda xs: instances.select("query_id", F.explode(F.array(*xs)).alias("x")).select("query_id", "x.*")
    return table(nodes), table(edges)
