"""Beam search over a clause: per variable the k best entities, from the constants to the free variable.

score(v, x) = sum over edges u -> v of the max over y in beam(u) of (score of (y, r, x), negated where
the atom is, + score(u, y)); constants and leaves start at 1. Edges point towards the free variable by
breadth-first level; an atom between variables of one level, into a constant, or from a variable to
itself takes no part. An atom that is written against its direction is used with the inverse relation.
Beams are cut by score rounded to 6 places, then by id. The free variable keeps all entities.
"""
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predictors import Predictor, dot
from ..plans.language import CONSTANT, Clause, Query, kind_of
from .scoring import best_products

PLACES = 6
#: Vectors of relations up to which they are broadcast.
BROADCAST_RELATIONS = 1000
#: Sources of an edge, the entities that all instances keep, up to which they are broadcast: 6 MB of three vectors of 64.
BROADCAST_SOURCES = 4000


def steps(c: Clause) -> dict[str, list[tuple[str, str, bool, bool]]]:
    """target: [(source, relation name, inverse, negated)]."""
    level = c.levels()
    out: dict[str, list] = {v: [] for v in level}
    for a, neg in [(a, False) for a in c.positive] + [(a, True) for a in c.negative]:
        for src, dst, inv in ((a.head, a.tail, False), (a.tail, a.head, True)):
            if dst in level and src != dst and (kind_of(src) == CONSTANT or level.get(src, -1) > level[dst]):
                out[dst].append((src, a.relation, inv, neg))
    return out


def clause_scores(c: Clause, instances: DataFrame, entities: DataFrame, relations: DataFrame, p: Predictor, k: int) -> DataFrame:
    """query_id, entity_id, score of the free variable for every entity."""
    plan = steps(c)
    ent = entities.select(F.col("id").alias("x"), F.col("emb").alias("ex"))
    rel = relations.select(F.col("id").alias("r"), F.col("emb").alias("er"))
    made: dict[str, DataFrame] = {}
    # a few sources go to the entities, which are neither moved for them nor read once for each of their partitions
    small = F.broadcast if instances.count() * max(k, 1) <= BROADCAST_SOURCES else lambda rows: rows

    def source(term: str) -> DataFrame:
        """query_id, y, ybase."""
        if kind_of(term) == CONSTANT:
            return instances.select("query_id", F.col(term).alias("y"), F.lit(1.0).alias("ybase"))
        if term not in made:
            rows = variable(term)
            if plan[term]:  # leaves keep all entities
                w = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id")
                rows = rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)
            made[term] = rows.select("query_id", F.col("entity_id").alias("y"), F.col("score").alias("ybase"))
        return made[term]

    def from_leaf(r: Column, neg: bool) -> DataFrame:
        """query_id, entity_id, score by an edge from a variable that keeps all entities with the score 1. It hangs on
        the relation only, so instances that share one share its scores."""
        asked = instances.select(r.alias("r")).distinct()
        asked = F.broadcast(asked) if asked.count() <= BROADCAST_RELATIONS else asked
        own = rel.join(asked, "r")
        own = F.broadcast(own) if own.count() <= BROADCAST_RELATIONS else own
        tails = own.crossJoin(ent.filter("x is not null").select(F.col("ex").alias("ey")))
        if p.factor is None:
            s = p.score(F.col("ey"), F.col("er"), F.col("ex")) * p.rank_sign
            best = tails.crossJoin(ent).select("r", F.col("x").alias("entity_id"), (-s if neg else s).alias("score"))
        else:
            tail = p.tail(F.col("ey"), F.col("er"))
            best = best_products(tails.select("r", (F.transform(tail, lambda v: -v) if neg else tail).alias("emb")), ent.select(F.col("x").alias("id"), p.factor(F.col("ex")).alias("emb")))
            # entities that have no product have no score
            best = best.unionByName(own.select("r").crossJoin(ent.select(F.col("x").alias("entity_id"))).withColumn("score", F.lit(None).cast("double")))
        best = best.groupBy("r", "entity_id").agg((F.lit(1.0) + F.max("score")).alias("score"))
        return instances.select("query_id", r.alias("r")).join(best, "r").select("query_id", "entity_id", "score")

    def variable(term: str) -> DataFrame:
        if not plan[term]:
            return instances.select("query_id").crossJoin(ent.select(F.col("x").alias("entity_id"))).withColumn("score", F.lit(1.0))  # every entity, by definition
        out = None
        for src, name, inv, neg in plan[term]:
            r = F.col(name).bitwiseXOR(F.lit(1)) if inv else F.col(name)
            if kind_of(src) != CONSTANT and not plan[src]:
                best = from_leaf(r, neg)
                out = best if out is None else out.unionByName(best)
                continue
            rows = source(src).join(instances.select("query_id", r.alias("r")), "query_id")
            heads = small(small(rows).join(ent.select(F.col("x").alias("y"), F.col("ex").alias("ey")), "y")).join(rel, "r")
            tails = heads.select("query_id", "ybase", p.tail(F.col("ey"), F.col("er")).alias("tail"), "ey", "er")
            # the tail of a source is made once, not for each entity, where the score is its product
            s = dot(F.col("tail"), p.factor(F.col("ex"))) if p.factor else p.score(F.col("ey"), F.col("er"), F.col("ex")) * p.rank_sign
            # all entities are scored for each of at most k sources a query; vectors don't leave this step
            each = small(tails).crossJoin(ent).select("query_id", F.col("x").alias("entity_id"), (F.col("ybase") + (-s if neg else s)).alias("score"))
            best = each.groupBy("query_id", "entity_id").agg(F.max("score").alias("score"))
            out = best if out is None else out.unionByName(best)
        return out.groupBy("query_id", "entity_id").agg(F.round(F.sum("score"), PLACES).alias("score"))

    return variable("f")


def t_conorm(norm) -> Callable[[Column], Column]:
    """Combines the scores of disjuncts by a fuzzy logic: each is brought into (0, 1) by the logistic function."""
    inside = lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
    return lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: norm.disjunction(a, inside(x)))


def scores(query: Query, instances: DataFrame, entities: DataFrame, relations: DataFrame, p: Predictor, k: int, combine: Callable[[Column], Column] | None = None) -> DataFrame:
    """query_id, entity_id, score: over disjuncts the largest, or what combine makes of the array of them, in
    ascending order."""
    out = None
    for c in query.clauses:
        part = clause_scores(c, instances, entities, relations, p, k)
        out = part if out is None else out.unionByName(part)
    if len(query.clauses) == 1 and combine is None:
        return out
    # as many as the shape has disjuncts
    best = F.max("score") if combine is None else combine(F.sort_array(F.collect_list("score")))
    return out.groupBy("query_id", "entity_id").agg(best.alias("score"))


def multi_hot_loss(scored: DataFrame) -> DataFrame:
    """One row, loss: binary cross-entropy of scored(p in (0, 1), hit). Values outside raise."""
    inside = F.when((F.col("p") > 0) & (F.col("p") < 1), F.col("p")).otherwise(F.raise_error(F.lit("a score outside (0, 1)")).cast("double"))
    return scored.agg(F.avg(F.when(F.col("hit"), -F.ln(inside)).otherwise(-F.ln(1 - inside))).alias("loss"))
