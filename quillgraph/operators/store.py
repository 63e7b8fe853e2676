"""The graph store's nine look-ups as views over triples (h, r, t)."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Look-up name: key columns, value columns.
VIEWS = {
    "hr2t": (["h", "r"], ["t"]),
    "tr2h": (["t", "r"], ["h"]),
    "r2ht": (["r"], ["h", "t"]),
    "ht2r": (["h", "t"], ["r"]),
    "h2r": (["h"], ["r"]),
    "r2h": (["r"], ["h"]),
    "r2t": (["r"], ["t"]),
    "h2t": (["h"], ["t"]),
    "t2h": (["t"], ["h"]),
}


def view(triples: DataFrame, name: str) -> DataFrame:
    """Distinct key and value columns."""
    keys, values = VIEWS[name]
    return triples.select(*keys, *values).distinct()


def look_up(triples: DataFrame, name: str, wanted: DataFrame) -> DataFrame:
    """The rows of a view whose keys are in wanted."""
    return view(triples.join(wanted, VIEWS[name][0], "left_semi"), name)


def present(candidates: DataFrame, triples: DataFrame) -> DataFrame:
    """The candidate triples that the graph has."""
    return candidates.join(triples, ["h", "r", "t"], "left_semi")


def coo(triples: DataFrame) -> DataFrame:
    """Edges with their attribute, duplicates kept."""
    return triples.select("h", "t", "r")


def exported(triples: DataFrame, entities: DataFrame) -> tuple[DataFrame, int]:
    """Edges and the number of nodes."""
    return coo(triples), entities.count()


def head_relation_mask(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """h, r, present for all pairs; the distinct pairs of h2r are the sparse form of the same."""
    # the product is what is asked for; relations are few
    grid = entities.select(F.col("id").alias("h")).crossJoin(relations.select(F.col("id").alias("r")))
    return grid.join(view(triples, "h2r").withColumn("present", F.lit(True)), ["h", "r"], "left").na.fill(False, ["present"])


def inverse(relation):
    return relation.bitwiseXOR(F.lit(1))
