"""Filtered ranking metrics."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filtered_ranks(scores: DataFrame, answers: DataFrame) -> DataFrame:
    """query_id, entity_id, rank (from 0) of the hard answers in answers(query_id, entity_id, hard):
    better answers, easy or hard, don't count. Ties are ranked by entity_id. One sort per query; answers
    are numbered in the same pass."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id")
    marked = scores.join(answers.select("query_id", "entity_id", "hard"), ["query_id", "entity_id"], "left")
    ranked = marked.select("query_id", "entity_id", "hard", (F.row_number().over(w) - 1).alias("raw"), F.count("hard").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("better"))
    return ranked.filter("hard").select("query_id", "entity_id", (F.col("raw") - F.col("better")).alias("rank"))


def metrics(scores: DataFrame, answers: DataFrame, types: DataFrame) -> DataFrame:
    """type, query_id, mrr, hit1, hit3, hit10 per query; types(query_id, type) names each query's shape.
    Raises where a query has no hard answer."""
    bare = types.join(answers.filter("hard"), "query_id", "left_anti")
    if not bare.isEmpty():
        raise ValueError("a query without hard answers")
    r = filtered_ranks(scores, answers).join(types, "query_id")
    hit = lambda k: F.avg((F.col("rank") < k).cast("double")).alias(f"hit{k}")
    return r.groupBy("type", "query_id").agg(F.avg(1 / (1 + F.col("rank"))).alias("mrr"), hit(1), hit(3), hit(10))
