"""Ragged matrices as rows (row_index, pos, value): pos is the place within the row, from 0."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.graph import kept, numbered


def from_arrays(rows: DataFrame, row: str, array: str) -> DataFrame:
    """row_index, pos (place in the row), value; empty rows vanish."""
    return rows.select(F.col(row).alias("row_index"), F.posexplode(array).alias("pos", "value"))


def to_arrays(m: DataFrame, padding: int | None = None) -> DataFrame:
    """row_index and the array of its values; with padding all arrays get the longest one's length."""
    out = m.groupBy("row_index").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values"))
    if padding is None:
        return out
    width = out.agg(F.max(F.size("values")).alias("width"))  # one row
    return out.crossJoin(width).select("row_index", F.concat("values", F.array_repeat(F.lit(padding).cast("long"), F.col("width") - F.size("values"))).alias("values"))


def from_dense(rows: DataFrame, row: str, array: str, padding: int = -1) -> DataFrame:
    return from_arrays(rows, row, array).filter(F.col("value") != padding)


def size(m: DataFrame) -> DataFrame:
    """n_values, n_rows (the largest row_index and one more)."""
    return m.agg(F.count("*").alias("n_values"), (F.coalesce(F.max("row_index"), F.lit(-1)) + 1).alias("n_rows"))


def valid(m: DataFrame) -> DataFrame:
    """One row, valid: whether rows start at 0 without gaps."""
    return m.agg(((F.min("row_index") == 0) & (F.count_distinct("row_index") == F.max("row_index") + 1)).alias("valid"))


def offsets(m: DataFrame) -> DataFrame:
    """row_index, offset: values in the rows before. Rows' counts are summed up range by range, and to each
    range is added what the ranges before it hold."""
    per = m.groupBy("row_index").agg(F.count("*").alias("n"))
    ranged = kept(per.repartitionByRange("row_index").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.alias("a").join(totals.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.total"), F.lit(0)).alias("before"))  # one row a range
    within = F.sum("n").over(Window.partitionBy("part").orderBy("row_index")) - F.col("n")
    return ranged.withColumn("within", within).join(F.broadcast(before), "part").select("row_index", (F.col("within") + F.col("before")).alias("offset"))


def row(m: DataFrame, index: int) -> DataFrame:
    """pos, value of one row."""
    return m.filter(F.col("row_index") == index).select("pos", "value")


def at_places(m: DataFrame, places: DataFrame) -> DataFrame:
    """place, row_index, value of places(place): the values at these places of the whole matrix, which are
    counted from 0 through its rows; a place that is asked for twice comes twice."""
    of_row = m.join(offsets(m), "row_index")
    w = Window.partitionBy("row_index").orderBy("pos")
    counted = of_row.withColumn("place", F.col("offset") + F.row_number().over(w) - 1)
    return places.select("place").join(counted, "place").select("place", "row_index", "value")


def samples(rows: DataFrame, entities: str) -> DataFrame:
    """row_index, pos, value of samples of entities: a row's number is one sample of one entity, a row's
    array is one sample of several. Rows are numbered in the order of their column row."""
    kind = rows.schema[entities].dataType.typeName()
    values = F.col(entities) if kind == "array" else F.array(entities)
    return from_arrays(numbered(rows.select("row", values.alias("values")), "row", name="row_index"), "row_index", "values")


def place(m: DataFrame, descending: bool = False) -> DataFrame:
    """Sorted by value within rows: pos is the new place."""
    by = F.col("value").desc() if descending else F.col("value").asc()
    return m.select("row_index", (F.row_number().over(Window.partitionBy("row_index").orderBy(by)) - 1).alias("pos"), "value")


def first_of_runs(m: DataFrame) -> DataFrame:
    """Without values that equal the one before in their row."""
    w = Window.partitionBy("row_index").orderBy("pos")
    return m.withColumn("prev", F.lag("value").over(w)).filter(F.col("prev").isNull() | (F.col("prev") != F.col("value"))).drop("prev")


def repeats(m: DataFrame) -> DataFrame:
    """The values that equal the one before in their row: what first_of_runs leaves out."""
    w = Window.partitionBy("row_index").orderBy("pos")
    return m.withColumn("prev", F.lag("value").over(w)).filter(F.col("prev") == F.col("value")).drop("prev")


def row_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """row_index, left, right: per row all pairs. Raises where no row is in both."""
    out = a.select("row_index", F.col("value").alias("left")).join(b.select("row_index", F.col("value").alias("right")), "row_index")
    if out.isEmpty():
        raise ValueError("no row in common")
    return out


def expanded(single: DataFrame, like: DataFrame) -> DataFrame:
    """The one value of each row at all places of like's row."""
    return like.select("row_index", "pos").join(single.select("row_index", "value"), "row_index").select("row_index", "pos", "value")


def top(m: DataFrame, k: int) -> DataFrame:
    """The first k of each row."""
    w = Window.partitionBy("row_index").orderBy("pos")
    return m.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank")


def gather(m: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(new_index, row_index): rows copied in that order, as often as asked."""
    return m.join(wanted, "row_index").select(F.col("new_index").alias("row_index"), "pos", "value")


def appended(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def dense_ids(m: DataFrame, *columns: str, name: str = "id") -> DataFrame:
    """m with the rank of the columns' values among the distinct ones, from 0. The distinct values are
    numbered by themselves, range by range, and joined back."""
    return m.join(numbered(m.select(*columns).distinct(), *columns, name=name), list(columns))


def aggregated(m: DataFrame, score: str, reduce: str = "sum") -> DataFrame:
    """row_index, value, score: scores of equal (row, value) reduced by sum, max, min or mean."""
    how = {"sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg}
    if reduce not in how:
        raise ValueError(f"no reduction {reduce!r}")
    return m.groupBy("row_index", "value").agg(how[reduce](score).alias("score"))


def ranges(rows: DataFrame, row: str, start: Column, end: Column) -> DataFrame:
    """row_index, value of start .. end - 1 per row; empty where end <= start."""
    return rows.filter(end > start).select(F.col(row).alias("row_index"), F.explode(F.sequence(start, end - 1)).alias("value"))
