"""Streaming ingest of triples."""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields() -> Column:
    return F.split(F.trim("value"), r"\s+")


def _whole() -> Column:
    """Whether a line has three fields and all are integers."""
    return F.trim("value").rlike(r"^[+-]?[0-9]+\s+[+-]?[0-9]+\s+[+-]?[0-9]+$")


def triple_stream(spark: SparkSession, path: str) -> DataFrame:
    """h, r, t, seen of the triple files that arrive under path, each triple once per hour of arrival.
    Lines that aren't three integers are left to malformed_lines()."""
    lines = spark.readStream.text(path).filter(_whole()).select(_fields().alias("f"))
    triples = lines.select(*(F.get("f", F.lit(i)).cast("long").alias(c) for i, c in enumerate("hrt")), F.current_timestamp().alias("seen"))
    return triples.withWatermark("seen", "1 hour").dropDuplicatesWithinWatermark(["h", "r", "t"])


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file of the lines under path that aren't three integers, empty ones left out."""
    lines = spark.readStream.text(path).select("value", F.input_file_name().alias("file"))
    return lines.filter(~_whole() & (F.trim("value") != ""))
