"""What the training-data operators share: tables, the shared folder, files of declared-length blobs."""
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definitions: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that this driver has written, in order.
written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share; spark.checkpoint.dir names it on a
    cluster. Where that is unset on one machine (tests) a folder beside the warehouse is used."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
    written.append(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    return written[-1]


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders that nothing will read again."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if p in written:
            written.remove(p)


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage ends here, and a lost
    executor costs nothing that was done before."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(items: Column, value: Callable[[Column], Column], join: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each item, the values of all items before it, joined (by an associative function); zero stands
    before the first. Arrays are copied when they grow, so the items go in about root-of-n chunks of as
    many: n^1.5 steps, not n^2."""
    kind = "array<int>"

    def before(chunk: Column, first: Column) -> Column:
        # [value before each item ..., value of all]
        start = F.array(first).cast(kind)
        return F.aggregate(chunk, start, lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), value(x)))))

    def in_chunks(all_items: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(all_items))).cast("int"), F.lit(1))
        some = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(all_items) / size).cast("int") - 1, F.lit(0))), lambda k: F.slice(all_items, k * size + 1, size))
        inner = F.transform(some, lambda chunk: before(chunk, zero))

        def shifted(parts: Column) -> Column:
            starts = F.aggregate(parts, F.array(zero).cast(kind), lambda acc, p: F.concat(acc, F.array(join(F.element_at(acc, -1), F.element_at(p, -1)))))
            moved = lambda starts: F.transform(parts, lambda p, i: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: join(F.get(starts, i), x)))
            return F.flatten(let(starts, moved))

        return let(inner, shifted)

    return let(items, lambda x: F.when(F.size(x) == 0, F.array().cast(kind)).otherwise(in_chunks(x)))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs hasn't."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, mod n; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def write_blobs(df: DataFrame, column: str, path: str, end: str, blobs: int) -> None:
    """Each row's bytes, followed by end, into files of that many rows at most under path: Spark's text
    writer commits them, so any file system that Spark writes will do and lost tasks leave nothing behind."""
    df.select(F.col(column).cast("string").alias("value")).write.option("lineSep", end).option("maxRecordsPerFile", blobs).text(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the files that write_blobs made."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
