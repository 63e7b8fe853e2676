"""Triple files, name indexes, query-answer files; and the graphs derived from the driver's tables."""
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.language import canonical

TRIPLE = "h long, r long, t long"


def read_triples(spark: SparkSession, paths: str | list[str], check: bool = True, to_int: bool = True, size: int = 3) -> DataFrame:
    """h, r, t from text lines of three fields, separated by any white space; lines of another size give
    f0, f1 and so on. Fields are integers, or strings without to_int. With check, a line of another number
    of fields raises when it is read; without, such lines are left out."""
    if not isinstance(paths, (str, list)):
        raise NotImplementedError(type(paths))
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(paths).select(f.alias("f"))
    whole = F.size("f") == size
    rows = rows.filter(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit(f"a line without {size} fields")).cast("boolean"))) if check else rows.filter(whole)
    names = list("hrt") if size == 3 else [f"f{i}" for i in range(size)]
    return rows.select(*(F.get("f", F.lit(i)).cast("long" if to_int else "string").alias(c) for i, c in enumerate(names)))


def checked(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """triples, if all their ids are known; ValueError otherwise."""
    ids = entities.select(F.col("id"))
    bad = triples.select(F.col("h").alias("id")).union(triples.select("t")).join(ids, "id", "left_anti").limit(1)
    bad = bad.union(triples.select(F.col("r").alias("id")).join(relations.select("id"), "id", "left_anti").limit(1))
    if not bad.isEmpty():
        raise ValueError("triples with unknown ids")
    return triples


def encode_names(names: DataFrame, name: str = "name") -> DataFrame:
    """name, id: each distinct name's place in the order of names. Ranges are numbered side by side:
    the number of names in the ranges before is added to the place within a range."""
    return numbered(names.select(F.col(name).alias("name")).distinct(), "name")


def numbered(rows: DataFrame, *by: str, name: str = "id", start: int = 0) -> DataFrame:
    """rows with their place in the order of the columns, from start on. Ranges are written out before they
    are counted, so that both readers see the same ones, and are numbered side by side."""
    part, raw = "__part", "__raw"
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(raw, F.monotonically_increasing_id())
    ranged = ranged.withColumn(part, F.shiftright(raw, 33)).withColumn(raw, F.col(raw).bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = kept(ranged)
    sizes = ranged.groupBy(part).agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col(f"b.{part}") < F.col(f"a.{part}"), "left").groupBy(f"a.{part}").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))  # one row a partition
    return ranged.join(F.broadcast(before), part).withColumn(name, F.col(raw) + F.col("before") + start).drop(part, raw, "before")


def kept(df: DataFrame) -> DataFrame:
    """df, written out once: what follows is cut off from its plan. The folder is the session's; one beside
    the warehouse will do on one machine."""
    session = df.sparkSession
    if session.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        session.sparkContext.setCheckpointDir(shared_base(session))
    return df.checkpoint()


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. On one machine a
    folder beside the warehouse stands in; on a cluster there must be one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
    return base.rstrip("/")


def empty_index(spark: SparkSession) -> DataFrame:
    """name, id of an index without names."""
    return spark.range(0).select(F.col("id").cast("string").alias("name"), "id")


def registered(index: DataFrame, names: DataFrame) -> DataFrame:
    """index(name, id) with the names of names(name, and id where one is given) that it lacks. A name that
    it has keeps its id, whatever is asked for; new names without an id get the next numbers after the
    index's size, in the order of names. ValueError where two names would share an id."""
    new = names.select("name", F.col("id").cast("long") if "id" in names.columns else F.lit(None).cast("long").alias("id"))
    new = new.filter("name is not null").groupBy("name").agg(F.min("id").alias("id")).join(index.select("name"), "name", "left_anti")
    given = new.filter("id is not null").select("name", "id")
    held = index.select("name", "id").unionByName(given)
    out = held.unionByName(numbered(new.filter("id is null").select("name"), "name", start=held.count()).select("name", "id"))
    if not out.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("two names share an id")
    return out


def sizes(entities: DataFrame, relations: DataFrame) -> tuple[int, int]:
    """How many entities and relations an index has."""
    return entities.count(), relations.count()


def write_index(entities: DataFrame, relations: DataFrame, path: str) -> None:
    """One JSON object {"e": {name: id}, "r": {name: id}} as a text file; meant for indexes that fit a document."""
    side = lambda df, k: df.agg(F.map_from_entries(F.collect_list(F.struct("name", F.col("id").cast("long")))).alias(k))
    side(entities, "e").crossJoin(side(relations, "r")).select(F.to_json(F.struct("e", "r")).alias("value")).coalesce(1).write.text(path)  # one row each


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """entities and relations (name, id) of an index file."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "e MAP<STRING,BIGINT>, r MAP<STRING,BIGINT>").alias("x"))
    side = lambda k: whole.select(F.explode(f"x.{k}").alias("name", "id"))
    return side("e"), side("r")


def id_names(entities: DataFrame, relations: DataFrame, rel_dup: bool = False) -> tuple[DataFrame, DataFrame]:
    """id and name columns of the tab-separated dumps. Relations are numbered without their inverses;
    with rel_dup inverse names are listed too, under the same number."""
    r = relations if rel_dup else relations.filter(F.col("id") % 2 == 0)
    return entities.select("id", "name"), r.select(F.floor(F.col("id") / 2).alias("id"), "name")


def write_id_names(entities: DataFrame, relations: DataFrame, to: str, rel_dup: bool = False) -> None:
    for kind, df in zip(("entities", "relations"), id_names(entities, relations, rel_dup)):
        df.write.option("sep", "\t").option("quote", "").csv(f"{to}/{kind}")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """lstr (canonical), instance_id, bindings, easy, hard of a query-answer file. Instances of strings
    with one canonical form are kept together."""
    kind = "MAP<STRING,ARRAY<STRUCT<b:MAP<STRING,BIGINT>,e:MAP<STRING,ARRAY<BIGINT>>,h:MAP<STRING,ARRAY<BIGINT>>>>>"
    # each instance is a list of three maps of two kinds, so it is read as text first
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "MAP<STRING,ARRAY<ARRAY<STRING>>>")).alias("raw", "items"))
    rows = raw.select("raw", F.posexplode("items").alias("pos", "x"))
    names = {r["raw"]: canonical(r["raw"]) for r in raw.select("raw").distinct().collect()}  # one row per shape
    lstr = F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("raw")) if names else F.lit(None).cast("string")
    part = lambda i, kind: F.from_json(F.get("x", F.lit(i)), kind)
    return rows.select(
        lstr.alias("lstr"), F.xxhash64("raw", "pos").alias("instance_id"), part(0, "MAP<STRING,BIGINT>").alias("bindings"),
        part(1, "MAP<STRING,ARRAY<BIGINT>>").alias("easy"), part(2, "MAP<STRING,ARRAY<BIGINT>>").alias("hard"),
    )


def by_shape(answers: DataFrame, shapes: list[str] = ()) -> DataFrame:
    """The instances of the canonical strings; none given means all."""
    return answers.filter(F.col("lstr").isin(*shapes)) if shapes else answers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Type codes of the star graph's entities; id = code * 10^9 + key.
CODES = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "orders": 6}
#: Its forward relations: id, table, head (type, key column), tail.
STAR = [
    (0, "customer", ("customer", "c_custkey"), ("nation", "c_nationkey")),
    (2, "nation", ("nation", "n_nationkey"), ("region", "n_regionkey")),
    (4, "orders", ("customer", "o_custkey"), ("orders", "o_orderkey")),
    (6, "lineitem", ("orders", "l_orderkey"), ("part", "l_partkey")),
    (8, "lineitem", ("supplier", "l_suppkey"), ("part", "l_partkey")),
    (10, "supplier", ("supplier", "s_suppkey"), ("nation", "s_nationkey")),
]


def with_inverse(triples: DataFrame) -> DataFrame:
    """Each triple also the other way, under the inverse relation."""
    back = triples.select(F.col("t").alias("h"), F.col("r").bitwiseXOR(F.lit(1)).alias("r"), F.col("h").alias("t"))
    return triples.select("h", "r", "t").unionByName(back)


def star(spark: SparkSession, sf_dir: str, relations: list[int] | None = None, distinct: bool = True) -> DataFrame:
    """h, r, t of the star graph, inverses included. With relations only the tables of these are read, in
    the directions that are asked for; without distinct a triple may come as often as its row."""
    out = None
    for r, name, (hk, hc), (tk, tc) in STAR:
        for way in (r, r ^ 1):
            if relations is not None and way not in relations:
                continue
            end = lambda k, c: (F.lit(CODES[k] * 10**9).cast("long") + F.col(c).cast("long"))
            h, t = (end(hk, hc), end(tk, tc)) if way == r else (end(tk, tc), end(hk, hc))
            part = _table(spark, sf_dir, name).select(h.alias("h"), F.lit(way).cast("long").alias("r"), t.alias("t"))
            part = part.distinct() if name == "lineitem" and distinct else part
            out = part if out is None else out.unionAll(part)
    return spark.range(0).select(*(F.col("id").alias(c) for c in "hrt")) if out is None else out


def entity_ids(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("h", "t")).alias("id")).distinct()


def vector_graph(spark: SparkSession, sf_dir: str, relations: list[int] | None = None, both: bool = False, distinct: bool = True) -> DataFrame:
    """h, r, t of the graph over the embeddings: forward relations, and the inverse ones with both. With
    relations the table is filtered before anything is computed of it."""
    n = _table(spark, sf_dir, "embeddings").count()
    out = None
    for inverse in (0, 1) if both else (0,):
        rows = _table(spark, sf_dir, "lineitem")
        if relations is not None:
            rows = rows.filter(F.col("l_linenumber").isin([r // 2 + 1 for r in relations if r % 2 == inverse]))
        h, t = F.col("l_partkey") % n, F.col("l_suppkey") % n
        part = rows.select((t if inverse else h).alias("h"), (2 * (F.col("l_linenumber") - 1) + inverse).cast("long").alias("r"), (h if inverse else t).alias("t"))
        part = part.distinct() if distinct else part
        out = part if out is None else out.unionAll(part)
    return out


def write_graph(triples: DataFrame, path: str, files: int | None = None) -> None:
    """Triples as Parquet, a folder a relation, in the order of heads: a reader of some relations opens
    their folders only, and row groups far from a head are skipped. A large relation is dealt over files
    by ranges of heads."""
    ranged = triples.repartitionByRange(files, "r", "h") if files else triples.repartitionByRange("r", "h")
    ranged.sortWithinPartitions("r", "h", "t").write.partitionBy("r").parquet(path)


def read_graph(spark: SparkSession, path: str, relations: list[int] | None = None) -> DataFrame:
    """h, r, t of a graph that write_graph wrote."""
    rows = spark.read.schema("h long, t long, r long").parquet(path)
    rows = rows if relations is None else rows.filter(F.col("r").isin(list(relations)))
    return rows.select("h", "r", "t")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, emb (doubles) of entities; relation r has the vector of entity r."""
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("emb"))


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """A stored predictor's table (id, emb)."""
    return spark.read.parquet(path).select(F.col("id").cast("long"), F.col("emb").cast("array<double>"))


def binding_rows(spark: SparkSession, instances: list[dict[str, int]]) -> DataFrame:
    """query_id and a column per name from a short list of bindings."""
    names = sorted({k for x in instances for k in x})
    if any(set(x) != set(names) for x in instances):
        raise ValueError("instances bind different names")
    rows = F.array(*(F.struct(F.lit(i).cast("long").alias("query_id"), *(F.lit(x[n]).cast("long").alias(n) for n in names)) for i, x in enumerate(instances)))
    return spark.range(1).select(F.explode(rows).alias("x")).select("x.*")


def parse_index(text: str) -> dict[str, dict[str, int]]:
    """The same index on the driver, checked to be one-to-one."""
    out = json.loads(text)
    for side in ("e", "r"):
        if len(set(out[side].values())) < len(out[side]):
            raise ValueError("two names share an id")
    return out
