r"""Benchmark decontamination by canonical templates, DataFrame functions only.

Texts become lower-case tokens without punctuation. In a template, numbers, names (capitalised words
inside a sentence) and units behind a number give way to typed placeholders. Windows of WINDOW template
tokens with LITERALS or more words that are no placeholders are hashed; documents' windows meet those of
the benchmark in a hash join. For each document, item and alignment the slots behind the placeholders
are then compared: for each value of the item, the value that stands for it most often in the document
counts, and for each value of the document the one that it stands for most often; windows with another one
are dropped unless they are the item's word for word. So a question with other numbers or names is found,
and so is one with a single value edited. Names are matched as plain words too, for copies that lost their
capitals.

A document is contaminated by an item if SHARE of the item's windows are found in consistent places, or
a run of RUN words of it. Items of fewer than WINDOW tokens, or without a window of enough words, have no
windows: they match lines and sentences of a document as a whole. Characters of scripts without spaces
are tokens each.

Defined cases: null and empty texts are clean. Items without windows that stand inside a longer sentence
can't be told from chance and don't match. Items with equal templates are each checked
and reported; where one of them stands word for word, only those that do are reported there. Ties of values
go to the item's own, then to the first in the alphabet. Very long texts are read whole. Rows that share a
doc_id are judged each by its own text. clean() passes all columns through, whatever their names; the
columns that flagged() adds replace others of their names. Rows are known by 128 bits of id and text.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, let, stored

WINDOW, LITERALS, SHARE = 8, 4, 0.3
#: Words of a consistent run that count whatever the item's length.
RUN = 50
#: Words that are no placeholders from which an item without windows matches with other slots too.
SHORT_LITERALS = 2
#: Scripts without spaces between words: Thai to Tibetan, Burmese, Khmer, kana, Han.
UNSPACED = r"[\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}]"
#: One range with all of them, which is quicker to look for.
BEYOND = r"[\u0E00-\x{3FFFF}]"
#: Ends of lines and sentences.
BREAK = r"[\n\r]+|(?<=[.!?])[\x20\t]+|[。！？]"
#: Windows of the benchmark up to which they are broadcast (under 50 bytes each); beyond it both sides are shuffled.
BROADCAST_WINDOWS = 200_000
#: The same for ids of documents, of 8 bytes.
BROADCAST_IDS = 500_000
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
#: Units that count as such behind a number.
UNITS = "mm cm m km inch inches ft feet yard yards mile miles mg g kg lb lbs ton tons ml cl l liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years cent cents dollar dollars usd euro euros eur pound pounds percent".split()


def row_of(text: str) -> Column:
    """What a row is known by: 128 bits of its id and text."""
    return F.struct(F.xxhash64("doc_id", text).alias("a"), F.xxhash64(F.lit(1), text, "doc_id").alias("b"))


def plain(text: Column) -> Column:
    """Lower-case tokens joined by single spaces, characters of UNSPACED one by one; names carry NAME in front."""
    text = F.coalesce(text, F.lit(""))
    text = F.when(text.rlike(BEYOND), F.regexp_replace(text, UNSPACED, " $0 ")).otherwise(text)
    text = F.regexp_replace(text, r"\p{Lu}(?<=[\p{Ll},;][ ]\p{Lu})(?=\p{Ll})", NAME + "$0")
    text = F.regexp_replace(text, r"[.,](?<=[0-9][.,])(?=[0-9])", "")
    return F.trim(F.lower(F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}{NAME}]+", " ")))


def template(tokens: Column) -> Column:
    """Of plain(): every name, number and unit as its placeholder."""
    out = F.regexp_replace(tokens, rf"{NAME}[^ ]+", NAME)
    out = F.regexp_replace(out, r"(?<![^ ])[0-9][^ ]*", NUMBER)
    out = F.regexp_replace(out, rf"(?<={NUMBER} )(?:{'|'.join(UNITS)})(?![^ ])", UNIT)
    return F.when(tokens.rlike(rf"[0-9{NAME}]"), out).otherwise(tokens)


def unnamed(tokens: Column) -> Column:
    """Of plain(): names as plain words; null where there are none."""
    return F.when(F.contains(tokens, F.lit(NAME)), F.replace(tokens, F.lit(NAME), F.lit("")))


def windows(tokens: Column) -> Column:
    """[hash of the window at each position], null where it has too few words."""
    slot = [F.xxhash64(F.lit(x)) for x in (NAME, NUMBER, UNIT)]

    def of(h: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            return F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW)))

        return F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), one)

    def checked(h: Column) -> Column:
        words = lambda i: F.size(F.filter(F.slice(h, i + 1, WINDOW), lambda y: ~y.isin(slot)))
        return F.transform(of(h), lambda x, i: F.when(words(i) >= LITERALS, x))

    hashes = F.transform(F.split(tokens, " "), lambda x: F.xxhash64(x))
    some = tokens.rlike(f"[{NAME}{NUMBER}{UNIT}]")
    return F.when(some, let(hashes, checked)).otherwise(let(hashes, of))


def _located(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, window of rows(keys, tokens): all template windows, and plain ones where names are."""
    ready = rows.select(*keys, template(F.col("tokens")).alias("template"), template(unnamed(F.col("tokens"))).alias("bare"))
    both = F.array(windows(F.col("template")), F.when(F.col("bare").isNotNull(), windows(F.col("bare"))))
    return ready.select(*keys, F.explode(both).alias("w")).select(*keys, F.posexplode("w").alias("pos", "window")).filter("window is not null")


def _slots(tokens: Column, template_tokens: Column, pos: Column) -> Column:
    """[(place, value)] of the placeholders in a window."""
    kinds = F.slice(template_tokens, pos + 1, WINDOW)
    at = F.transform(kinds, lambda x, i: F.when(x.isin(NAME, NUMBER, UNIT), F.struct(i.alias("place"), F.replace(F.get(tokens, pos + i), F.lit(NAME), F.lit("")).alias("value"))))
    return F.filter(at, lambda x: x.isNotNull())


def _keyed(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, tokens without NAME, key: the template, and the one with names as plain words where they are."""
    both = F.array_distinct(F.array_compact(F.array(template(F.col("tokens")), template(unnamed(F.col("tokens"))))))
    return rows.select(*keys, F.replace("tokens", F.lit(NAME), F.lit("")).alias("tokens"), F.explode(both).alias("key"))


def _segments(text: Column) -> Column:
    """plain() of each line or sentence that has tokens."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), BREAK), plain), lambda x: x != "")


def short_matches(docs: DataFrame, short: DataFrame, text: str) -> DataFrame:
    """matches() for items without windows, of short(item_id, text): whole lines and sentences with the
    item's template and slots that agree, or that equal the item."""
    items = short.select("item_id", _segments(F.col("text")).alias("parts")).filter(F.size("parts") > 0)
    items = items.select("item_id", F.size("parts").alias("k"), F.array_join("parts", " ").alias("tokens"))
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())
    if not sizes:
        return docs.select(row_of(text).alias("rid"), F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("share"), F.lit(False).alias("reparameterised")).limit(0)

    def runs(parts: Column, k: int) -> Column:
        return F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - (k - 1), F.lit(0))), lambda x, i: F.array_join(F.slice(parts, i + 1, k), " "))

    segments = let(_segments(F.col(text)), lambda parts: F.array_distinct(F.concat(*(runs(parts, k) for k in sizes))))
    rows = _keyed(docs.select(row_of(text).alias("rid"), F.explode(segments).alias("tokens")), "rid")
    known = stored(_keyed(items, "item_id").select("item_id", F.col("tokens").alias("own"), "key").distinct())
    met = rows.join(F.broadcast(known) if known.count() <= BROADCAST_WINDOWS else known, "key")
    slot = lambda x: x.isin(NAME, NUMBER, UNIT)
    pairs = F.transform(F.split("key", " "), lambda x, i: F.when(slot(x), F.struct(F.get(F.split("own", " "), i).alias("own"), F.get(F.split("tokens", " "), i).alias("doc"))))
    met = met.withColumn("pairs", F.array_distinct(F.filter(pairs, lambda x: x.isNotNull()))).withColumn("exact", F.col("own") == F.col("tokens"))
    agrees = (F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: x["own"])))) & (F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: x["doc"]))))
    words = F.size(F.filter(F.split("key", " "), lambda x: ~slot(x)))
    met = met.filter(F.col("exact") | (agrees & (words >= SHORT_LITERALS)))
    met = met.withColumn("copied", F.max("exact").over(Window.partitionBy("rid", "key", "tokens"))).filter(F.col("exact") | ~F.col("copied"))
    return met.groupBy("rid", "item_id").agg(F.lit(1.0).alias("share"), F.max(~F.col("exact")).alias("reparameterised"))


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """rid (row_of a document), item_id, share, reparameterised, for documents and items
    that match."""
    items = benchmark.select(F.col("item_id").cast("long"), "text", plain(F.col("text")).alias("tokens")).filter("tokens <> ''").dropDuplicates(["item_id", "tokens"])
    same, bare = template(F.col("tokens")), F.coalesce(template(unnamed(F.col("tokens"))), F.lit(""))
    items = stored(items.withColumn("item", F.xxhash64("item_id", "tokens")).withColumn("same", F.xxhash64(same)).withColumn("form", F.xxhash64(same, bare)))
    # windows are those of a form; its items differ in numbers and units only and meet the documents below
    forms = items.groupBy("form").agg(F.min("tokens").alias("tokens"))
    located = stored(_located(forms, "form").withColumnRenamed("pos", "at").dropDuplicates(["window", "form", "at"]))
    total = located.groupBy("form").agg(F.countDistinct("at").alias("total"))
    rows = docs.select(row_of(text).alias("rid"), plain(F.col(text)).alias("tokens"))
    found = _located(rows, "rid")
    known = located.select("window", "form", "at")
    hits = stored(found.join(F.broadcast(known) if known.count() <= BROADCAST_WINDOWS else known, "window").select("rid", "form", "pos", "at").distinct())
    # the slots only take windows away: what has too few with them has too few without; a run of RUN words
    # has as many windows at least as lie end to end in it
    enough = F.least(SHARE * F.col("total"), F.lit(float(-(-(RUN - WINDOW) // WINDOW) + 1)))
    likely = hits.groupBy("rid", "form").agg(F.countDistinct("at").alias("n")).join(total, "form").filter(F.col("n") >= enough).select("rid", "form", "total")
    hits = stored(hits.join(likely, ["rid", "form"]).join(items.select("form", "same", "item", "item_id"), "form").withColumn("shift", F.col("pos") - F.col("at")))

    with_item = hits.select("rid", "item", "pos", "at", "shift").join(items.select("item", F.split("tokens", " ").alias("t_item"), F.split(template(F.col("tokens")), " ").alias("s_item")), "item")
    with_item = with_item.withColumn("item_slots", _slots(F.col("t_item"), F.col("s_item"), F.col("at")))
    with_item = stored(with_item.filter(F.size("item_slots") > 0).select("rid", "item", "pos", "at", "shift", "item_slots"))
    # only documents with slots in their hits are looked at again; their ids are broadcast as far as the bound goes
    wanted = stored(with_item.select("rid").distinct())
    few = wanted.count() <= BROADCAST_IDS
    keyed = docs.select(row_of(text).alias("rid"), F.col(text).alias("text")).join(F.broadcast(wanted) if few else wanted, "rid", "left_semi")
    hit_rows = keyed.dropDuplicates(["rid"]).select("rid", F.split(plain(F.col("text")), " ").alias("t_rid"))
    slots = with_item.join(hit_rows, "rid")
    slots = slots.select("rid", "item", "at", "shift", F.explode(F.transform("item_slots", lambda x: F.struct((F.col("at") + x["place"]).alias("place"), x["value"].alias("own"), F.replace(F.get("t_rid", F.col("pos") + x["place"]), F.lit(NAME), F.lit("")).alias("doc")))).alias("v"))
    # along each alignment, the value of the document that stands most often for a value of the item, and the
    # value of the item that one of the document stands for most often
    values = slots.select("rid", "item", "at", "shift", "v.place", "v.own", "v.doc").repartition("rid", "item")
    alignment = ["rid", "item", "shift"]
    values = values.withColumn("n", F.size(F.collect_set("place").over(Window.partitionBy(*alignment, "own", "doc"))))
    usual = F.first("doc").over(Window.partitionBy(*alignment, "own").orderBy(F.desc("n"), F.desc(F.col("doc") == F.col("own")), "doc"))
    source = F.first("own").over(Window.partitionBy(*alignment, "doc").orderBy(F.desc("n"), F.desc(F.col("doc") == F.col("own")), "own"))
    other = F.max(F.col("doc") != F.col("own")).alias("other")
    checked = values.withColumn("usual", usual).withColumn("source", source).groupBy(*alignment, "at").agg(F.min((F.col("doc") == F.col("usual")) & (F.col("own") == F.col("source"))).alias("agrees"), other)
    judged = hits.join(checked, [*alignment, "at"], "left").withColumn("other", F.coalesce("other", F.lit(False)))
    # where an item stands word for word, it isn't also another item of its template with changed slots
    exact = ~F.max("other").over(Window.partitionBy("rid", "same", "shift", "item")) & (F.count("*").over(Window.partitionBy("rid", "same", "shift", "item")) >= enough)
    judged = judged.repartition("rid", "same").withColumn("exact", exact).withColumn("copied", F.max("exact").over(Window.partitionBy("rid", "same", "shift")))
    kept = judged.filter((F.coalesce("agrees", F.lit(True)) | ~F.col("other")) & (F.col("exact") | ~F.col("copied")))
    # windows that overlap or touch along an alignment form a run: each of its words is in one of them
    line = Window.partitionBy(*alignment)
    starts = F.coalesce(F.col("at") - F.lag("at").over(line.orderBy("at")) > WINDOW, F.lit(True)).cast("int")
    kept = kept.withColumn("starts", starts).withColumn("chain", F.sum("starts").over(line.orderBy("at")))
    kept = kept.withColumn("run", F.col("at") - F.min("at").over(Window.partitionBy(*alignment, "chain")) + WINDOW)
    per = kept.groupBy("rid", "item", "item_id", "total").agg(F.countDistinct("at").alias("n"), F.max("run").alias("run"), F.max("other").alias("reparameterised"))
    per = per.withColumn("share", F.col("n") / F.col("total")).filter((F.col("share") >= SHARE) | (F.col("run") >= RUN)).select("rid", "item_id", "share", "reparameterised")
    short = stored(items.join(total, "form", "left_anti").select("item_id", "text"))
    if not short.isEmpty():
        per = per.unionByName(short_matches(docs, short, text))
    return per.groupBy("rid", "item_id").agg(F.max("share").alias("share"), F.max("reparameterised").alias("reparameterised"))


def _found(docs: DataFrame, benchmark: DataFrame, text: str) -> tuple[DataFrame, bool]:
    """What is known of the contaminated rows, by rid, and whether it can be broadcast: as many as the
    benchmark leaked into; beyond the bound both sides are shuffled."""
    found = stored(matches(docs, benchmark, text).groupBy("rid").agg(
        F.count("*").alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("item_ids"), F.max("share").alias("share"), F.max("reparameterised").alias("reparameterised")
    ))
    return found, found.count() <= BROADCAST_WINDOWS


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without the contaminated rows."""
    found, few = _found(docs, benchmark, text)
    rid = fresh(docs, "__rid")
    found = found.select(F.col("rid").alias(rid))
    return docs.withColumn(rid, row_of(text)).join(F.broadcast(found) if few else found, rid, "left_anti").select(*docs.columns)


def flagged(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs with contaminated (boolean), n_items (long), item_ids (ascending), share (the largest) and
    reparameterised (whether some item matches with other slots)."""
    found, few = _found(docs, benchmark, text)
    added = ("contaminated", "n_items", "item_ids", "share", "reparameterised")
    own = [c for c in docs.columns if c.lower() not in added]
    rid, what = fresh(docs, "__rid"), fresh(docs, "__what")
    found = found.select(F.col("rid").alias(rid), F.struct("n_items", "item_ids", "share", "reparameterised").alias(what))
    out = docs.withColumn(rid, row_of(text)).join(F.broadcast(found) if few else found, rid, "left")
    of = lambda name, default: F.coalesce(F.col(what)[name], default).alias(name)
    return out.select(
        *own, F.col(what).isNotNull().alias("contaminated"), of("n_items", F.lit(0)).cast("long").alias("n_items"),
        of("item_ids", F.array().cast("array<bigint>")), of("share", F.lit(0.0)), of("reparameterised", F.lit(False)),
    )


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return flagged(docs.select("doc_id", "text"), benchmark).drop("text")
