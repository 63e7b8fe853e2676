"""Quality rules as a short-circuit cascade, DataFrame functions only.

Each rule is a boolean column over the text, with the work that it does on a row: characters and words
that it touches, weighted by what one takes. On a sample one job adds up, for each set of rules that
reject a row together, the rows and every rule's work there. The order is then built rule by rule: of
those left, the one comes next that rejects most per work among the rows that no earlier rule rejects.
One CASE expression evaluates the rules in that order; a row that one rule rejects is spared the others.
The verdict (any rule rejects) doesn't depend on the order, and the order is the same on every run.

Defined cases: a null text counts as the empty text, which too_few_words rejects. Very long texts are
judged whole. Ties of two rules go to the one that is declared first. Repeated rows and ids are judged one
by one. accepted() passes all columns through, whatever their names; the columns that cascade() adds
replace others of their names. An empty table has the order of the declaration.
"""
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, let

#: Words in a repeated window.
WINDOW = 5
#: Rows of the sample on which work and selectivities are estimated; it decides the order only.
SAMPLE_ROWS = 2000
#: Time per character or word, in units of a pattern of single capitals per character (about 10 ns, as
#: measured once on 25 million characters); and what a comparison takes.
WORK, READ = {"pattern": 1.0, "marks": 0.4, "lines": 0.35, "windows": 70.0, "length": 0.05}, 2.0


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column
    #: What it does on a row, in about the time that a regular expression takes for a character.
    work: Column


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def symbols_of(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", "")).cast("long")


def dup_lines_of(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _covered(hashes: Column) -> Column:
    """Words under the windows whose hash is in the array twice or more."""
    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    steps = lambda at: F.transform(at, lambda p, j: F.when(j == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), p - F.get(at, j - 1))))
    total = lambda at: F.aggregate(steps(at), F.lit(0), lambda a, x: a + x)
    return let(let(by_hash, twice), total)


def repeat_words_of(words: Column) -> Column:
    """Words in 5-word windows that are in the text twice or more, the first ones included. Windows
    are compared by 64-bit hashes of their words' 64-bit hashes; only texts in which some window
    recurs pay for the sort that finds out where."""

    def windows(w: Column) -> Column:
        starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, WINDOW))))

    hashes = let(F.transform(words, lambda x: F.xxhash64(x)), windows)
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(h))).cast("long")


def default_rules(text: Column, words: Column, repeat_words: Column | None = None, symbols: Column | None = None, dup_lines: Column | None = None) -> list[Rule]:
    """Columns that are given are used; the others are computed where a rule needs them."""
    text = F.coalesce(text, F.lit(""))
    n = F.size(words).cast("long")
    chars = F.length(text).cast("double")
    read = F.lit(READ)
    windows_work = read if repeat_words is not None else read + WORK["windows"] * n
    symbols_work = read if symbols is not None else read + WORK["marks"] * chars
    lines_work = read if dup_lines is not None else read + WORK["lines"] * chars
    repeat_words = repeat_words_of(words) if repeat_words is None else repeat_words
    symbols = symbols_of(text) if symbols is None else symbols
    dup_lines = dup_lines_of(text) if dup_lines is None else dup_lines
    return [
        Rule("too_few_words", n < 10, read),
        Rule("repeated_windows", 100 * repeat_words > 20 * n, windows_work),
        Rule("symbols", 10 * symbols > 3 * n, symbols_work),
        Rule("shouting", 2 * F.length(F.regexp_replace(text, r"[^A-Z]+", "")) > F.length(text), read + WORK["pattern"] * chars),
        Rule("exclamations", 2 * F.length(F.regexp_replace(text, r"[^!]+", "")) > n, read + WORK["pattern"] * chars),
        Rule("duplicate_lines", (dup_lines >= 3) & (2 * dup_lines > F.size(F.split(text, "\n", -1))), lines_work + WORK["lines"] * chars),
        Rule("word_length", (F.length(text) > 30 * n) | (F.length(text) < 2 * n), read + WORK["length"] * chars),
    ]


def measured_order(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """rules, each the best for the rows of the sample that the rules before it leave."""
    rejects = sum((F.when(r.rejects, F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(rules)), F.lit(0))
    found = sample.select(rejects.alias("__set"), *(r.work.alias(f"__work{k}") for k, r in enumerate(rules)))
    found = found.groupBy("__set").agg(F.count("*").alias("__n"), *(F.sum(f"__work{k}").alias(f"__work{k}") for k in range(len(rules))))
    return greedy([(r["__set"], r["__n"], [r[f"__work{k}"] for k in range(len(rules))]) for r in found.collect()], rules)  # 2^rules rows at most


def greedy(found: list[tuple[int, int, list[float]]], rules: list[Rule]) -> list[Rule]:
    """found: which rules (bits) reject so many rows together, and every rule's work on these."""
    out: list[Rule] = []
    left = list(range(len(rules)))
    while left:
        def gain(k: int) -> float:
            return sum(n for s, n, _ in found if s >> k & 1) / max(sum(w[k] for _, _, w in found), 1e-9)

        best = max(left, key=lambda k: (gain(k), -k))
        out.append(rules[best])
        left.remove(best)
        found = [x for x in found if not x[0] >> best & 1]
    return out


def verdict(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects the row, or null."""
    out = None
    for r in rules:
        out = F.when(r.rejects, r.name) if out is None else out.when(r.rejects, r.name)
    return out


def with_words(docs: DataFrame, text: str, words: str) -> DataFrame:
    return docs.withColumn(words, words_of(F.col(text)))


def cascade(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS, rules=default_rules) -> DataFrame:
    """docs with rejected_by (string, null if kept) and kept (boolean)."""
    first = _verdict(docs, text, sample_rows, rules)
    return docs.withColumn("rejected_by", first).withColumn("kept", F.col("rejected_by").isNull())


def accepted(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS, rules=default_rules) -> DataFrame:
    """docs without the rows that some rule rejects."""
    return docs.filter(_verdict(docs, text, sample_rows, rules).isNull())


def _verdict(docs: DataFrame, text: str, sample_rows: int, rules) -> Column:
    names = [r.name for r in ordered(docs, text, sample_rows, rules)]

    def first(words: Column) -> Column:
        made = {r.name: r for r in rules(F.col(text), words)}
        return verdict([made[n] for n in names])

    # the words are bound once: a projection of them would be copied into every rule that is pushed below it
    return let(words_of(F.col(text)), first)


def ordered(docs: DataFrame, text: str, sample_rows: int, rules) -> list[Rule]:
    words = fresh(docs, "__words")
    return measured_order(with_words(sampled(docs, text, sample_rows), text, words), rules(F.col(text), F.col(words)))


def sampled(docs: DataFrame, text: str, rows: int) -> DataFrame:
    """About so many rows from all over docs, the same however these are partitioned: those with the least
    hashes of text and id. The order of rules is all that hangs on them."""
    n = docs.count()
    key = F.xxhash64(*({"doc_id": None, text: None} if "doc_id" in docs.columns else [text]))
    return docs.filter(F.pmod(key, F.lit(1 << 40)) < int((1 << 40) * min(1.0, rows / max(n, 1))))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the words."""
    out = with_words(docs, text, "__words")
    return (
        out.withColumn("n_words", F.size("__words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
        .withColumn("n_symbols", symbols_of(F.col(text)))
        .withColumn("n_dup_lines", dup_lines_of(F.col(text)))
        .withColumn("n_repeat_words", repeat_words_of(F.col("__words")))
    )


def report(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The measures of every document beside the cascade's verdict. All measures are asked for, so the
    rules read them, and it is these rules, whose work is less, that are put in order."""
    made = lambda: default_rules(F.col("text"), F.col("__words"), F.col("n_repeat_words"), F.col("n_symbols"), F.col("n_dup_lines"))
    own = docs.select("doc_id", "text")
    order = measured_order(measures(sampled(own, "text", sample_rows)), made())
    out = measures(own).withColumn("rejected_by", verdict(order))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("rejected_by").isNull()).alias("kept"),
    )
