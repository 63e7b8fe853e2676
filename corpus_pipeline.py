"""A corpus from raw documents: rules, near-duplicates, benchmark leaks, personal data, tokens.

Each stage takes the documents that the stage before kept and returns what it keeps; the last returns
the tokens. run() writes each stage's rows to the shared folder and reads them again.

Defined cases: the rules reject null and empty texts. Of rows that are equal in id and text one stays,
whatever other columns hold; rows without an id are compared by their texts. Very long texts go through
every stage whole. Columns beside doc_id and text pass through the first four stages, whatever their
names; n_chars, where there is one, follows the redacted text. Empty tables give empty results.
"""
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bpe, decontaminate, near_dedup, pii, quality_rules
from quillgraph.llm.common import discard, stored, table, written

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (similarity 0.8 of 5-word shingles) the least doc_id."""
    return near_dedup.deduplicated(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    out = pii.redacted(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("byte_bpe", tokens),
]

#: Not SQL: the stages learn trees, cut pieces by a pattern that DuckDB lacks and merge bytes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage has read and written on the way is deleted once its rows are stored."""
    docs = table(spark, sf_dir, "documents")
    done = len(written)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        discard(spark, written[done:-1])
    return docs
