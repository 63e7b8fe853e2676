"""The pipeline on small tables: every stage by itself against plain statements, then all of them."""
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as cp
from quillgraph.llm import bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans string, rid int, __words int"
LEAK = "A farmer of the northern valley sells his hay to three millers who live beside the long river and counts his coins each evening before supper"


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeilmnorstu") for _ in range(r.randint(2, 9))) for _ in range(n))


def rows():
    a, b, c = prose(1), prose(2), prose(3)
    texts = [
        (1, a), (2, a), (3, a.replace(" ", "  ").title()), (4, b + " mail x.y@mail.org now"), (4, b + " mail x.y@mail.org now"), (5, None), (6, ""), (7, "a b c"), (8, "same five words come again " * 20),
        (9, prose(9, 30) + " " + LEAK + " " + prose(10, 30)), (None, c), (None, c), (None, a), (10, prose(11, 20_000)), (11, prose(12) + ' password = "1eb9c654e721b4f812088970e66a6345"'),
    ]
    return [(i, t, "xx", "s", len(t or ""), "mine", "own", 42, 7) for i, t in texts]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, LEAK), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = [{4, 1, 9, 10, 11, 2, 3, None}, {1, 4, 9, 10, 11, None}, {1, 4, 10, 11, None}, {1, 4, 10, 11, None}]
    counts = [11, 6, 5, 5]
    for (name, stage), ids, n in zip(cp.STAGES[:4], want, counts):
        out = cp.stored(stage(spark, docs, sf_dir))
        assert out.schema == docs.schema, name
        got = out.collect()
        assert {r["doc_id"] for r in got} == ids and len(got) == n, name
        assert all((r["kept"], r["spans"], r["rid"], r["__words"]) == ("mine", "own", 42, 7) for r in got), name
        docs = out
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[4]["text"].endswith("mail [EMAIL] now") and by_id[11]["text"].endswith('password = "[SECRET]"')
    assert all(r["n_chars"] == len(r["text"]) for r in got) and len(by_id[10]["text"]) > 50_000
    ranks = bpe.read_ranks(cp.RANKS)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = set()
    for r in got:
        ids = np.array(lib.encode_ordinary(r["text"]), "<u4")
        expected.add((r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    assert {tuple(r) for r in cp.run(spark, sf_dir).collect()} == expected


def test_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name
