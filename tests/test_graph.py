"""Parser, rewrites, exact plans and sources."""
import json
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillgraph.operators import metric, scoring
from quillgraph.plans import exact, language
from quillgraph.plans.language import And, Atom, Not, Or
from quillgraph.sources import graph


@pytest.mark.parametrize("text", ["", "r1(x1,f)", "r1(s1, f)", "!(a(s1,f)&b(s2,f))", "r1(s1,f)&", "(r1(s1,f)", "r1(s1)", "r1(s1,f))", "!!r(s1,f)"])
def test_bad_queries(text):
    with pytest.raises(ValueError):
        language.parse(text)


_atoms = st.sampled_from([Atom(f"r{i}", "s1", "f") for i in range(5)])
_formulas = st.recursive(_atoms, lambda sub: st.one_of(sub.map(Not), st.tuples(sub, sub).map(And), st.tuples(sub, sub).map(Or)), max_leaves=6)


def holds(f, truth):
    if isinstance(f, Atom):
        return truth[f.relation]
    if isinstance(f, Not):
        return not holds(f.part, truth)
    return (all if isinstance(f, And) else any)(holds(p, truth) for p in f.parts)


@settings(max_examples=60, deadline=None)
@given(_formulas)
def test_normal_form_means_the_same(f):
    n = language.normal_form(f)
    for values in product([False, True], repeat=5):
        truth = {f"r{i}": v for i, v in enumerate(values)}
        assert holds(f, truth) == holds(n, truth)


def test_catalogue_prints_and_reads_back():
    for text in language.CATALOGUE.values():
        once = language.canonical(text)
        assert language.canonical(once) == once
    assert len(language.NAMES) == 26 and len(set(language.NAMES.values())) == 25


def test_flagship(spark):
    assert entry.entry(spark).count() == 24


def test_unsafe_variable_and_contradiction(spark):
    kg = spark.createDataFrame([(1, 0, 2), (1, 0, 3), (4, 2, 3)], graph.TRIPLE)
    inst = graph.binding_rows(spark, [{"a": 0, "s1": 1}])
    ask = lambda t: sorted(r["f"] for r in exact.answers(language.Query.read(t, True), inst, kg, graph.entity_ids(kg)).collect())
    assert ask("!a(s1,f)") == [1, 4] and ask("a(s1,f)&!a(s1,f)") == []


def test_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1 0\t2\n 3  2 4 \n")
    t = graph.read_triples(spark, str(tmp_path / "t.txt"))
    assert sorted(map(tuple, t.collect())) == [(1, 0, 2), (3, 2, 4)]
    (tmp_path / "q.json").write_text(json.dumps({"r1(s1,f)": [[{"r1": 0, "s1": 1}, {"f": [2]}, {"f": [3, 4]}], [{"r1": 2, "s1": 3}, {"f": []}, {}]]}))
    rows = graph.read_answers(spark, str(tmp_path / "q.json"))
    assert rows.count() == 2 and rows.filter(F.size(F.col("hard")["f"]) == 2).count() == 1
    names = spark.createDataFrame([("x", 0), ("y", 1)], "name string, id long")
    graph.write_index(names, names, str(tmp_path / "index"))
    e, r = graph.read_index(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, e.collect())) == [("x", 0), ("y", 1)] == sorted(map(tuple, r.collect()))
    with pytest.raises(ValueError):
        graph.checked(t, names, names)


def test_metric_by_hand(spark):
    s = spark.createDataFrame([(0, i, v) for i, v in enumerate([0.9, 0.8, 0.7, 0.6, 0.5])], "query_id long, entity_id long, score double")
    a = spark.createDataFrame([(0, 0, False), (0, 2, True), (0, 3, True)], "query_id long, entity_id long, hard boolean")
    types = spark.createDataFrame([(0, "1p")], "query_id long, type string")
    r = metric.metrics(s, a, types).first()
    assert (r["mrr"], r["hit1"], r["hit3"], r["hit10"]) == (0.5, 0, 1, 1)
    with pytest.raises(ValueError):
        metric.metrics(s, a.filter("not hard"), types)


def test_column_and_arrow_scores_agree(spark):
    v = spark.createDataFrame([(i, [float(i % 3), float(i % 5)]) for i in range(20)], "id long, emb array<double>")
    top = scoring.top_tails(v.select(F.col("id").alias("query_id"), "emb"), v, 3)
    assert top.count() == 60 and top.filter("rank = 0").select(F.min("score")).first()[0] == 0.0
