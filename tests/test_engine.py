"""Scoring, message passing, pruned plans, index registration, walks and streams against plain Python."""
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillgraph import streaming
from quillgraph.functions import predictors
from quillgraph.operators import beam, graphalgo, message, ragged, scoring
from quillgraph.plans import exact, language
from quillgraph.sources import graph

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_shapes_read_their_relations_only(spark):
    plan = plan_of(entry.queries()["shape_1p"](spark, SF))
    assert "nation.parquet" in plan and not any(t in plan for t in ("lineitem.parquet", "orders.parquet", "customer.parquet", "supplier.parquet"))
    plan = plan_of(entry.queries()["shape_2m"](spark, SF))
    assert "In(l_linenumber" in plan or "EqualTo(l_linenumber" in plan


def test_relations_are_looked_up_and_bounded(spark, monkeypatch):
    q = language.Query.read("r1(s1,e1)&r2(e1,f)")
    inst = graph.binding_rows(spark, [{"r1": 3, "s1": 10**9, "r2": 1}, {"r1": 3, "s1": 10**9 + 1, "r2": 1}])
    assert exact.relation_ids(q, inst) == {"r1": [3], "r2": [1]}
    asked = []
    of = lambda ids: asked.append(ids) or graph.star(spark, SF, ids)
    kg = graph.star(spark, SF)
    got = exact.answers(q, inst, of, graph.entity_ids(kg))
    assert asked == [[3], [1]] and set(map(tuple, got.collect())) == set(map(tuple, exact.answers(q, inst, kg, graph.entity_ids(kg)).collect()))
    monkeypatch.setattr(exact, "RELATIONS", 0)
    assert exact.relation_ids(q, inst) == {}
    assert graph.star(spark, SF, []).count() == 0


def test_stored_graph(spark, tmp_path):
    kg = graph.star(spark, SF)
    graph.write_graph(kg, f"{tmp_path}/kg", 4)
    back = graph.read_graph(spark, f"{tmp_path}/kg")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, kg.collect()))
    some = graph.read_graph(spark, f"{tmp_path}/kg", [3, 8])
    assert "PartitionFilters: [isnotnull(r" in plan_of(some) or "PartitionFilters: [r" in plan_of(some)
    assert some.count() == kg.filter("r in (3, 8)").count()


def test_index_registration(spark):
    make = lambda rows: spark.createDataFrame(rows, "name string, id long")
    held = graph.registered(graph.empty_index(spark), make([("b", None), ("a", None), ("a", None), (None, None)]))
    assert sorted(map(tuple, held.collect())) == [("a", 0), ("b", 1)] and graph.sizes(held, held.limit(1)) == (2, 1)
    more = graph.registered(held, make([("a", 9), ("c", 7), ("d", None)]))
    assert sorted(map(tuple, more.collect())) == [("a", 0), ("b", 1), ("c", 7), ("d", 3)]
    assert graph.registered(more, more).count() == 4
    for bad in ([("x", 1)], [("x", 3), ("y", None), ("z", None)], [("x", 50), ("y", 50)]):
        with pytest.raises(ValueError):
            graph.registered(held, make(bad))


def test_triples_of_strings_and_other_sizes(spark, tmp_path):
    (tmp_path / "t").write_text("a likes b\nc  knows\td\n")
    assert sorted(map(tuple, graph.read_triples(spark, str(tmp_path / "t"), to_int=False).collect())) == [("a", "likes", "b"), ("c", "knows", "d")]
    (tmp_path / "u").write_text("1 2 3 4\n1 2 3\n")
    assert [tuple(r) for r in graph.read_triples(spark, str(tmp_path / "u"), check=False, size=4).collect()] == [(1, 2, 3, 4)]


def vectors(spark):
    rows = graph.vectors(spark, SF).orderBy("id").collect()
    return np.array([r["emb"] for r in rows])


def turn(h, r):
    a, b, c, d = h[..., :32], h[..., 32:], r[..., :32], r[..., 32:]
    return np.concatenate([a * c - b * d, a * d + b * c], axis=-1)


def plain_scores(e, update):
    """Message passing on the shape 2p, by hand."""
    out = {}
    for q, s1 in enumerate((1, 5, 9)):
        x = np.stack([e[s1], np.full(64, 0.1), np.full(64, 0.1)])
        for _ in range(2):
            got = 0.1 * x
            for src, dst, rel in ((0, 1, 0), (1, 2, 2), (1, 0, 1), (2, 1, 3)):
                got[dst] += turn(x[src], e[rel])
            x = update(got)
        f = x[2]
        cos = e @ f / (np.linalg.norm(e, axis=1) * np.linalg.norm(f))
        out.update({(q, i): c for i, c in enumerate(cos)})
    return out


@pytest.mark.parametrize("name", ["message_scores", "message_scores_layers"])
def test_message_passing_equals_numpy(spark, name):
    e = vectors(spark)
    g = np.random.default_rng(3)
    layers = [g.normal(0, 0.1, (64, 64)) for _ in range(2)]
    update = (lambda x: np.maximum(x @ e.T, 0) @ e) if name == "message_scores" else (lambda x: np.maximum(x @ layers[0], 0) @ layers[1])
    want = plain_scores(e, update)
    got = {(r["query_id"], r["entity_id"]): r["score"] for r in entry.queries()[name](spark, SF).collect()}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 2e-6


def test_scale_and_bias_of_the_update(spark):
    e = np.arange(12.0).reshape(6, 2) / 7 - 0.6
    rows = [(i, [float(v) for v in x], 0.5 + i, -0.1 * i) for i, x in enumerate(e)]
    entities = spark.createDataFrame(rows, "id long, emb array<double>, scale double, bias double").repartition(3)
    nodes = spark.createDataFrame([(0, 0, 0, 2, [1.0, -2.0]), (1, 0, 0, 2, [0.5, 3.0])], "query_id long, conj_id int, node_id int, kind int, x array<double>")
    got = {r["query_id"]: r["x"] for r in message.biased_update(nodes, entities, 2).collect()}
    for q, x in ((0, [1.0, -2.0]), (1, [0.5, 3.0])):
        want = np.maximum((e @ x) * (0.5 + np.arange(6)) - 0.1 * np.arange(6), 0) @ e
        assert got[q] == pytest.approx(list(want))


def test_convolution_by_definition():
    m = predictors.ConvE.seeded(19, aspect=2, channels=3, filter_size=2, stride=2, padding=1, seed=4)
    assert (m.height, m.width) == (3, 6)
    g = np.random.default_rng(1)
    h, r, t = (g.normal(size=(5, 19)) for _ in range(3))
    for k in range(5):
        grid = np.zeros((8, 8))
        grid[1:7, 1:7] = np.vstack([h[k, 1:].reshape(3, 6), r[k, 1:].reshape(3, 6)])
        flat = []
        for c in range(3):
            for i in range(0, 7, 2):
                for j in range(0, 7, 2):
                    v = (grid[i : i + 2, j : j + 2] * m.kernels[c]).sum() + m.kernel_bias[c]
                    flat.append(max(0.0, (v - m.norm_channels[0][c]) / np.sqrt(m.norm_channels[1][c] + 1e-5)))
        out = np.array(flat) @ m.dense + m.bias
        out = np.maximum((out - m.norm_outputs[0]) / np.sqrt(m.norm_outputs[1] + 1e-5), 0)
        assert m.score(h, r, t)[k] == pytest.approx(t[k, 0] + out @ t[k, 1:])
    assert predictors.ConvE.seeded(33).kernels.shape == (32, 3, 3)
    with pytest.raises(ValueError):
        predictors.ConvE.seeded(34)


def test_conve_query_equals_numpy(spark):
    e, m = vectors(spark), predictors.ConvE.seeded(64, aspect=7)
    got = entry.queries()["score_conve"](spark, SF).collect()
    h, r, t = (np.array([x[c] for x in got]) for c in "hrt")
    assert len(got) == 4904 and np.allclose([x["score"] for x in got], m.score(e[h], e[r], e[t]), atol=2e-6)


def test_top_tails_in_blocks(spark):
    g = np.random.default_rng(2)
    e = np.round(g.normal(size=(50, 4)), 1)
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(np.vstack([e, e[:5]]))], "id long, emb array<double>").repartition(4)
    got = scoring.top_tails(df.filter("id < 7").select(F.col("id").alias("query_id"), "emb"), df, 6, size=8).collect()
    all_e = np.vstack([e, e[:5]])
    for q in range(7):
        s = np.round(all_e[q] @ all_e.T, 6)
        want = sorted(range(55), key=lambda i: (-s[i], i))[:6]
        assert [r["entity_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_initial_vectors(spark):
    e, r = predictors.initial(spark, "rotate", 400, 6, 8)
    x = np.array([row["emb"] for row in e.collect()])
    assert x.shape == (400, 16) and abs(x.std() - 1e-3) < 1e-4 and len(r.first()["emb"]) == 8
    again = predictors.initial(spark, "rotate", 400, 6, 8)[0].repartition(5)
    assert sorted(map(tuple, ((i, *v) for i, v in again.collect()))) == sorted(map(tuple, ((i, *v) for i, v in e.collect())))
    x = np.array([row["emb"] for row in predictors.initial(spark, "transe", 400, 6, 8)[0].collect()])
    assert abs(x).max() <= (6 / 408) ** 0.5 and x.std() == pytest.approx((6 / 408) ** 0.5 / 3**0.5, rel=0.05)
    e, r = predictors.initial(spark, "swtranse", 10, 3, 4, particles=5)
    assert len(e.first()["emb"]) == 20 and len(r.first()["emb"]) == 4
    with pytest.raises(ValueError):
        predictors.initial(spark, "other", 1, 1, 1)


def test_walks_differ(spark):
    edges = [(0, 1, 2), (1, 1, 3), (2, 2, 4), (3, 3, 4), (4, 4, 5), (5, 6, 7)]
    df = spark.createDataFrame(edges, "pos long, src long, dst long")
    source = spark.createDataFrame([(1,)], "node long")
    walk = sorted(map(tuple, graphalgo.expansion_levels(df, source).collect()), key=lambda r: (r[1], r[0]))
    # 4 comes again by its edge from 3; then no edge is left from the visited nodes
    assert walk == [(1, 0), (2, 1), (3, 2), (4, 2), (4, 3), (5, 3)]
    assert dict(map(tuple, graphalgo.topological_levels(df, source).collect())) == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}


def test_samples_and_consecutive_repeats(spark):
    ones = spark.createDataFrame([(5, 3), (9, 4)], "row long, x long")
    assert sorted(map(tuple, ragged.samples(ones, "x").collect())) == [(0, 0, 3), (1, 0, 4)]
    m = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 2, 2), (0, 3, 1), (1, 0, 1)], "row_index long, pos int, value long")
    assert [tuple(r) for r in ragged.repeats(m).collect()] == [(0, 1, 1)]


def test_stream_of_triples(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("1 2 3\n1 2 3\n4 5\n\nx y z\n 7  8\t9 \n")
    for name, source in (("good", streaming.triple_stream), ("bad", streaming.malformed_lines)):
        q = source(spark, str(tmp_path / "in")).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/ck_{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(tuple(r)[:3] for r in spark.table("good").collect()) == [(1, 2, 3), (7, 8, 9)]
    assert sorted(r["value"] for r in spark.table("bad").collect()) == ["4 5", "x y z"]


def test_reasoners_and_conorm(spark):
    from quillgraph import operators
    from quillgraph.functions import tnorm

    assert operators.reasoner("cqd") is beam.scores
    df = spark.createDataFrame([([0.0, 0.0],)], "xs array<double>")
    assert df.select(beam.t_conorm(tnorm.get("product"))(F.col("xs"))).first()[0] == pytest.approx(0.75)
    assert df.select(beam.t_conorm(tnorm.get("godel"))(F.col("xs"))).first()[0] == pytest.approx(0.5)


def by_definition(e, r, ids, sign=1.0):
    """1 + the largest product with any entity's tail, terms added up in order."""
    out = {}
    for i, t in zip(ids, e):
        best = None
        for h in e:
            total = 0.0
            for a, b in zip(turn(h, r) * sign, t):
                total += a * b
            best = total if best is None else max(best, total)
        out[i] = max(out.get(i, -np.inf), 1.0 + best)
    return out


def test_leaves_are_scored_in_blocks(spark, monkeypatch):
    from quillgraph.operators.scoring import largest_products

    g = np.random.default_rng(6)
    x, t = g.normal(size=(70, 9)), g.normal(size=(40, 9))
    x[50:] = x[3]  # copies
    want = [max(sum((a * b for a, b in zip(h, v)), 0.0) for h in x) for v in t]
    assert list(largest_products(x, t)) == want
    x[5, 2] = np.nan
    assert np.isnan(largest_products(x, t)).all()
    monkeypatch.setattr(scoring.best_products, "__defaults__", (16,))
    e, ids = np.vstack([g.normal(size=(50, 64)), np.zeros((1, 64))]), [*range(50), 7]
    e[41:44] = e[40]
    rows = [(i, [float(v) for v in emb]) for i, emb in zip(ids, e)] + [(60, None), (61, [None] * 64), (62, [1.0])]
    v = spark.createDataFrame(rows, "id long, emb array<double>").repartition(3)
    q = language.Query.read("!r2(e1,f)|r1(e2,f)")
    # two instances share a relation, one of another has none
    inst = graph.binding_rows(spark, [{"r1": 0, "r2": 2}, {"r1": 4, "r2": 2}, {"r1": 0, "r2": 99}])
    got = {(r["query_id"], r["entity_id"]): r["score"] for r in beam.scores(q, inst, v, v, predictors.complex_(32), 3).collect()}
    plus, minus = {r: by_definition(e, e[r], ids) for r in (0, 4)}, by_definition(e, e[2], ids, -1.0)
    want = {(k, i): round(max(plus[r][i], m[i]), 6) for k, r, m in ((0, 0, minus), (1, 4, minus), (2, 0, plus[0])) for i in minus}
    assert got == want | {(k, i): None for k in range(3) for i in (60, 61, 62)}
    # the same by columns, for scores that aren't products
    columns = predictors.Predictor("columns", predictors.complex_(32).score, predictors.complex_(32).tail)
    assert got == {(r["query_id"], r["entity_id"]): r["score"] for r in beam.scores(q, inst, v.filter("id < 60"), v.filter("id < 60"), columns, 3).collect()} | {(k, i): None for k in range(3) for i in (60, 61, 62)}


def test_products_in_floats_lose_no_best_one():
    from quillgraph.operators.scoring import Best, largest_products

    g = np.random.default_rng(7)
    x, t = g.normal(size=(1500, 9)), g.normal(size=(60, 9))
    near = np.repeat(x[:3], 500, 0) + g.normal(size=x.shape) * 1e-12
    with_zeros, with_nan, with_inf = t.copy(), x.copy(), t.copy()
    with_zeros[::3], with_nan[1400, 2], with_inf[4, 4] = 0, np.nan, np.inf
    powers = lambda n: 10.0 ** g.integers(-60, 60, (n, 1))
    for a, b in ((x, t), (near, t), (x, with_zeros), (x * 0, t), (with_nan, t), (x, with_inf), (x * powers(1500), t * powers(60)), (x.round(), t.round()), (x * 1e-200, t), (-abs(x), abs(t))):
        with np.errstate(invalid="ignore"):
            best = Best(b)
            for i in range(0, 1500, 700):
                best.add(a[i : i + 700])
            assert np.array_equal(best.best, largest_products(a, b), equal_nan=True)


def test_rows_between_blocks_follow_the_entities(spark, monkeypatch):
    g = np.random.default_rng(8)
    tails = spark.createDataFrame([(r, [float(v) for v in g.normal(size=4)]) for r in (0, 1) for _ in range(300)], "r long, emb array<double>")
    entities = spark.createDataFrame([(i, [float(v) for v in g.normal(size=4)]) for i in range(40)], "id long, emb array<double>")
    monkeypatch.setattr(scoring.F, "max", F.count)  # how many rows each maximum is of
    rows = scoring.best_products(tails, entities, 16).collect()
    assert len(rows) == 80 and max(r["score"] for r in rows) <= scoring.PARTS


def test_entities_are_read_once_for_a_constant(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(entry.queries()["beam_2i"](spark, SF))
        assert "BroadcastNestedLoopJoin" in plan and "CartesianProduct" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["beam_2il", "beam_3il"])
def test_pairs_of_all_entities_are_no_rows(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert "MapInPandas" in plan and "q_emb" in plan and "e_emb" in plan
