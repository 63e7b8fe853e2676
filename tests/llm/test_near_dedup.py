"""Near-duplicate classes against all pairs."""
import random

import numpy as np

from quillgraph.llm import near_dedup as nd


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent):
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t)) for d, t in rows]
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in parent}


def corpus(seed=2):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    rows, base = [], text(150)
    for _ in range(60):  # one group of copies with more and fewer edits
        t = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6])):
            t[r.randrange(len(t))] = "e%d" % r.randrange(10**6)
        rows.append(" ".join(t))
    for _ in range(60):
        t = text(r.choice([3, 5, 40, 200]))
        rows += [" ".join(t), " ".join(t).upper(), "\n".join(t[:-1])]
    rows += ["", None, "  ", "a b", "A\tB"]
    r.shuffle(rows)
    return list(enumerate(rows, 10))


def test_equals_all_pairs(spark):
    rows = corpus()
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string").repartition(3)
    for percent in (80, 85):
        got = {r["doc_id"]: r for r in nd.classes(d, percent).collect()}
        assert {k: r["component_id"] for k, r in got.items()} == brute(rows, percent)
        assert all(got[i]["n_shingles"] == len(shingles(t)) and got[i]["kept"] == (got[i]["component_id"] == i) for i, t in rows)
    assert nd.deduplicated(d, 85).columns == ["doc_id", "text", "n"]


def test_repeated_and_null_ids_and_empty_tables(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    d = spark.createDataFrame([(1, a), (1, b), (2, b), (None, a), (None, "q r s t u v"), (3, a)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in nd.classes(d, 85).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (-1, 1, False), (-1, None, True), (3, 1, False)], key=str)
    assert nd.classes(d.limit(0), 85).count() == 0


def test_registers_merge_and_estimate():
    r = np.random.default_rng(4)
    x = r.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(x[:2500]), np.unique(x[500:])
    regs = nd.registers([a, b, np.union1d(a, b)])
    assert (nd.merge(regs[0], regs[1]) == regs[2]).all()
    got = nd.estimate(regs[:1], regs[1:2], np.array([2500.0]), np.array([2500.0]))[0]
    assert abs(got - 2000 / 3000) < 0.12


def test_long_words_of_a_pattern_are_told_apart(spark):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    d = spark.createDataFrame([(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word.upper())], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in nd.classes(d, 85).collect()} == {1: 1, 2: 2, 3: 1}


def test_one_row_of_each_class_stays(spark):
    a, b, c = "one two three four five six seven", "eight nine ten eleven twelve thirteen", "q r s t u v"
    rows = [(1, a, "x"), (1, a, "y"), (1, b, "x"), (2, b, "x"), (None, a, "x"), (None, c, "x"), (None, c, "y"), (None, c.upper(), "z"), (3, a, "x"), (4, "", "x"), (4, "", "x"), (5, None, "x"), (None, None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, __key string")
    got = [(r["doc_id"], (r["text"] or "").lower()) for r in nd.deduplicated(d, 85).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (None, c), (4, ""), (4, ""), (5, ""), (None, "")], key=str)
    assert nd.deduplicated(d, 85).schema == d.schema and nd.deduplicated(d.limit(0), 85).count() == 0


def test_copies_of_a_common_text_are_looked_up_in_place(spark, monkeypatch):
    monkeypatch.setattr(nd, "HOT_COPIES", 5)
    monkeypatch.setattr(nd, "HOT_SHARE", 5)
    a = "one two three four five six seven"
    rows = [(i, a) for i in range(40)] + [(50, "eight nine ten eleven twelve"), (51, "Eight nine ten eleven twelve"), (60, ""), (61, None)]
    got = {r["doc_id"]: r["component_id"] for r in nd.classes(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == {**{i: 0 for i in range(40)}, 50: 50, 51: 50, 60: 60, 61: 61}


def variants(r, n, own, base):
    """Copies of base, each with `own` words changed to such that no other has."""
    out = []
    for k in range(n):
        t = list(base)
        for at in r.sample(range(0, len(t), 10), own):
            t[at] = f"v{k}x{at}"
        out.append(" ".join(t))
    return out


def test_variants_below_the_threshold_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(nd, "CELL", 40)
    r = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    # any two share about 0.83 of their shingles, and no third text shares the rest
    texts = variants(r, 500, 8, base)
    nodes = [(i, t) for i, t in enumerate(texts)]
    seen = []
    plain = nd.tested
    monkeypatch.setattr(nd, "tested", lambda pairs, known, percent: seen.append(pairs.count()) or plain(pairs, known, percent))
    d = spark.createDataFrame(nodes, "doc_id long, text string")
    got = nd.classes(d, 85).collect()
    assert all(x["component_id"] == x["doc_id"] for x in got)
    assert sum(seen) <= 2 * len(nodes)  # with the centre, and none besides
    # near the threshold on both sides, dealt over many cells
    some = variants(r, 60, 3, base) + variants(r, 60, 6, base) + variants(r, 60, 10, base)
    rows = list(enumerate(some))
    got = {x["doc_id"]: x["component_id"] for x in nd.classes(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == brute(rows, 85)


def test_components_by_one_task_and_by_rounds(spark, monkeypatch):
    r = random.Random(12)
    # chains, stars, a tree of random links, and a node that is linked with itself
    links = [(i, i + 1) for i in range(1000, 1300)] + [(2000, 2000 + i) for i in range(1, 50)] + [(9000 - i, r.randrange(9000 - i, 9001)) for i in range(200)] + [(5, 5), (7, 6), (6, 7)]
    r.shuffle(links)
    d = spark.createDataFrame(links, "a long, b long").repartition(3)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    want = {(x, root(x)) for x in parent if root(x) != x}
    jobs = []
    for most in (nd.TASK_LINKS, 10):
        monkeypatch.setattr(nd, "TASK_LINKS", most)
        before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
        got = [tuple(x) for x in nd.components(d).collect()]
        jobs.append(spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before)
        assert len(got) == len(want) and set(got) == want
        assert nd.components(d.limit(0)).count() == 0
    # the driver plans few jobs for few links
    assert jobs[0] <= 8 < jobs[1]


def test_steps_that_find_nothing_are_the_last(spark, monkeypatch):
    calls = []
    plain = nd.common_sizes
    monkeypatch.setattr(nd, "common_sizes", lambda sets: calls.append(1) or plain(sets))
    texts = [" ".join(f"t{i}w{k}" for k in range(30)) for i in range(20)]
    rows = list(enumerate(texts + texts[:5]))
    got = {r["doc_id"]: r["component_id"] for r in nd.classes(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == {i: i % 20 for i in range(25)} and not calls
