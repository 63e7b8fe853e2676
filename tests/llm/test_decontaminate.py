"""Template decontamination on planted cases."""
from quillgraph.llm import decontaminate

ITEM = "A train leaves the station at 10 in the morning and covers 120 km before it meets Alice, who walked 3 km. How far did Alice walk?"
FILL = "ora lumen tasti vero quando siste mura calor ventus arbor " * 3


def run(spark, docs, items=((7, ITEM), (9, ITEM.replace("Alice", "Bob")), (3, "too short to tell"), (4, None))):
    d = spark.createDataFrame(docs, "doc_id long, text string, n_items int")
    b = spark.createDataFrame(list(items), "item_id long, text string")
    return {r["doc_id"]: r for r in decontaminate.flagged(d, b).collect()}


def test_exact_reparameterised_and_clean(spark):
    other = ITEM.replace("10", "7").replace("120", "95").replace("3 km", "8 km").replace("Alice", "Mara")
    mixed = ITEM.replace("meets Alice", "meets Mara")
    got = run(spark, [(1, FILL + ITEM, 0), (2, FILL + other + " " + FILL, 0), (3, FILL, 0), (4, None, 0), (5, "", 0), (6, ITEM.upper(), 0), (8, FILL + "too short to tell", 0), (10, "1 2 3 4 5 6 7 8 9 10 11 12 13", 0), (11, mixed, 0)])
    # 11: one of two equal names became another; the windows without it are the item's word for word
    assert [k for k, r in sorted(got.items()) if r["contaminated"]] == [1, 2, 6, 11]
    assert got[1]["item_ids"] == [7] and got[1]["n_items"] == 1 and not got[1]["reparameterised"]
    assert got[2]["reparameterised"] and got[2]["share"] > 0.9


def test_repeated_ids_and_empty_tables(spark):
    d = spark.createDataFrame([(1, ITEM), (1, FILL), (None, ITEM), (1, ITEM)], "doc_id long, text string")
    b = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["contaminated"]) for r in decontaminate.report(d, b).collect()) == [(0, True), (1, False), (1, True), (1, True)]
    assert decontaminate.report(d, b.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.report(d.limit(0), b).count() == 0


def test_one_slot_that_disagrees_drops_its_own_windows_only(spark):
    bag = "There are 5 apples in the red wooden bowl on the kitchen table and there are also 5 pears in the blue basket by the door"
    mixed = ITEM.replace("meets Alice", "meets Mara")
    got = run(spark, [(1, FILL + mixed, 0), (2, FILL + bag.replace("5 apples", "7 apples").replace("5 pears", "9 pears"), 0), (3, "1 2 3 4 5 6 7 8 9 10 11 12 13", 0)], [(7, ITEM), (8, bag)])
    assert {k: r["item_ids"] for k, r in got.items()} == {1: [7], 2: [8], 3: []}
    assert 0.3 <= got[1]["share"] < 1 and got[2]["reparameterised"]


def test_every_item_of_a_template_is_checked(spark):
    text = "Each of the small boxes holds {} red marbles and every one of the large boxes holds {} blue marbles in it"
    got = run(spark, [(1, FILL + text.format(3, 5), 0), (2, FILL + text.format(8, 9), 0), (3, FILL + text.format(3, 3), 0)], [(1, text.format(3, 3)), (2, text.format(3, 5)), (5, text.format(3, 5)), (6, text.format(4, 6))])
    assert got[1]["item_ids"] == [2, 5] and not got[1]["reparameterised"]
    assert {2, 5, 6} <= set(got[2]["item_ids"]) and got[2]["reparameterised"]
    assert got[3]["item_ids"] == [1]


def test_long_runs_short_items_and_unspaced_scripts(spark):
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    words = [word() for _ in range(500)]
    han = "某商店上午卖出苹果若干下午又卖出梨若干请问全天一共卖出水果多少"
    docs = [
        (1, FILL + " ".join(words[200:300]), 0), (2, FILL + " ".join(words[200:240]), 0), (3, f"{FILL}\nWhat is 3 times 9?\n{FILL}", 0), (4, FILL + "what is 2 times 7 of " + FILL, 0),
        (5, "前言" + han + "结束", 0), (6, "第 12 页\n42", 0), (7, "see 43\n43", 0), (8, "So. Name it. What is 2 times 7? Yes", 0),
    ]
    got = run(spark, docs, [(1, " ".join(words)), (2, "What is 2 times 7?"), (3, han), (4, "42"), (5, "Name it! What is 2 times 7?")])
    assert {k: v["item_ids"] for k, v in got.items()} == {1: [1], 2: [], 3: [2], 4: [], 5: [3], 6: [4], 7: [], 8: [2, 5]}
    assert got[3]["reparameterised"] and not got[8]["reparameterised"] and got[1]["share"] < 0.3


def test_values_are_compared_both_ways(spark):
    item = "On day 12 the 30 farmers of the valley sold 7 loads of hay to the miller and 12 farmers sold 30 more"
    same = "On day 5 the 5 farmers of the valley sold 5 loads of hay to the miller and 5 farmers sold 5 more"
    other = "On day 5 the 8 farmers of the valley sold 9 loads of hay to the miller and 5 farmers sold 8 more"
    got = run(spark, [(1, same, 0), (2, other, 0), (3, "Add 5 to 5\nnow", 0), (4, "Add 5 to 6\nnow", 0)], [(1, item), (2, "Add 7 to 9")])
    assert got[2]["item_ids"] == [1] and got[2]["share"] == 1.0 and got[1]["share"] < got[2]["share"]
    assert got[3]["item_ids"] == [] and got[4]["item_ids"] == [2]


def test_columns_of_the_caller_stay(spark):
    long = FILL * 500 + ITEM + FILL * 500
    d = spark.createDataFrame([(1, FILL, 42, "x", 0.5), (2, long, 43, "y", 0.6), (None, None, 44, "z", 0.7)], "doc_id long, text string, rid int, contaminated string, share double")
    b = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    out = decontaminate.clean(d, b)
    assert out.schema == d.schema and sorted(map(tuple, out.collect()), key=str) == sorted([(1, FILL, 42, "x", 0.5), (None, None, 44, "z", 0.7)], key=str)
    got = {r["doc_id"]: (r["rid"], r["contaminated"]) for r in decontaminate.flagged(d, b).collect()}
    assert got == {1: (42, False), 2: (43, True), None: (44, False)}


def plain_python(docs, items):
    """doc_id -> item_ids, by comparing every window of every text with every window of every item."""
    import re
    from collections import Counter, defaultdict

    def tokens(text):  # (token, is a name); ASCII texts only
        text = re.sub(r"(?<=[0-9])[.,](?=[0-9])", "", text or "")
        out = []
        for m in re.finditer(r"[A-Za-z0-9]+", text):
            name = bool(re.match(r"[A-Z](?=[a-z])", m[0])) and bool(re.search(r"[a-z,;] $", text[: m.start()]))
            out.append((m[0].lower(), name))
        return out

    def kinds(toks, names):
        out = []
        for i, (t, name) in enumerate(toks):
            if name and names:
                out.append("<name>")
            elif t[0].isdigit():
                out.append("<number>")
            elif out and out[-1] == "<number>" and t in decontaminate.UNITS:
                out.append("<unit>")
            else:
                out.append(t)
        return out

    def windows(toks):
        found = defaultdict(set)
        for names in (True, False):
            k = kinds(toks, names)
            for i in range(len(k) - 7):
                w = tuple(k[i : i + 8])
                if sum(not x.startswith("<") for x in w) >= 4:
                    found[w].add(i)
        return found

    result = {}
    for doc_id, text in docs:
        t, here, ids = tokens(text), windows(tokens(text)), set()
        whole = {}  # (template, shift) -> item_id -> no value differs
        judged = []
        for item_id, item in items:
            own = tokens(item)
            slots = [i for i, k in enumerate(kinds(own, True)) if k.startswith("<")]
            total = len({i for at in windows(own).values() for i in at})
            if not total:
                continue
            enough = min(0.3 * total, -(-(50 - 8) // 8) + 1)
            hits = {(pos, at) for w, places in windows(own).items() for at in places for pos in here.get(w, ())}
            if len({at for _, at in hits}) < enough:
                continue
            by_shift = defaultdict(list)
            for pos, at in hits:
                by_shift[pos - at].append(at)
            for shift, ats in by_shift.items():
                seen = {(i, own[i][0], t[i + shift][0]) for at in ats for i in slots if at <= i < at + 8}
                count = Counter((o, d) for _, o, d in seen)
                best = lambda pairs, side: min(pairs, key=lambda p: (-count[p], p[0] != p[1], p[side]))
                to = {o: best([p for p in count if p[0] == o], 1)[1] for o, _ in count}
                back = {d: best([p for p in count if p[1] == d], 0)[0] for _, d in count}
                rows = []
                for at in ats:
                    pairs = [(own[i][0], t[i + shift][0]) for i in slots if at <= i < at + 8]
                    other = any(o != d for o, d in pairs)
                    rows.append((at, other, not other or all(to[o] == d and back[d] == o for o, d in pairs)))
                same = (tuple(kinds(own, True)), shift)
                exact = not any(o for _, o, _ in rows) and len(rows) >= enough
                whole.setdefault(same, {})[item_id] = exact
                judged.append((item_id, same, total, rows))
        kept = defaultdict(lambda: [set(), 0, 1])
        for item_id, same, total, rows in judged:
            if any(whole[same].values()) and not whole[same][item_id]:
                continue
            ats = sorted(at for at, _, good in rows if good)
            kept[item_id][0].update(ats)
            kept[item_id][2] = total
            first = None
            for before, at in zip([None, *ats], ats):
                first = at if before is None or at - before > 8 else first
                kept[item_id][1] = max(kept[item_id][1], at - first + 8)
        result[doc_id] = sorted(i for i, (ats, run_of, total) in kept.items() if len(ats) / total >= 0.3 or run_of >= 50)
    return result


def test_equals_plain_python(spark):
    import random

    r = random.Random(12)
    words = "river stone market bread copper window garden letter summer yellow quickly under along bright seven paper".split()
    names, numbers = ["Alice", "Bob", "Mara", "Nils"], ["3", "5", "12", "1,200", "0.5"]

    def sentence(n):
        out = ["The"]
        for _ in range(n):
            x = r.random()
            out.append(r.choice(names) if x < 0.1 else r.choice(numbers) + r.choice(["", " km", " hours"]) if x < 0.25 else r.choice(words))
        return " ".join(out) + "."

    items = [(i, sentence(r.choice([12, 25, 40, 120]))) for i in range(12)]
    items += [(20 + i, items[i][1].replace("3", "12").replace("Bob", "Nils")) for i in range(4)]
    docs = []
    for k in range(150):
        parts = [sentence(r.randint(5, 30))]
        for _ in range(r.choice([0, 1, 1, 2])):
            t = r.choice(items)[1].split(" ")
            for _ in range(r.choice([0, 0, 1, 3, 8])):  # values and words change
                at = r.randrange(len(t))
                t[at] = r.choice(names) if t[at] in names else r.choice(numbers) if t[at][0].isdigit() else r.choice([t[at], r.choice(words)])
            cut = r.choice([0, 0, len(t) // 3, len(t) // 2])
            parts += [" ".join(t[cut:]), sentence(r.randint(3, 10))]
        docs.append((k, " ".join(parts) if r.random() < 0.9 else " ".join(parts).lower()))
    got = run(spark, [(k, t, 0) for k, t in docs], items)
    want = plain_python(docs, items)
    assert {k: v["item_ids"] for k, v in got.items()} == want
    assert 40 < sum(bool(v) for v in want.values()) < 140
