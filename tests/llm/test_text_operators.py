"""Rules, classifiers, archives, tokens and chat on small tables with nulls, empty texts and repeats."""
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgraph.llm import arc, bpe, chat_format, language_id, quality_knn, quality_rules, token_output
from quillgraph.llm.bytes_np import span_hashes
from quillgraph.llm.queries import BYTE_RANKS, WORD_MODEL

TEXTS = [None, "", " ", "a  b\tc", "Ünï côdé it's  the'll\n\n x", "x" * 3000, "<|endoftext|> <|ENDOFTEXT|> Ab, aB.!!", "word " * 40, "İ Σας ́e ﬁ"]


def docs(spark):
    return spark.createDataFrame([(i % 8, t, 1) for i, t in enumerate(TEXTS)] + [(None, "no id", 1)], "doc_id long, text string, n_words int")


def test_bpe_equals_the_library_and_decodes(spark):
    ranks = bpe.read_ranks(BYTE_RANKS)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    d = docs(spark)
    want = sorted(hashlib.sha256(np.array(lib.encode_ordinary(r["text"] or ""), "<u4").tobytes()).hexdigest() for r in d.collect())
    got = bpe.round_trip(d, BYTE_RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(r["ids_sha256"] for r in got) == want
    assert sorted(r["decoded_sha256"] for r in got) == sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in d.collect())
    enc = bpe.Encoder(ranks)
    table = enc.last_tokens(b"hello there")
    again = enc.last_tokens(b"hello thereabouts", table, 11)
    assert enc.read_off(again) == enc.plain(b"hello thereabouts")
    assert bpe.round_trip(d.limit(0), BYTE_RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_blocks_equal_the_library(monkeypatch):
    import random

    ranks = bpe.read_ranks(BYTE_RANKS)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert bpe.SPLIT == public_tokenizers.PATTERN
    encoder, draw = bpe.encoder_of(BYTE_RANKS), random.Random(5)
    monkeypatch.setattr(bpe, "CHUNK", 1 << 10)
    letters = "aAsStTmMdDrReEvVlL'''''  \n\t  019.,!?<|>#ÀéÖßÿя×÷µİŁ½²\r\x0b\x1c\x00\x85\u2003zŉ"
    texts = ["", "'s", "'", "", " ", "  ", "a", "'ll", "'l", "'re", "it's", "'s's", " 's", "a 've"]
    texts += ["".join(draw.choices(letters[: draw.choice([32, 44, len(letters)])], k=draw.randint(0, 40))) for _ in range(6000)]
    enc = bpe.BlockEncoder(encoder, public_tokenizers.PATTERN, 500)  # the table starts anew now and then
    other = bpe.BlockEncoder(encoder, r"\s?\S+|\s+")
    for some in (texts, [" ".join(texts)], ["".join(texts)[:8000]]):
        data = [t.encode() for t in some]
        ids, count = enc.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        assert [x.tolist() for x in np.split(ids, count.cumsum()[:-1])] == [lib.encode_ordinary(t) for t in some]
        assert encoder.decoded(ids)[0].tobytes() == b"".join(data)
        ids, count = other.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        assert encoder.decode(ids.tolist()) == b"".join(data)
    enc.close()
    assert enc.known.keys.n == 0


def test_bpe_remembers_a_bounded_number_of_bytes():
    enc = bpe.BlockEncoder(bpe.encoder_of(BYTE_RANKS), public_tokenizers.PATTERN, 20_000)
    most = 0
    for k in range(12):  # as many tasks, each with pieces of its own
        text = " ".join(f"x{k}q{i}z" for i in range(20_000)).encode()
        for a in range(0, len(text), 50_000):
            part = text[a : a + 50_000]
            enc.encode(np.frombuffer(part, np.uint8), np.array([0, len(part)]))
        t = enc.known
        most = max(most, sum(x.room.nbytes for x in (t.keys, t.data, t.data_at, t.ids, t.ids_at)) + t.table.nbytes)
    assert most < 8_000_000 and len(enc.encoder.allowed) == bpe.PAIRS
    batches = iter([pa.record_batch([pa.array([1]), pa.array(["ab cd"])], ["doc_id", "text"])] * 3)
    rows = bpe.encoded_blocks(batches, enc)
    next(rows)
    rows.close()  # as when a task is cut off
    assert enc.known.keys.n == 0


def test_hashes_of_spans_with_a_pattern():
    # these words collide in sums of bytes times powers, whatever the multiplier
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    both = np.frombuffer((word + word.translate(str.maketrans("ab", "ba"))).encode(), np.uint8)
    assert len(set(span_hashes(both, np.array([0, len(word)]), np.array([len(word), 2 * len(word)])).tolist())) == 2
    some = np.frombuffer(b"abcdefgh abcdefgh\x00 abcdefghi abcdefgh", np.uint8)
    h = span_hashes(some, np.array([0, 9, 19, 29]), np.array([8, 18, 28, 37])).tolist()
    assert h[0] == h[3] and len(set(h)) == 3


def test_token_files(spark):
    d = docs(spark).repartition(3)
    lib = Tokenizer.from_file(WORD_MODEL)
    rows = sorted(((r["doc_id"] is not None, r["doc_id"], r["text"] is not None, r["text"]) for r in d.collect()), key=lambda r: (r[0], r[1] or 0, r[2], r[3] or ""))
    want, at = [], 0
    for _, i, _, t in rows:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_output.round_trip(d, WORD_MODEL, 2).orderBy("start").collect()]
    assert got == want
    ids = np.array([0, 255, 256, 70000, 2**32 - 1] * 300, "<u4")
    blob = token_output.write_segment(np.array([5]), np.array([True]), np.array([len(ids)]), ids)
    s = next(token_output.read_segments(blob + b"\n"))
    assert (s.ids() == ids).all() and [s[i] for i in range(0, 1500, 7)] == ids[::7].tolist()


def test_token_files_are_cut_by_size(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_output, "FILE_SEGMENTS", 1)
    rows = [(i, f"word{i} " * (i % 40)) for i in range(3000)] + [(i, None) for i in range(3000, 3010)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = [tuple(r) for r in token_output.round_trip(d, WORD_MODEL, 2).orderBy("doc_id").collect()]
    at = 0
    for i, start, n, _ in want:
        assert start == at
        at += n
    # more files than their names have digits for, read in any order
    at, parts = str(tmp_path / "files"), []
    ids = np.array([5, 300, 2], "<u4")
    for k in range(1100):
        parts.append(token_output.write_segment(np.array([k]), np.array([True]), np.array([3]), ids, (k // 4, k % 4)))
    made = spark.createDataFrame([(bytearray(x),) for x in parts], "segment binary").repartition(7)
    token_output.write_blobs(made, "segment", at, "\n", 1)
    got = [tuple(r)[:3] for r in token_output.read_ids(spark, at).orderBy("doc_id").collect()]
    assert got == [(k, 3 * k, 3) for k in range(1100)]
    assert token_output.round_trip(d.limit(0), WORD_MODEL, 2).count() == 0


def test_archives_are_cut_by_bytes_and_stored_ones_are_read(spark, monkeypatch, tmp_path):
    import gzip
    import os

    rows = [(i, f"http://a/{i}", f"page {i} " + "x" * (200 * (i % 9)), "other") for i in range(400)] + [(400, "u", "y" * 3_000_000, "other")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, record string").repartition(2)
    want = sorted(map(tuple, arc.round_trip(d).collect()), key=str)
    assert len(want) == 401 and arc.round_trip(d.limit(0)).count() == 0
    monkeypatch.setattr(arc, "FILE_PIECES", 1)
    at = str(tmp_path / "cut")
    arc.write_pages(d, at)
    few = len([f for f in os.listdir(at) if f.startswith("part-")])
    assert sorted((tuple(r)[:5] for r in arc.read_archives(spark, at).collect()), key=str) == want and few >= 2
    records = [arc.ArcRecord("http://a/1", "1.2.3.4", "199907", "text/html", "200", arc.HTTP + b"abc"), arc.ArcRecord("dns:a", "1.2.3.4", "19990708091011", "text/dns", "200", b"a line\n")]
    os.mkdir(tmp_path / "old")
    for version in (1, 2):
        data = arc.write_arc(records, version)
        (tmp_path / "old" / f"v{version}.arc").write_bytes(gzip.compress(data) if version == 1 else data)
    arc.convert_archives(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    got = sorted(tuple(r)[1:4] for r in arc.read_archives(spark, str(tmp_path / "new")).collect())
    sha = lambda x: hashlib.sha1(x).hexdigest()
    assert got == sorted([(3, sha(b"abc"), "response"), (7, sha(b"a line\n"), "resource")] * 2)
    warc = b"".join((tmp_path / "new" / f).read_bytes() for f in os.listdir(tmp_path / "new") if f.startswith("part-"))
    heads = [h for h, _ in arc.read_warc(warc)]
    assert {h["warc-date"] for h in heads} == {"1999-07-01T00:00:00Z", "1999-07-08T09:10:11Z"} and {h["content-type"] for h in heads} == {"application/http; msgtype=response", "text/dns"}


def test_rules(spark):
    rows = [(1, None), (2, "a b"), (3, " ".join(f"w{i}" for i in range(40))), (4, "one two three four five six " * 9), (5, "AB CD EF " * 3 + " ".join("XY%d" % i for i in range(20))), (3, " ".join(f"w{i}" for i in range(40)))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules.report(d).collect()}
    assert {k: r["kept"] for k, r in got.items()} == {1: False, 2: False, 3: True, 4: False, 5: False}
    assert got[4]["n_repeat_words"] == 54 and got[3]["n_repeat_words"] == 0 and got[1]["n_words"] == 0
    assert quality_rules.cascade(d).filter("kept").count() == 2 and quality_rules.report(d.limit(0)).count() == 0


def test_order_of_rules(spark):
    rule = lambda name: quality_rules.Rule(name, F.lit(True), F.lit(1.0))
    # b rejects most, but for ten times the work; once a is through, c rejects nothing that is left
    found = [(0b001, 30, [30.0, 300.0, 33.0]), (0b101, 20, [20.0, 200.0, 22.0]), (0b010, 60, [60.0, 600.0, 66.0]), (0b100, 0, [0.0] * 3), (0, 100, [100.0, 1000.0, 110.0])]
    assert [r.name for r in quality_rules.greedy(found, [rule("a"), rule("b"), rule("c")])] == ["a", "b", "c"]
    assert [r.name for r in quality_rules.greedy([], [rule("a"), rule("b")])] == ["a", "b"]
    rows = [(i, "x " * 4) for i in range(40)] + [(i, "AB CD " * 30 + str(i)) for i in range(40, 50)] + [(i, f"some plain words {i} that nobody will ever have to reject here at all " + " ".join(f"w{i}{k}" for k in range(300))) for i in range(50, 100)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    orders = [[r.name for r in quality_rules.ordered(x, "text", 2000, quality_rules.default_rules)] for x in (d.repartition(1), d.repartition(3), d.repartition(2))]
    assert orders[0] == orders[1] == orders[2] and orders[0][0] == "too_few_words" and sorted(orders[0]) == sorted(r.name for r in quality_rules.default_rules(F.col("text"), F.col("text")))
    assert quality_rules.accepted(d).count() == quality_rules.cascade(d).filter("kept").count() == 50


def test_rules_leave_the_callers_columns(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    d = spark.createDataFrame([(1, "a b", "x", 1), (2, long, "y", 2), (3, None, "z", 3)], "doc_id long, text string, rejected_by string, __words int")
    out = quality_rules.accepted(d)
    assert out.schema == d.schema and [(r["doc_id"], r["rejected_by"], r["__words"]) for r in out.collect()] == [(2, "y", 2)]
    assert quality_rules.accepted(d.limit(0)).count() == 0


def test_language_and_quality(spark):
    words = {"aa": "lorem ipsum dolor amet", "bb": "shed thing wharf knight"}
    rows = [(i, " ".join([words[k]] * 9), k) for i, k in enumerate(["aa", "bb"] * 30)] + [(None, None, None), (900, "123 !!", "aa"), (901, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.report(d).collect()}
    assert all(got[i] == k for i, _, k in rows[:60]) and got[900] == got[901] == got[None] == "und"
    assert {r["lang_pred"] for r in language_id.report(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    labels = d.filter("doc_id < 60").select("doc_id", (F.col("lang") == "aa").cast("int").alias("quality"))
    shouted = d.withColumn("text", F.when(F.col("lang") == "bb", F.upper("text")).otherwise(F.col("text")))
    scores = {r["doc_id"]: r["score"] for r in quality_knn.report(shouted, labels).collect()}
    assert len(scores) == 63 and all((scores[i] > 0.5) == (k == "aa") for i, _, k in rows[:60]) and 0 <= scores[901] <= 1
    assert {r["score"] for r in quality_knn.report(d, labels.limit(0)).collect()} == {0.5}


def test_archives(spark):
    big = "é" * 600
    rows = [(1, "http://a/ b", big), (7, None, big), (7, None, big), (3, "u", big), (2, "u", "x\r\n\r\nWARC/1.0\r\n"), (4, "u", None), (5, "u", "x\r\n\r\nWARC/1.0\r\n"), (-6, "u", "z")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in arc.round_trip(d).collect())
    assert got == [(-6, 1, "response", 0), (1, 1200, "revisit", 7), (2, 15, "response", 0), (3, 1200, "revisit", 7), (4, 0, "response", 0), (5, 15, "response", 0), (7, 1200, "response", 0), (7, 1200, "response", 0)]
    for bad in (b"no header", b"filedesc://x 0 1 text/plain 9\n3 0 me\nxx\n", arc.write_arc([arc.ArcRecord("u", "i", "1999", "t", "200", b"abc")], 2)[:-3]):
        with pytest.raises(ValueError):
            list(arc.read_arc(bad))
    assert arc.iso_date("19990203") == "1999-02-03T00:00:00Z"


def test_chat(spark):
    odd = "\\### Assistant:\n </turn>\n \\l <#:"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (2, 0, "user", "a"), (2, 1, "user", "b"), (3, 0, None, None), (3, 1, "odd: \nrole<", "c")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat_format.conversations(d)
    back = {r["conv_id"]: r for r in made.withColumn("back", chat_format.read_back(F.col("formatted"))).collect()}
    assert {k: r["valid"] for k, r in back.items()} == {1: True, 2: False, 3: False}
    for conv, turn, role, text in rows:
        assert tuple(back[conv]["back"][turn]) == (role or "", text or "", role == "assistant")
    assert chat_format.digest(chat_format.conversations(d.limit(0))).count() == 0


def test_pieces_equal_the_library(monkeypatch):
    import random

    lib, draw = Tokenizer.from_file(WORD_MODEL), random.Random(5)
    letters = "aAsStTmMdDrReEvVlL'''’  \n\t019.,!?<|>#ÀéÖßÿ×÷µİŁ½²\r\x0b\x1c\x00z"
    texts = ["it's we'll I'RE 'tis ''s --'s 's's x'd'", "'", "s", "'r", "e", "", "É'É"]
    texts += ["".join(draw.choices(letters[: draw.choice([30, 40, len(letters)])], k=draw.randint(0, 40))) for _ in range(5000)]
    long = " ".join(texts).replace("<|", "")
    monkeypatch.setattr(token_output, "CHUNK", 1 << 10)
    enc = token_output.PieceEncoder(WORD_MODEL, 500)
    for some in (texts, [long], [long.replace(" ", "").replace("\n", "")]):
        data = [t.encode() for t in some]
        ids, count = enc.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
        got = np.split(ids, count.cumsum()[:-1])
        assert [x.tolist() for x in got] == [e.ids for e in lib.encode_batch(some, add_special_tokens=False)]


def test_votes_equal_all_pairs(monkeypatch):
    import random

    r = random.Random(4)
    words = ["stone", "river", "CAPS", "##", "1 2 3", "...", "a b", "walks\n", "!!", "x|y"]
    texts = [" ".join(r.choices(words, k=r.randint(0, 40))) for _ in range(400)]
    monkeypatch.setattr(quality_knn, "BLOCK", 60)
    model = quality_knn.fit(texts[:250], [r.randint(0, 1) for _ in range(250)])
    x = np.vstack([model.latent(quality_knn.term_counts(data, offsets)) for _, _, data, offsets in quality_knn.chunks(pa.array(texts, pa.string()))])
    want = []
    for v in x:
        sims = [float(np.dot(v.astype(float), w)) for w in model.vectors.astype(float)]
        near = sorted(range(250), key=lambda i: -sims[i])[: quality_knn.NEIGHBOURS]
        weights = [max(sims[i], 0.0) ** quality_knn.SHARPNESS for i in near]
        want.append(sum(w * model.labels[i] for w, i in zip(weights, near)) / sum(weights) if sum(weights) > 1e-9 else float(model.labels.mean()))
    assert np.allclose(model.score(pa.array(texts, pa.string())), want, atol=1e-4)


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnoprstu", "абвгдежзиклмнопрстуф", "αβγδεζηθικλμνξοπρστ"])
def test_votes_hear_words(alphabet):
    import random

    r = random.Random(9)
    # all words have one length, so texts differ in vocabulary only; few words are shared
    word = lambda: "".join(r.choices(alphabet, k=6))
    both, sides = [word() for _ in range(40)], [[word() for _ in range(120)] for _ in range(2)]
    labels = [r.randint(0, 1) for _ in range(400)]
    texts = [" ".join(r.choices(both + sides[k], k=30)) for k in labels]
    scores = quality_knn.fit(texts[:300], labels[:300]).score(pa.array(texts[300:], pa.string()))
    pairs = [(scores[i], scores[j]) for i in range(100) for j in range(100) if labels[300 + i] > labels[300 + j]]
    assert sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs) > 0.97


def test_texts_of_one_labelled_id(spark):
    d = spark.createDataFrame([(1, "b b b"), (1, "A A A"), (2, "c, c."), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, label int")
    one = quality_knn.learn(d, labels)
    assert one.labels.tolist() == [1.0, 0.0] and (one.vectors == quality_knn.learn(d.repartition(4), labels).vectors).all()


def exact_prediction(learner, text):
    """By exact sets of n-grams."""
    names = sorted(learner.texts)
    data = text.encode()
    codes = language_id.grams(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist()
    sets = {k: set(learner.kept(k).tolist()) for k in names}
    return [sum(c in sets[k] for c in codes) for k in names]


@pytest.mark.parametrize("languages", [3, 20, 70])
def test_languages_equal_exact_sets(languages, monkeypatch):
    import random

    monkeypatch.setattr(language_id, "PENDING", 2000)
    r = random.Random(6)
    own = {f"l{k:02d}": ["".join(r.choices("abcdefghijklmnopqrstuvwxyzéß", k=r.randint(3, 8))) for _ in range(60)] for k in range(languages)}
    learner = language_id.Learner()
    for name, words in own.items():
        for _ in range(12):
            learner.add(name, " ".join(r.choices(words, k=60)))
    model = learner.model()
    texts = [" ".join(r.choices(own[r.choice(list(own))], k=r.randint(1, 30))) for _ in range(120)]
    top, score = model.predict(pa.array(texts, pa.string()))
    for t, k, s in zip(texts, top, score):
        hits = exact_prediction(learner, t)
        n = len(language_id.grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0])
        # the filters never miss an n-gram; what they find by chance is taken off again
        assert hits[k] >= max(hits) - 0.02 * n and abs(s - max(hits) / n) < 0.03
    codes, n = learner.counted("l00")
    assert len(codes) == len(set(codes.tolist())) and n.max() <= 12


def test_languages_of_long_texts_beside_other_columns(spark):
    words = {"aa": "lorem ipsum dolor amet", "bb": "shed thing wharf knight"}
    rows = [(i, " ".join([words[k]] * 9), k, "x", 7) for i, k in enumerate(["aa", "bb"] * 30)] + [(99, " ".join([words["bb"]] * 60_000), None, "y", 8)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, n int")
    model = language_id.learn(d, "text", "lang", F.col("doc_id"))
    out = language_id.identify(d, model)
    assert out.columns == ["doc_id", "lang", "n", "lang_pred", "score"]
    got = {r["doc_id"]: (r["lang_pred"], r["n"]) for r in out.collect()}
    assert got[99] == ("bb", 8) and all(got[i] == (k, 7) for i, _, k, _, _ in rows[:60])
    assert language_id.identify(d.limit(0), model).count() == 0


def test_long_conversations_and_repeated_turns(spark):
    long = "said and done, " * 40_000
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", long if t == 5 else f"turn {t}", "x", 3) for t in range(300)] + [(2, 0, "user", "a", "x", 3), (2, 1, "assistant", "b", "x", 3), (2, 1, "assistant", "b", "x", 3)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, valid int")
    made = chat_format.conversations(d)
    back = {r["conv_id"]: r["back"] for r in made.withColumn("back", chat_format.read_back(F.col("formatted"))).collect()}
    assert [tuple(x)[:2] for x in back[1]] == [(r[2], r[3]) for r in rows[:300]] and len(back[2]) == 3
    got = {r["conv_id"]: r for r in chat_format.digest(made).collect()}
    assert got[1]["n_turns"] == 300 and got[1]["loss_chars"] == sum(len(r[3]) for r in rows[:300] if r[2] == "assistant") and not got[2]["valid"]
