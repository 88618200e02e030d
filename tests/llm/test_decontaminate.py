"""The automaton against plain window sets."""

import random
import re

from barloom.llm.decontaminate import Automaton, contamination, words_of


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items, size):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        own = words(item)
        n = min(size, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p:p + n] == own[k:k + n]:
                    hit |= set(range(p, p + n))
                    found.add(name)
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def test_automaton_on_random_words():
    rng = random.Random(7)
    for _ in range(60):
        letters = "abc"[:rng.randint(1, 3)]
        items = [(str(k), " ".join(rng.choice(letters) for _ in range(rng.randint(0, 9)))) for k in range(rng.randint(1, 6))]
        size = rng.randint(1, 5)
        machine = Automaton([(n, words_of(t.encode())) for n, t in items], size)
        for _ in range(10):
            text = " ".join(rng.choice(letters + "z") for _ in range(rng.randint(0, 25)))
            hit, found = set(), set()
            for start, end, own in machine.read(words_of(text.encode())):
                hit |= set(range(start, end))
                found |= {machine.names[x] for x in own}
            assert (len(hit), sorted(found)) == plain(text, items, size)[1:3]


def test_odd_rows_and_item_groups(spark, odd_docs, no_docs):
    texts = [r.text for r in odd_docs.collect() if r.text]
    items = [(1, texts[0][:60]), (2, texts[1]), (None, "word"), (4, None), (5, "..."), (6, "12 7"), (7, texts[1])]
    table = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    named = [("null" if k is None else str(k), t) for k, t in items]
    want = sorted(repr((r.doc_id, *plain(r.text, named, 6))) for r in odd_docs.collect())
    for block_words in (1 << 20, 5):
        rows = contamination(odd_docs, table, size=6, block_words=block_words).collect()
        assert sorted(repr((r.doc_id, r.n_words, r.n_hit, list(r.item_ids), r.contaminated)) for r in rows) == want
        assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in rows)
    kept = contamination(odd_docs, table, size=6, keep_columns=True)
    assert kept.schema == odd_docs.schema and kept.count() == sum(not r.contaminated for r in rows) < len(rows)
    assert contamination(no_docs, table).count() == 0
    assert contamination(odd_docs, table.limit(0)).where("n_hit > 0 OR contaminated").count() == 0


def test_clean_text(spark):
    docs = spark.createDataFrame([(1, "Keep this. The Secret answer is here, and that."), (2, "the secret")], "doc_id long, text string")
    items = spark.createDataFrame([("q", "the secret answer is")], "item_id string, text string")
    rows = {r.doc_id: r for r in contamination(docs, items).collect()}
    assert rows[1].clean_text == "keep this here and that" and [tuple(s) for s in rows[1].spans] == [(2, 6)]
    assert rows[2].clean_text == "the secret" and not rows[2].contaminated


def test_long_spans_go_from_documents_below_the_coverage(spark):
    quoted = " ".join(f"q{k}" for k in range(90))
    short = " ".join(f"q{k}" for k in range(200, 220))
    filler = " ".join(f"w{k}" for k in range(3000))
    items = spark.createDataFrame([(1, quoted), (2, short)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{filler} {quoted} tail {short} end"), (2, f"{filler} {short}"), (3, "no hit, Here!"), (4, None)],
                                 "doc_id long, text string")
    plain = {r.doc_id: r for r in contamination(docs, items).collect()}
    cut = {r.doc_id: r for r in contamination(docs, items, span_words=50).collect()}
    assert all(not r.contaminated for r in plain.values()) and [plain[k].clean_text for k in (1, 2, 3, 4)] == \
        [r.text for r in docs.orderBy("doc_id").collect()]
    assert cut[1].clean_text == f"{filler} tail {short} end" and cut[1].n_hit == 110
    assert all(cut[k] == plain[k] for k in (2, 3, 4)) and cut[1][:-1] == plain[1][:-1]
    assert {r.doc_id: r.clean_text for r in contamination(docs, items, span_words=20).collect()}[2] == filler


def test_coverage_that_is_no_unit_fraction(spark):
    docs = spark.createDataFrame([(1, "a b x y z")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "a b")], "item_id string, text string")
    for coverage, bad in ((0.4, True), (0.39, True), (0.41, False), (0.05, True), (1.0, False)):
        assert contamination(docs, items, coverage=coverage).first().contaminated is bad
        assert contamination(docs, items, coverage=coverage, keep_columns=True).count() == (0 if bad else 1)
