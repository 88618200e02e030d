"""The quality classifier: features and scores against plain loops, what it learns, odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from barloom.llm import queries
from barloom.llm.quality import FEATURES, boost, features, fit, score

BLANK = b" \t\n\x0b\x0c\r"


def plain(text):
    """The features of one text, one character after another."""
    t = text or b""
    n = len(t)
    words, lines = t.split(), [x for x in (" ".join(map(str, line)) for line in t.split(b"\n")) if x]
    lines = [line for line in t.split(b"\n") if line]
    upper = [b for b in t if 65 <= b <= 90]
    ascii_letters = [b for b in t if 65 <= b <= 90 or 97 <= b <= 122]
    letters = len(ascii_letters) + sum(b >= 128 for b in t)
    digits = sum(48 <= b <= 57 for b in t)
    is_symbol = lambda b: 33 <= b < 127 and not chr(b).isalnum()
    share = lambda a, b: a / max(b, 1)
    runs = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    w = len(words)
    return [math.log1p(n), math.log1p(w), share(sum(map(len, words)), w), share(letters, n), share(digits, n),
            share(sum(map(is_symbol, t)), n), share(len(upper), len(ascii_letters)), share(t.count(b"\n"), w),
            share(sum(t.count(c) for c in (b".", b"!", b"?")), w), share(sum(t.count(c) for c in (b",", b";", b":")), w),
            share(sum(chr(b) in "|{}<>[]\\/_=" for b in t), n), share(len(set(words)), w),
            share(max(Counter(words).values(), default=0), w), share(len(runs) - len(set(runs)), len(runs)),
            share(len(lines) - len({line.translate(bytes(1 if b in BLANK else b for b in range(256))) for line in lines}), len(lines)),
            share(sum(len(x) > 1 and is_symbol(x[-1]) and is_symbol(x[-2]) for x in words), w),
            math.log1p(max(map(len, words), default=0)), share(sum(len(x) <= 3 for x in words), w),
            share(sum(len(x) > 1 and 65 <= x[0] <= 90 and 65 <= x[1] <= 90 for x in words), w),
            share(sum(is_symbol(b) and a == b for a, b in zip(t, t[1:])), n)]


def test_features_equal_plain_loops(spark, sf):
    texts = [None if r.text is None else r.text.encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += [None, b"", b"   \n\n ", b"A", b"AB cd!! ...\n|x|\n|x|", b"!!", b"a " * 5000, "é, ß Ü".encode(), b"x" * 100_000, b"\n", b"end!!"]
    got = features(texts)
    assert got.shape == (len(texts), len(FEATURES))
    assert np.allclose(got, [plain(t) for t in texts])


def test_scores_equal_additions(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels)
    rows = queries.QUERIES["op12_quality_classifier"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        x = plain((texts[r.doc_id] or "").encode())
        total = model.intercept + sum(t[sum(v >= c for c in cuts)] for v, cuts, t in zip(x, model.cuts, model.tables))
        coarse = [sum(v >= c for c in cuts) for v, cuts in zip(x, model.pair_cuts)]
        total += sum(t[coarse[i]][coarse[j]] for (i, j), t in zip(model.pairs, model.pair_tables))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
        assert r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op12_quality_classifier"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in rows)
    bad = [r for r in rows if truth[r.doc_id] == 0]
    print(right / len(rows), sum(r.predicted == 0 for r in bad) / len(bad))
    assert right / len(rows) > 0.97 and sum(r.predicted == 0 for r in bad) / len(bad) > 0.9


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = boost(x, y)
    assert (0, 2) in model.pairs
    alone = boost(x, y, pairs=0)
    accuracy = lambda m: ((m.score(x) >= 0.5) == (y == 1)).mean()
    assert accuracy(model) > 0.9 and accuracy(alone) < 0.7


def test_odd_rows_and_nothing_to_learn(spark, odd_docs, no_docs):
    some = [(r.doc_id, k % 2, "x") for k, r in enumerate(odd_docs.collect())] + [(3, None, "y"), (None, 1, "z"), (6, 7, "w")]
    labels = spark.createDataFrame(some, "doc_id long, quality int, text string")
    model = fit(odd_docs, labels)
    again = fit(odd_docs.repartition(5), labels.repartition(2))
    assert all((a == b).all() for a, b in zip(model.tables + model.pair_tables, again.tables + again.pair_tables))
    rows = score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 106}) == 1
    none = fit(odd_docs, labels.where("false"))
    assert {(r.score, r.predicted) for r in score(odd_docs, none).collect()} == {(0.5, 1)}
    assert score(no_docs, model).count() == 0
