"""Substring and suffix dedup and near duplicates against plain loops."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from barloom.llm import blocks as B
from barloom.llm import hashing as H
from barloom.llm import minhash_dedup as M
from barloom.llm.components import components
from barloom.llm.substring_dedup import substring_dedup
from barloom.llm.suffix_dedup import suffix_dedup

BIG = float("inf")


def ident(row):
    return BIG if row["doc_id"] is None else row["doc_id"]


def rows_of(df, *names):
    return sorted((tuple(-99 if x is None else bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.select(*names).collect()), key=repr)


def brute_words(rows, window):
    first = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in rows]
    for r, w in zip(rows, split):
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            first[key] = min(first.get(key, BIG), ident(r))
    out = []
    for r, w in zip(rows, split):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < ident(r):
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((-99 if r["doc_id"] is None else r["doc_id"], len(w), len(gone), kept))
    return sorted(out, key=repr)


def brute_bytes(rows, depth):
    first = {}
    texts = [(r["text"] or "").encode() for r in rows]
    for r, t in zip(rows, texts):
        for k in range(len(t) - depth + 1):
            key = t[k:k + depth]
            first[key] = min(first.get(key, BIG), ident(r))
    out = []
    for r, t in zip(rows, texts):
        gone, own = np.zeros(len(t) + 1, bool), set()
        for k in range(len(t) - depth + 1):
            key = t[k:k + depth]
            if first[key] < ident(r) or key in own:
                gone[k:k + depth] = True
            own.add(key)
        kept = bytes(b for k, b in enumerate(t) if not gone[k])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((-99 if r["doc_id"] is None else r["doc_id"], len(t), int(gone.sum()), spans, kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [1, 5, 9])
def test_substring_dedup(odd_docs, window):
    got = rows_of(substring_dedup(odd_docs, window=window), "doc_id", "n_words", "n_removed", "kept")
    assert got == brute_words(odd_docs.collect(), window)


@pytest.mark.parametrize("depth,digit", [(40, 14), (100, 36), (12, 12)])
def test_suffix_dedup(odd_docs, depth, digit):
    out = suffix_dedup(odd_docs, depth=depth, digit=digit)
    got = rows_of(out.selectExpr("doc_id", "n_bytes", "n_removed", "size(spans) AS n", "kept"), "doc_id", "n_bytes", "n_removed", "n", "kept")
    assert got == brute_bytes(odd_docs.collect(), depth)


def test_suffix_dedup_keeps_columns_and_valid_text(odd_docs):
    out = suffix_dedup(odd_docs, depth=41, keep_columns=True, digit=14)
    assert out.schema.names == odd_docs.schema.names
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[102]["text"] is None and rows[108]["keys"] == "bytes" and set(rows[108]["text"]) <= {"é", " "}
    assert out.count() == odd_docs.count()


def test_empty_tables(no_docs):
    assert substring_dedup(no_docs).count() == 0
    assert suffix_dedup(no_docs).count() == 0
    assert M.near_duplicates(no_docs).count() == 0
    assert M.drop_near_duplicates(no_docs).count() == 0


def test_word_hashes_match_words():
    texts = [b"a bc  a\tdef", None, b"", "é a".encode(), b"bc"]
    hashes, counts = H.word_hashes(texts, H.WHITESPACE)
    assert counts.tolist() == [4, 0, 0, 2, 1]
    assert hashes[0] == hashes[2] == hashes[5] and hashes[1] == hashes[6] and len(set(hashes.tolist())) == 4


def test_packed_lists_survive():
    rng = np.random.default_rng(1)
    for shift in (0, 24):
        keys = H.distinct(rng.integers(0, 2**64, 5000, np.uint64) >> np.uint64(shift) << np.uint64(shift))[0]
        table = B.pack(3, 3, keys, np.arange(len(keys)).astype(np.uint8), 7, shift)
        back = np.concatenate([B._unpack(r["_n"], r["_width"], r["_keys"], B._lower(r["_bucket"], 7), shift) for r in table.to_pylist()])
        assert (back == keys).all()


def shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return Counter([tuple(w[k:k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else []))


def test_near_duplicates_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    counts = {r.doc_id: shingles(r.text) for r in rows}
    df = Counter(s for c in counts.values() for s in c)
    n = len(rows)
    weight = {i: {s: (1 + np.log(t)) * (1 + M.IDF_SPAN * np.log((n + 1) / (df[s] + 1)) / np.log(n + 1)) for s, t in c.items()} for i, c in counts.items()}
    parent = {i: i for i in counts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(counts)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = weight[a].keys() & weight[b].keys()
            if both:
                m = sum(min(weight[a][s], weight[b][s]) for s in both)
                if m / (sum(weight[a].values()) + sum(weight[b].values()) - m) >= 0.8:
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    want = {i: find(i) for i in ids}
    got = {r.doc_id: r.group_id for r in M.near_duplicates(docs).collect()}
    assert got == want and len(set(want.values())) < n


def test_near_duplicates_of_odd_rows(odd_docs):
    rows = M.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    source = next(r.doc_id for r in odd_docs.collect() if r.text == next(x.text for x in odd_docs.collect() if x.doc_id == 100) and r.doc_id < 100)
    assert by[100].group_id == by[101].group_id == source and not by[100].keep
    assert by[102].keep and by[103].keep and by[104].group_id == 104
    assert all(r.keep and r.group_id is None for r in rows if r.doc_id is None)
    assert M.drop_near_duplicates(odd_docs).schema == odd_docs.schema
    clash = odd_docs.selectExpr("*", "1 AS _gone", "2 AS _id", "3 AS _text", "4 AS node", "5 AS root", "6 AS group_id")
    left = M.drop_near_duplicates(clash)
    assert left.schema == clash.schema and left.count() == M.drop_near_duplicates(odd_docs).count()


def test_signature_agreement_is_the_similarity():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**64, 400, np.uint64)
    w = rng.uniform(0.5, 2, 400)
    a, b = slice(0, 300), slice(100, 400)
    wb = w[b] * rng.choice([1, 0.5], 300)
    s = M.signatures(np.concatenate((keys[a], keys[b])), np.concatenate((w[a], wb)), np.array([0, 300]), 3000)
    mins = np.minimum(w[100:300], wb[:200]).sum()
    true = mins / (w[a].sum() + wb.sum() - mins)
    assert abs((s[:, 0] == s[:, 1]).mean() - true) < 0.03


def test_components(spark):
    pairs = [(k, k + 1) for k in range(0, 40)] + [(50, 60), (60, 70), (70, 50), (90, 80)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 50: 50, 60: 50, 70: 50, 80: 80, 90: 80}


def test_components_of_a_long_chain_take_logarithmic_rounds(spark):
    n = 2000
    order = list(range(n))
    random.Random(4).shuffle(order)
    for ids in (list(range(n)), order):
        rounds = []
        pairs = [(ids[k], ids[k + 1]) for k in range(n - 1)]
        got = components(spark.createDataFrame(pairs, "a long, b long"), rounds).collect()
        assert len(got) == n and {r.root for r in got} == {0}
        assert len(rounds) <= 2 * 11 + 3


def test_components_without_links(spark):
    assert components(spark.createDataFrame([], "a binary, b binary")).count() == 0
    assert components(spark.createDataFrame([(b"x", b"x")], "a binary, b binary")).count() == 0
