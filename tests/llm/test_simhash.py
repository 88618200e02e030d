"""Fingerprints against a plain loop, edits in id order, and the block tables against brute force."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import hashing as H
from barloom.llm import simhash as S


def test_fingerprint_is_the_vote():
    text = "The cat sat on the cat sat été".encode()
    words, _ = H.word_hashes([text], H.ALNUM_LOWER)
    keys, _ = H.word_windows(words, np.array([len(words)]), 2)
    counts = Counter(keys.tolist())
    want = 0
    for bit in range(64):
        votes = sum(round(16 * (1 + math.log2(n))) * (1 if k >> bit & 1 else -1) for k, n in counts.items())
        want |= (votes > 0) << bit
    got = S.fingerprints([text, None, b"", b"...", b"word", text])
    assert got[0] == want == got[5] and got[1] == got[2] == got[3] == 0 and got[4] != 0


def test_edits_follow_the_ids(odd_docs, no_docs, spark):
    for docs in (odd_docs, odd_docs.where("doc_id IS NULL"), odd_docs.where("doc_id = 5"), odd_docs.where("doc_id IS NOT NULL")):
        rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text is not None, r.text or ""))
        want = []
        for k, r in enumerate(rows):
            t, n = r.text or "", rows[(k + 1) % len(rows)].text or ""
            edited = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
            prints = S.fingerprints([x.encode() for x in (t, edited, n)]).view(np.int64).tolist()
            want.append((r.doc_id, len(t), edited, *prints))
        got = [tuple(r) for r in S.fingerprint_edits(docs).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert S.fingerprint_edits(no_docs).count() == 0


def test_search_finds_all_within_the_radius(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 40, np.uint64)
    prints = [int(b) for b in base]
    for b in base:
        for flips in range(6):
            for bit in rng.choice(64, flips, replace=False):
                b ^= np.uint64(1) << np.uint64(bit)
            prints.append(int(b))
    prints += prints[:10]
    rows = [(k, p - (1 << 64) if p >= 1 << 63 else p) for k, p in enumerate(prints)]
    df = spark.createDataFrame([*rows, (999, None)], "doc_id long, fingerprint long")
    got = {r.doc_id: (r.n_near, r.n_exact) for r in S.neighbours(df.where(F.col("doc_id") % 7 == 0), df).collect()}
    want = {k: (sum((p ^ q).bit_count() <= 3 for q in prints), prints.count(p)) for k, p in enumerate(prints) if k % 7 == 0}
    assert got == want


def test_near_pairs_and_documents_are_brute_force(spark):
    rng = np.random.default_rng(11)
    prints = rng.integers(-2**63, 2**63 - 1, 40).tolist()
    for k in range(160):  # neighbours at 0 to 5 bits, whichever
        bits = rng.choice(64, k % 6, replace=False)
        changed = (prints[k % 40] % 2**64) ^ sum(1 << int(b) for b in bits)
        prints.append(changed - 2**64 if changed >= 2**63 else changed)
    rows = [(k, p) for k, p in enumerate(prints)] + [(900, None), (901, prints[3]), (901, prints[3])]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint long")
    asked = df.where("doc_id % 3 = 0")
    apart = lambda a, b: ((a ^ b) % 2**64).bit_count()
    have = [(i, p) for i, p in rows if p is not None]
    ask = [(i, p) for i, p in have if i % 3 == 0]
    times = Counter(p for _, p in have)
    pairs = {(a, b, apart(a, b), times[b]) for _, a in ask for b in times if apart(a, b) <= 3}
    got = S.near_pairs(asked, df).collect()
    assert len(got) == len(pairs) and {tuple(r) for r in got} == pairs
    want = sorted((i, j, apart(a, b)) for i, a in ask for j, b in have if apart(a, b) <= 3)
    assert sorted(map(tuple, S.near_documents(asked, df).collect())) == want
    counts = Counter(i for i, _, _ in want)
    exact = Counter(i for i, _, d in want if d == 0)
    assert {tuple(r) for r in S.neighbours(asked, df).collect()} == {(i, counts[i], exact[i]) for i in counts}
