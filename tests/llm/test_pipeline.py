"""The pipeline's stages against plain loops on the smallest table."""

import re

import corpus_pipeline as P
import pytest
from barloom.llm import minhash_dedup as M
from barloom.llm.language_id import words_of


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    for name in ("language_id", "near_dedup", "suffix_array_dedup", "decontaminate"):
        assert stages[name].dtypes == stages["documents"].dtypes


def test_decisions(stages, spark, sf):
    before, after = texts(stages["documents"]), texts(stages["language_id"])
    assert all(not words_of(before[i]) or len(words_of(before[i])) < 4 for i in before.keys() - after.keys())
    groups = {r.doc_id: r.group_id for r in M.near_duplicates(stages["language_id"]).collect()}
    kept = texts(stages["near_dedup"])
    assert kept == {i: t for i, t in after.items() if groups[i] == i} and len(kept) < len(after)

    # Suffix dedup: no byte of a 100-byte string that starts earlier is left, up to whole characters.
    first, cut = {}, texts(stages["suffix_array_dedup"])
    for i in sorted(kept):
        data = kept[i].encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            if data[k:k + 100] in first:
                gone[k:k + 100] = b"\1" * 100
            first.setdefault(data[k:k + 100], (i, k))
        whole = "".join(c for c, at in zip(kept[i], offsets(kept[i])) if not all(gone[at:at + len(c.encode())]))
        assert cut[i] == whole
    assert {r.doc_id: r.n_chars for r in stages["suffix_array_dedup"].collect()} == {i: len(t) for i, t in cut.items()}

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))

    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k:k + 13]) for k in range(len(w) - 12)} or {tuple(w)}
    sizes = {len(w) for w in windows}
    clean = {}
    for i, t in cut.items():
        w, hit = words(t), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not hit or 20 * len(hit) < len(w):
            clean[i] = t
    assert texts(stages["decontaminate"]) == clean and len(clean) < len(cut)
    last = stages["sentencepiece"].collect()
    assert {r.doc_id for r in last} == clean.keys() and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in last)


def offsets(text):
    at = 0
    for c in text:
        yield at
        at += len(c.encode())


def test_odd_rows_pass(odd_docs, no_docs, spark, sf):
    from pyspark.sql import functions as F

    for docs in (odd_docs.withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(1).cast("long")),
                 no_docs.withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(1).cast("long"))):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert P.STAGES[-1][1](spark, docs, sf).count() == docs.count()
