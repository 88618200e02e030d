"""The permutation, and shards against the token stream made by a plain loop."""

import numpy as np
import pytest

from barloom.llm import token_shards as S


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    slots = S.slots_of(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert S.sequences_at(slots, n).tolist() == list(range(n))
    if n > 100:
        assert slots.tolist() != list(range(n)) and slots.tolist() != S.slots_of(np.arange(n), n, 7).tolist()


def test_shards_hold_every_token_once(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    ranks = S.read_ranks()
    folder = S.write_shards(docs, str(tmp_path / "shards"), length=64, per_shard=8)
    rows = sorted(S.read_sequences(spark, folder).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows)))
    assert all(r.shard == r.slot // 8 and r.byte_offset == r.slot % 8 * 128 and len(r.tokens) == 128 for r in rows)
    at = S.sequences_at(np.arange(len(rows)), len(rows))
    order = [rows[k] for k in np.argsort(at)]
    stream = [t for r in order for t in np.frombuffer(bytes(r.tokens), np.uint16)[:r.n_tokens].tolist()]
    encode = S._encoder(ranks).encode_ordinary
    want = [t for r in sorted(docs.collect()) for t in [*encode(r.text), S.END_OF_TEXT]]
    assert stream == want
    seen = {d for r in order for d in r.doc_ids}
    assert seen == {r.doc_id for r in docs.collect()}
    later = sorted(S.read_sequences(spark, folder, 13).collect(), key=lambda r: r.slot)
    assert later == rows[13:]


def test_odd_rows(odd_docs, no_docs, tmp_path, spark):
    out = S.in_training_order(odd_docs, length=16)
    rows = out.collect()
    ends = sum(int((np.frombuffer(bytes(r.tokens), np.uint16)[:r.n_tokens] == S.END_OF_TEXT).sum()) for r in rows)
    assert ends == odd_docs.where("text IS NOT NULL").count()
    assert any(None in r.doc_ids for r in rows)
    assert S.in_training_order(no_docs).count() == 0


def test_order_does_not_depend_on_partitions_and_any_slot_can_be_read(spark, odd_docs, sf, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    seen = []
    try:
        for partitions in ("4", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            folder = S.write_shards(docs, str(tmp_path / partitions), length=32, per_shard=4096)
            seen.append(sorted(S.read_sequences(spark, folder).collect(), key=lambda r: r.slot))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
    total = len(seen[0])
    assert total > 3 * 4096 and all(r.n_tokens == 32 for r in seen[0]) or sum(r.n_tokens < 32 for r in seen[0]) == 1
    for slot in (1, 5000, 4096, total - 1):
        assert sorted(S.read_sequences(spark, folder, slot).collect(), key=lambda r: r.slot) == seen[0][slot:]
