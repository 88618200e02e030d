"""Held-out accuracy of language ID, and exact round trips of the archive."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from barloom.llm import language_id as L
from barloom.llm import warc as W


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = L.identify(docs, model).join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_only_the_training_rows_are_learned(spark):
    rows = [(k, "aaa bbb" if k % 2 else "ccc ddd", None if k % 5 == 0 else "x" if k % 2 else "y") for k in range(60)]
    rows += [(k, "zzz", "z") for k in range(60, 200) if zlib.crc32(str(k).encode()) % 3 == 1]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["x", "y"] and "zzz" not in model.words and {"aaa", "ccc"} <= model.words.keys()


def test_backoff_and_odd_texts(model, odd_docs, no_docs, spark):
    reader = model.reader()
    seen = next(iter(model.words))
    assert reader.predict([None, "", "12 ½ !!", seen])[0][:3] == ["und"] * 3
    word = "thtionandthing"
    assert word not in model.words and reader.predict([word])[0] == ["en"]
    n = max(n for n in range(1, L.MAX_N + 1) if any(g in model.grams[n] for g in L.grams_of(word, n)))
    want = model.logs[[model.grams[n][g] for g in L.grams_of(word, n) if g in model.grams[n]]].mean(axis=0)
    assert (reader.rows[reader.known[word]] == want).all()
    rows = L.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all((r.lang_pred == "und") == (r.doc_id in (102, 103, 105)) for r in rows)
    kept = L.keep_identified(odd_docs, model, min_score=0)
    assert kept.schema == odd_docs.schema and kept.count() == len(rows) - 3
    nothing = L.fit(no_docs)
    assert L.identify(no_docs, nothing).count() == 0
    assert {r.lang_pred for r in L.identify(odd_docs, nothing).collect()} == {"und"}


def test_full_cache_changes_nothing(model, monkeypatch):
    text = " ".join(f"wordx{'abcdefgh'[k % 8]}{'klmnopq'[k % 7]}y" for k in range(300))
    want = model.reader().predict([text])
    monkeypatch.setattr(L, "_CACHE_WORDS", 7)
    got = model.reader().predict([text])
    assert got[0] == want[0] and abs(got[1][0] - want[1][0]) < 1e-9


PAGES = [(1, "http://a", "x" * 200), (2, "http://b", "x" * 200), (0, None, "x" * 200), (3, "http://c", "short"), (4, "http://d", "short"),
         (5, "http://e", None), (6, "http://f", ""), (7, "http://g", "é" * 50), (8, "http://h", "é" * 50), (9, "http://i", "é" * 49),
         (None, "http://n", "x" * 200), (None, "http://m", "only null " * 20), (10, "http://j", "y" * 300), (10, "http://j", "y" * 300)]


def test_archive(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string").repartition(4)
    folder = W.write_archive(pages, str(tmp_path / "a"))
    assert W.read_payloads(spark, folder).count() == len({p[2] or "" for p in PAGES})
    rows = W.read_archive(spark, folder).collect()
    assert len(rows) == len(PAGES)
    first = {}
    for i, _, html in PAGES:
        first[html] = min(first.get(html, float("inf")), float("inf") if i is None else i)
    got = sorted(repr((r.page_id, r.type, r.refers_to, bytes(r.payload), r.digest)) for r in rows)
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        again = len(data) >= 100 and first[html] != float("inf") and first[html] != i
        want.append(repr((i, "revisit" if again else "response", first[html] if again else None, data, hashlib.sha256(data).hexdigest())))
    assert got == sorted(want)
    for r in rows:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and fields[b"WARC-Type"].decode() == r.type
        body = b"" if r.type == "revisit" else bytes(r.payload)
        assert rest == body + b"\r\n\r\n" and int(fields[b"Content-Length"]) == len(body)
    with pytest.raises(Exception, match="damaged payload"):
        bad = spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.lit(b"other"))
        bad.write.parquet(str(tmp_path / "b" / "payloads"))
        W.read_payloads(spark, str(tmp_path / "b")).collect()
    assert W.archive_round_trip(pages.limit(0)).count() == 0


def test_nothing_to_learn_from_keeps_what_has_a_letter(spark, odd_docs):
    from pyspark.sql import functions as F
    no_lang = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    only_held_out = odd_docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.col("lang")))
    want = sorted(repr((r.doc_id, r.text)) for r in odd_docs.collect() if L.words_of(r.text))
    for docs in (no_lang, only_held_out):
        model = L.fit(docs)
        assert model.languages == []
        kept = L.keep_identified(docs, model)
        assert sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == want and len(want) > 50
