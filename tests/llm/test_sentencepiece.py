"""Encoding against an all-segmentations search and the public library, decoding as an exact round trip."""

import random
import time

import numpy as np
import pytest

from barloom.llm import sentencepiece as S


@pytest.fixture(scope="module")
def vocabulary():
    return S.Vocabulary.load()


def small():
    pieces = ["a", "b", "ab", "ba", " a", " ab", "aba", " ", "  ", "é", "bé"]
    keys = [None] + [bytes([b]) for b in range(256)] + [p.encode() for p in pieces]
    scores = [0.0] * 257 + [-2.0, -2.1, -2.5, -3.3, -2.4, -3.1, -4.0, -3.0, -4.5, -5.0, -5.5]
    return S.Vocabulary(keys, scores, list(range(1, 257)))


def best_score(v, text):
    own = {v.keys[i]: s for i, s in zip(v.ids.tolist(), v.scores.tolist())}
    chars = [c.encode() for c in text]
    best = [0.0] + [-np.inf] * len(chars)
    for i in range(len(chars)):
        for j in range(i + 1, len(chars) + 1):
            key = b"".join(chars[i:j])
            if key in own:
                best[j] = max(best[j], best[i] + own[key])
        if chars[i] not in own:
            best[i + 1] = max(best[i + 1], best[i] + v.unknown)
    return best[-1]


def score_of(v, ids):
    own = dict(zip(v.ids.tolist(), v.scores.tolist()))
    total, k, text = 0.0, 0, b""
    while k < len(ids):
        if ids[k] in own:
            total += own[ids[k]]
            k += 1
            continue
        first = v.keys[ids[k]][0]
        width = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
        text = b"".join(v.keys[i] for i in ids[k:k + width])
        assert len(text.decode()) == 1
        total += v.unknown
        k += width
    return total


def test_viterbi_finds_the_best_segmentation():
    v, rng = small(), random.Random(2)
    encoder = S.Encoder(v)
    for _ in range(300):
        text = "".join(rng.choice("aabbé z\n漢▁😀") for _ in range(rng.randint(1, 14)))
        ids = np.frombuffer(encoder.encode(text.encode()), np.uint16).tolist()
        assert S.decode_ids(v.keys, ids) == text
        assert score_of(v, ids) == pytest.approx(best_score(v, " " + text))


def test_like_the_library(vocabulary):
    import sentencepiece as spm
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(S.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    own = dict(zip(vocabulary.ids.tolist(), vocabulary.scores.tolist()))
    for k, piece in enumerate(model.pieces):
        piece.score = own.get(k, 0.0)
    library = spm.SentencePieceProcessor(model_proto=model.SerializeToString())
    encoder = S.Encoder(vocabulary)
    for text in ["Hello  world", "Straße und Äpfel\nnext line", "x", "  leading", "日本語 text 😀 naïve", "THE!! AN!! isandhees "]:
        assert np.frombuffer(encoder.encode(text.encode()), np.uint16).tolist() == library.encode(text)


def test_round_trip_of_tables(spark, sf, odd_docs, no_docs, vocabulary):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs, no_docs):
        out = S.decode(S.encode(docs, vocabulary), vocabulary)
        assert out.where("NOT decoded <=> text").count() == 0 and out.count() == docs.count()
        assert out.columns == [*docs.columns, "token_ids", "decoded"]
    row = S.encode(odd_docs, vocabulary).where("doc_id = 102").first()
    assert row.token_ids is None
    again = S.encode(odd_docs.withColumnRenamed("keys", "token_ids"), vocabulary)
    assert again.columns == ["doc_id", "text", "lang", "_block", "token_ids"]


def test_a_part_alone_is_segmented_like_many_together(vocabulary, monkeypatch):
    monkeypatch.setattr(S, "_WINDOW", 64)
    rng, encoder = random.Random(5), S.Encoder(vocabulary)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFXYZ0123456789+/=é漢字日本語😀▁-_."
    parts = [b"", b"x", " ".encode() * 90, ("ab" * 400).encode(), ("a" * 700).encode()]
    parts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 400))).encode() for _ in range(60)]
    parts = [p for p in parts if p]
    assert [encoder._alone(p) for p in parts] == encoder._together(parts)
    small_ = S.Encoder(small())
    parts = ["".join(rng.choice("aabbé z漢▁😀") for _ in range(rng.randint(1, 200))).encode() for _ in range(40)]
    assert [small_._alone(p) for p in parts] == small_._together(parts)


def test_a_long_text_without_spaces_takes_seconds(vocabulary):
    rng = random.Random(6)
    text = "".join(rng.choice("ABCDEFGHabcdefghijklmnop0123456789+/") for _ in range(200_000)).encode()
    began = time.process_time()
    ids = np.frombuffer(S.Encoder(vocabulary).encode(text), np.uint16).tolist()
    assert time.process_time() - began < 10  # stepped byte by byte in NumPy, 20,000 bytes alone took about 3
    assert S.decode_ids(vocabulary.keys, ids).encode() == text


def test_long_text(vocabulary):
    text = ("some words  and\nlines " * 120_000).encode()
    ids = np.frombuffer(S.Encoder(vocabulary).encode(text), np.uint16).tolist()
    assert S.decode_ids(vocabulary.keys, ids).encode() == text
