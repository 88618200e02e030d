"""Suffix-array dedup by a depth-limited radix sort: suffixes are ordered through ``depth`` bytes only.

Suffixes are sorted most significant digit first, and a suffix leaves the sort as soon as its
group has one member. A digit is a run of bytes, ranked by its 64-bit fingerprint, so groups come in
fingerprint order instead of dictionary order; which suffixes are equal, all that dedup needs, is the same.

Pass 1 sorts by a leading digit of ``digit`` bytes, on sampled suffixes only: of the digits that start in
the first ``depth - digit + 1`` places of a window, the one with the least fingerprint is its sample, so equal
windows have equal samples and a window whose sample is alone in the corpus is alone too. This sorts about
2 in ``depth - digit`` suffixes. Neighbouring suffixes that share their sample then make a run, and pass 2 sorts the runs by all bytes
that their windows cover: a run that an earlier block has too needs no more sorting, for all its windows start there.
Pass 3 sorts the suffixes of all other runs through the full depth (the first place of any window is among them).
Groups of equal suffixes are exactly the repeated windows; all but the first member (by id, then start) go.

Matches never cross documents. Null and empty texts have no bytes; shorter texts than ``depth`` lose nothing.
Rows with equal ids don't remove each other's bytes, null ids count as the largest id, and bytes repeated inside one
row go as well. Two different windows share a fingerprint with odds of about (suffixes in the sort) / 2**64 each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.llm import blocks as B
from barloom.llm import hashing as H

DEPTH = 100
DIGIT = 36
_PIECE = 1 << 17


def _slide(values: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over values[i:i + size] for every i that has them all."""
    width = 1
    while width * 2 <= size:
        values = pick(values[:-width], values[width:])
        width *= 2
    return pick(values[:len(values) - (size - width)], values[size - width:]) if size > width else values


def _pieces(texts: list[bytes | None], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of about 128 KB, the starts of the windows in them that stay inside a text, and their places
    in the block. Long texts are cut into pieces that overlap, so that each window is in one piece."""
    chunk: list[bytes] = []
    starts: list[np.ndarray] = []
    places: list[np.ndarray] = []
    size = at = 0
    for text in texts:
        text = text or b""
        for lo in range(0, max(len(text) - depth + 1, 0), _PIECE):
            piece = text[lo:lo + _PIECE + depth - 1]
            n = len(piece) - depth + 1
            starts.append(np.arange(size, size + n))
            places.append(np.arange(at + lo, at + lo + n))
            chunk.append(piece)
            size += len(piece)
            if size >= _PIECE:
                yield np.frombuffer(b"".join(chunk), np.uint8), np.concatenate(starts), np.concatenate(places)
                chunk, starts, places, size = [], [], [], 0
        at += len(text)
    if chunk:
        yield np.frombuffer(b"".join(chunk), np.uint8), np.concatenate(starts), np.concatenate(places)


def _digits(data: np.ndarray, starts: np.ndarray, depth: int, digit: int):
    """Prefix sums of the bytes, the fingerprint of each place's digit, and the sample of each window."""
    sums = H.prefix_sums(data.astype(np.uint64) + np.uint64(1))
    grams = H.gram_hashes(sums, digit)
    return sums, grams, _slide(grams, depth - digit + 1, np.minimum)[starts]


def _samples(texts: list[bytes | None], depth: int, digit: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct samples of a block, sorted, and whether two suffixes or more start with each."""
    found = []
    for data, starts, _ in _pieces(texts, depth):
        _, grams, samples = _digits(data, starts, depth, digit)
        span = depth - digit + 1
        best = np.zeros(len(data) - depth + 1 + 2 * (span - 1), np.uint64)
        best[starts + span - 1] = samples
        most = _slide(best, span, np.maximum)
        found.append(grams[:len(most)][grams[:len(most)] == most[:len(grams)]])
    keys, sizes = H.distinct(np.concatenate(found) if found else np.empty(0, np.uint64))
    return keys, (sizes > 1).astype(np.uint8)


def _in_sorted(values: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Membership of values in a sorted array; runs of equal values are looked up once."""
    if not len(ranked) or not len(values):
        return np.zeros(len(values), bool)
    heads = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    at = np.minimum(np.searchsorted(ranked, values[heads]), len(ranked) - 1)
    return np.repeat(ranked[at] == values[heads], np.diff(np.append(heads, len(values))))


class _Runs:
    """Suffixes of a piece whose sample is in ``shared``, in runs of neighbours of one sample."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, places: np.ndarray, shared: np.ndarray, depth: int, digit: int):
        self.sums, _, samples = _digits(data, starts, depth, digit)
        self.depth = depth
        left = _in_sorted(samples, shared)
        self.starts, self.places, samples = starts[left], places[left], samples[left]
        new = np.concatenate(([True], (samples[1:] != samples[:-1]) | (self.starts[1:] != self.starts[:-1] + 1)))
        heads = np.flatnonzero(new[:len(samples)])
        self.sizes = np.diff(np.append(heads, len(samples)))
        self.keys = H.range_hashes(self.sums, self.starts[heads], self.starts[heads + self.sizes - 1] + depth)

    def windows(self, done: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and places of the suffixes of runs outside ``done`` (sorted), places of those inside."""
        inside = np.repeat(_in_sorted(self.keys, done), self.sizes)
        keys = H.gram_hashes(self.sums, self.depth)[self.starts[~inside]]
        return keys, self.places[~inside], self.places[inside]


def _run_keys(texts: list[bytes | None], shared: np.ndarray, depth: int, digit: int) -> np.ndarray:
    found = [_Runs(*piece, shared, depth, digit).keys for piece in _pieces(texts, depth)]
    return H.distinct(np.concatenate(found) if found else np.empty(0, np.uint64))[0]


def _suffixes(texts: list[bytes | None], shared: np.ndarray, done: np.ndarray, depth: int, digit: int):
    """_Runs.windows of all pieces."""
    found = [_Runs(*piece, shared, depth, digit).windows(done) for piece in _pieces(texts, depth)]
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _two(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays from one note; the first number is the length of the first."""
    both = np.frombuffer(data, np.uint64)
    return both[1:1 + int(both[0])], both[1 + int(both[0]):]


def _text_without(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The text without the runs; a character that a run covers only in part stays whole."""
    out, at = [], 0
    for lo, hi in B.rows_between(starts, ends):
        while lo < hi and text[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(text) and text[hi] & 0xC0 == 0x80:
            hi -= 1
        out.append(text[at:lo])
        at = hi
    out.append(text[at:])
    return b"".join(out)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
                 digit: int = DIGIT, keep_columns: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, spans (removed byte runs), kept (bytes) and kept_text
    (the same, but characters covered in part stay, so that it is valid text).

    With keep_columns: the columns of ``docs`` with the kept text in place of the text, null for null.
    """
    blocks = B.Blocks(docs, id_col, text_col)
    buckets, last, rest = blocks.count, blocks.count, blocks.rest

    def first_pass(table: pa.Table) -> pa.Table:
        block = table["_block"][0].as_py()
        keys, several = _samples(table["_text"].cast(pa.binary()).to_pylist(), depth, digit)
        return B.pack(block, min(block, last), keys, several, buckets)

    def second_pass(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = table["_block"][0].as_py()
        texts = table["_text"].cast(pa.binary()).to_pylist()
        keys, _ = _samples(texts, depth, digit)
        shared = keys[B.answers_of(answers, len(keys))]
        return pa.concat_tables([B.note(block, shared.tobytes()), B.pack(
            block, min(block, last), _run_keys(texts, shared, depth, digit), None, buckets)])

    def third_pass(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = table["_block"][0].as_py()
        texts = table["_text"].cast(pa.binary()).to_pylist()
        note, answers = B.without_note(answers)
        shared = np.frombuffer(note, np.uint64)
        runs = _run_keys(texts, shared, depth, digit)
        done = runs[B.answers_of(answers, len(runs))]
        keys, _, _ = _suffixes(texts, shared, done, depth, digit)
        both = np.concatenate((np.array([len(shared)], np.uint64), shared, done))
        return pa.concat_tables([B.note(block, both.tobytes()), B.pack(
            block, min(block, last), H.distinct(keys)[0], None, buckets)])

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        docs_ = B.Documents(table)
        note, answers = B.without_note(answers)
        shared, done = _two(note)
        sizes = np.array([len(t or b"") for t in docs_.texts], np.int64)
        ends = np.cumsum(sizes)
        keys, places, repeats = _suffixes(docs_.texts, shared, done, depth, digit)
        order, at, members = H.groups_of(keys, stable=True)
        earlier = np.repeat(B.answers_of(answers, len(at)), members)
        row = np.searchsorted(ends, places[order], "right")
        again = np.zeros(len(order), bool)
        if len(order):
            ranks = docs_.ranks[row]
            again = earlier | (ranks > np.repeat(np.minimum.reduceat(ranks, at), members))
            same_row = np.concatenate(([False], row[1:] == row[:-1]))
            same_row[at] = False
            again |= same_row
        gone = H.ranges_covered(np.concatenate((places[order[again]], repeats)), depth, int(sizes.sum()))
        lo, hi = H.runs(gone)
        n_removed, spans, kept, texts = [], [], [], []
        for text, start, end in zip(docs_.texts, ends - sizes, ends):
            a, b = np.searchsorted(hi, start, "right"), np.searchsorted(lo, end, "left")
            s, e = np.maximum(lo[a:b], start) - start, np.minimum(hi[a:b], end) - start
            n_removed.append(int((e - s).sum()))
            spans.append([{"start": x, "end": y} for x, y in B.rows_between(s, e)])
            edges = [0, *np.column_stack((s, e)).ravel().tolist(), int(end - start)]
            kept.append(b"".join((text or b"")[x:y] for x, y in zip(edges[::2], edges[1::2])))
            texts.append(None if text is None else _text_without(text, s, e) if len(s) else text)
        texts = pa.array(texts, pa.binary()).cast(pa.string())
        if keep_columns:
            given = docs_.table["_rest"].combine_chunks()
            columns = {id_col: docs_.table["_id"], text_col: texts} | {
                f.name: given.field(k) for k, f in enumerate(rest)}
            return pa.table([columns[n] for n in out.names], names=out.names)
        return pa.table([
            docs_.table["_id"], pa.array(sizes), pa.array(n_removed, pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            pa.array(kept, pa.binary()), texts], names=out.names)

    if keep_columns:
        out = T.StructType([T.StructField(f.name, T.LongType()) if f.name == id_col else
                            T.StructField(f.name, f.dataType) for f in docs.schema.fields])
    else:
        span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
        out = T.StructType([
            T.StructField(id_col, T.LongType()), T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(span)),
            T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType())])
    sampled = B.compare(blocks.each(first_pass, B.PACKED), buckets, B.in_several, True)
    runs = B.compare(blocks.each_with(sampled, second_pass, B.PACKED), buckets, B.in_earlier, True)
    windows = B.compare(blocks.each_with(runs, third_pass, B.PACKED), buckets, B.in_earlier, True)
    return blocks.each_with(windows, remove, out)
