"""Substring dedup: Rabin-Karp hashes of all fixed-length word windows, counted in Spark.

Words are runs of anything but ASCII white space. A window of ``window`` consecutive words of one
document is a repeat if the same words also start in a document of a smaller id. All words inside
repeats go; overlapping repeats merge into maximal intervals.

Edge cases: a null or empty text has no words and keeps the empty text; a text shorter than the window
loses nothing; rows with equal ids don't remove each other's words; null ids count as the largest id.
Two different windows share a 64-bit hash with odds of about (windows in the corpus) / 2**64 each.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.llm import blocks as B
from barloom.llm import hashing as H

WINDOW = 50


def _windows(texts: list[bytes | None], window: int):
    hashes, counts = H.word_hashes(texts, H.WHITESPACE)
    keys, starts = H.word_windows(hashes, counts, window)
    return keys, starts, counts


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, spans (word intervals removed), kept (text)."""
    blocks = B.Blocks(docs, id_col, text_col)
    buckets, last = blocks.count, blocks.count

    def hash_block(table: pa.Table) -> pa.Table:
        block = table["_block"][0].as_py()
        keys, _, _ = _windows(table["_text"].cast(pa.binary()).to_pylist(), window)
        return B.pack(block, min(block, last), H.distinct(keys)[0], None, buckets)

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        docs_ = B.Documents(table)
        keys, starts, counts = _windows(docs_.texts, window)
        order, at, sizes = H.groups_of(keys)
        ranks = np.repeat(docs_.ranks, counts)[starts]
        earlier = B.answers_of(answers, len(at))
        repeat = np.zeros(len(keys), bool)
        if len(keys):
            ranked = ranks[order]
            repeat[order] = np.repeat(earlier, sizes) | (ranked > np.repeat(np.minimum.reduceat(ranked, at), sizes))
        gone = H.ranges_covered(starts[repeat], window, int(counts.sum()))
        ends = np.cumsum(counts)
        removed, spans, kept = [], [], []
        for text, lo, hi in zip(docs_.texts, ends - counts, ends):
            words, mask = (text or b"").split(), gone[lo:hi]
            removed.append(int(mask.sum()))
            if removed[-1]:
                spans.append([{"start": s, "end": e} for s, e in B.rows_between(*H.runs(mask))])
                words = compress(words, (~mask).tolist())
            else:
                spans.append([])
            kept.append(b" ".join(words))
        return pa.table([
            docs_.table["_id"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            pa.array(kept, pa.binary()).cast(pa.string())], names=out.names)

    out = T.StructType([
        T.StructField(id_col, T.LongType()), T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept", T.StringType())])
    packed = blocks.each(hash_block, B.PACKED)
    return blocks.each_with(B.compare(packed, buckets, B.in_earlier, True), remove, out)
