"""Document fingerprints: SimHash of weighted terms, and permuted block tables for all fingerprints within a Hamming radius.

A term is a run of ``size`` words (lower-case ASCII; ASCII letters, digits and all non-ASCII characters make words), or the whole
text if it has fewer; its weight is 16 (1 + log2 tf), rounded. Each term's 64-bit hash votes its weight on
each bit, for a one and against a zero, and a fingerprint bit is one if the votes for it win. Equal texts have equal
fingerprints. A null or empty text, and one without words, has the fingerprint 0.

For the search, fingerprints are cut into ``blocks`` blocks of bits. Two that differ in at most ``radius`` bits agree on at least
blocks - radius of them, so each choice of that many blocks, moved to the front, is a table whose key is their bits, and a
search looks only at fingerprints of equal keys. Copies count as one fingerprint with a number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import blocks as B
from barloom.llm import hashing as H

SIZE = 2
RADIUS = 3
BLOCKS = 6
BITS = 64


def fingerprints(texts: list[bytes | None], size: int = SIZE) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text."""
    out = np.zeros(len(texts), np.uint64)
    lo = total = 0
    for k, text in enumerate(texts):
        total += len(text or b"")
        if total >= 1 << 20 or k == len(texts) - 1:
            out[lo:k + 1] = _fingerprints(texts[lo:k + 1], size)
            lo, total = k + 1, 0
    return out


def _fingerprints(texts: list[bytes | None], size: int) -> np.ndarray:
    hashes, counts = H.word_hashes(texts, H.ALNUM_LOWER)
    keys, starts = H.word_windows(hashes, counts, size)
    ends = np.cumsum(counts)
    owner = np.searchsorted(ends, starts, "right")
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        keys = np.concatenate((keys, H.mix(hashes[ends[short] - counts[short]])))
        owner = np.concatenate((owner, short))
    out = np.zeros(len(texts), np.uint64)
    if not len(keys):
        return out
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    at = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))))
    weights = np.rint(16 * (1 + np.log2(np.diff(np.append(at, len(keys)))))).astype(np.float32)
    keys, owner = keys[at], owner[at]
    heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    for lo, hi in B.rows_between(heads, np.append(heads[1:], len(owner))):
        votes = np.zeros(BITS, np.float64)
        for k in range(lo, hi, 1 << 14):  # sums of whole numbers below 2**24 are exact
            part = slice(k, min(hi, k + (1 << 14)))
            bits = np.unpackbits(keys[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            votes += 2 * (weights[part] @ bits) - weights[part].sum()
        out[owner[lo]] = np.packbits(votes > 0, bitorder="little").view(np.uint64)[0]
    return out


def likeness(a: Column, b: Column) -> Column:
    """1 - Hamming distance / 64."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def edited_text(text: str, following: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as much of the start of ``following``, or all of it."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row per row of ``docs``: id, n_chars, edited (text), fingerprint, edited_fingerprint, next_fingerprint (as longs).

    The next document is the one of the next id; after the last comes the first. Rows of equal ids are in order of their texts, null
    texts first; rows of null ids come last. Documents are sorted inside blocks of ids, and the first document of each block is sent to
    the block before it too, so nothing is sorted as a whole.
    """
    blocks = B.Blocks(docs, id_col, text_col)
    last = blocks.count
    # One block for null ids here, since its rows have an order.
    frame = blocks.frame.select(F.least(F.col("_block"), F.lit(last)).alias("_block"), "_id", "_text")
    # The first id of block b > 0 is the cut below it.
    first_block = last if blocks.least is None else 0 if not blocks.cuts or blocks.least < blocks.cuts[0] else 1
    last_block = last if blocks.nulls else last - 1
    head = F.when(F.col("_block") == first_block, F.lit(blocks.least)).otherwise(F.get(
        F.lit(blocks.cuts).cast("array<long>"), F.col("_block") - 1)) if blocks.cuts else F.lit(blocks.least)
    at_head = F.col("_id").isNull() | (F.col("_id") == head)
    send = F.when(F.col("_block") == first_block, last_block).otherwise(F.col("_block") - 1)
    own = frame.withColumn("_own", F.lit(True))
    lent = frame.where(at_head).groupBy("_block").agg(
        F.min(F.struct(F.col("_text").isNotNull().alias("k"), F.col("_text").alias("t"))).alias("s"), F.min("_id").alias("_id")) \
        .select(send.alias("_block"), "_id", F.col("s.t").alias("_text"), F.lit(False).alias("_own"))

    def work(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        following = [r["_text"] or "" for r in rows if not r["_own"]]
        rows = sorted((r for r in rows if r["_own"]), key=lambda r: (
            r["_id"] is None, r["_id"] or 0, r["_text"] is not None, r["_text"] or ""))
        texts = [r["_text"] or "" for r in rows]
        nexts = texts[1:] + following
        edited = [edited_text(t, n) for t, n in zip(texts, nexts)]
        prints = fingerprints([t.encode() for t in texts] + [following[0].encode()], size)
        changed = fingerprints([t.encode() for t in edited], size)
        return pa.table([
            pa.array([r["_id"] for r in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array(edited, pa.string()), pa.array(prints[:-1].view(np.int64)), pa.array(changed.view(np.int64)),
            pa.array(prints[1:].view(np.int64))], names=out.names)

    out = T.StructType([T.StructField(n, k) for n, k in (
        (id_col, T.LongType()), ("n_chars", T.LongType()), ("edited", T.StringType()), ("fingerprint", T.LongType()),
        ("edited_fingerprint", T.LongType()), ("next_fingerprint", T.LongType()))])
    return own.unionByName(lent).groupBy("_block").applyInArrow(work, out)


def _tables(blocks: int, radius: int) -> list[int]:
    """For each choice of blocks - radius blocks the mask of their bits, as a signed number."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << edges[b + 1]) - 1) ^ ((1 << edges[b]) - 1) for b in chosen)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return masks


def near_pairs(queries: DataFrame, prints: DataFrame, column: str = "fingerprint", radius: int = RADIUS,
               blocks: int = BLOCKS, asked_column: str | None = None) -> DataFrame:
    """(asked, found, distance, n_rows): each distinct fingerprint of ``queries`` with each distinct one of ``prints`` within
    ``radius`` bits, once, and the rows of ``prints`` that have it. Null fingerprints find and are nothing."""
    masks = F.array(*[F.lit(m).cast("long") for m in _tables(blocks, radius)])
    keyed = lambda df, name: df.select("*", F.posexplode(masks).alias("_table", "_mask")).select(
        *df.columns, "_table", F.col(name).bitwiseAND(F.col("_mask")).alias("_key"))
    many = prints.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("found")).agg(F.count(F.lit(1)).alias("n_rows"))
    name = asked_column or column
    asked = queries.where(F.col(name).isNotNull()).select(F.col(name).alias("asked")).distinct()
    near = F.bit_count(F.col("asked").bitwiseXOR(F.col("found")))
    pairs = keyed(many, "found").join(keyed(asked, "asked"), ["_table", "_key"]).where(near <= radius)
    return pairs.groupBy("asked", "found").agg(F.first("n_rows").alias("n_rows")) \
        .select("asked", "found", near.alias("distance"), "n_rows")


def near_documents(queries: DataFrame, prints: DataFrame, query_id: str = "doc_id", found_id: str = "doc_id",
                   column: str = "fingerprint", radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query_id, found_id, distance): each row of ``queries`` with each row of ``prints`` within ``radius`` bits.

    All of them, so copies make their product; ``near_pairs`` has one row for each pair of fingerprints."""
    pairs = near_pairs(queries, prints, column, radius, blocks).drop("n_rows")
    asking = queries.select(F.col(f"`{query_id}`").alias("query_id"), F.col(column).alias("asked"))
    members = prints.select(F.col(f"`{found_id}`").alias("found_id"), F.col(column).alias("found"))
    return pairs.join(asking, "asked").join(members, "found").select("query_id", "found_id", "distance")


def neighbours(queries: DataFrame, prints: DataFrame, query_id: str = "doc_id", column: str = "fingerprint",
               radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query_id, n_near, n_exact): the rows of ``prints`` within ``radius`` bits of the fingerprint of each row of ``queries``,
    and those of equal fingerprint. A query that is in ``prints`` finds itself. Null fingerprints find and are nothing."""
    found = near_pairs(queries, prints, column, radius, blocks).groupBy(F.col("asked").alias("_asked")).agg(
        F.sum("n_rows").alias("n_near"), F.sum(F.when(F.col("distance") == 0, F.col("n_rows")).otherwise(0)).alias("n_exact"))
    return queries.select(F.col(f"`{query_id}`").alias(query_id), F.col(column).alias("_asked")).join(found, "_asked") \
        .select(query_id, "n_near", "n_exact")
