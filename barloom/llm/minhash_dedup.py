"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, then verified.

A document is the set of its shingles of ``size`` words (lower-case ASCII; ASCII letters, digits and all
non-ASCII characters make words), weighted by (1 + ln tf) * idf. The idf is 1 for a shingle in every document and
1 + IDF_SPAN for the rarest, so that the copies of a text, which raise the counts of their own shingles, stay
alike. Document counts cover the whole corpus.

Two documents of similarity s or more share shingles of at least s of each one's weight, so a document
whose shingles of a count over one have less is a group of its own. This is exact and leaves few
documents for the sampling. Equal shingle weights make one class of copies, which goes on as one node.
In each band the nodes of a bucket are compared with a leader, the one with the least weight of shingles of its own (of
a text and its edited copies that is the text). Then, where a bucket still has nodes of several groups, those outside their leader's group are
compared with all others of the bucket that they can be like: the weights of own shingles, which no other node has, bound a pair's
similarity, and so does the triangle inequality of the Jaccard distance. Groups are connected components.
A pair of similarity 0.8 meets in a band with a chance of 1 - (1 - 0.8**4)**16 = 0.9998.

A text of fewer words than ``size`` is one shingle; null texts and texts without words are groups of their own, and
so are rows with null ids. Rows with equal ids stand or fall together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import blocks as B
from barloom.llm import hashing as H
from barloom.llm.cluster import cut, small_batches, stored
from barloom.llm.components import components

SIZE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
IDF_SPAN = 0.1

_TABLE = 1 << 16
_CACHE: dict[str, np.ndarray] = {}


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of _TABLE equal steps of probability."""
    if "gamma" not in _CACHE:
        x = np.concatenate(([0.0], np.geomspace(1e-4, 40, 400_000)))
        _CACHE["gamma"] = np.interp((np.arange(_TABLE) + 0.5) / _TABLE, 1 - (1 + x) * np.exp(-x), x).astype(np.float32)
        _CACHE["log"] = np.log(_CACHE["gamma"])
    return _CACHE["gamma"]


def signatures(keys: np.ndarray, weights: np.ndarray, starts: np.ndarray, samples: int) -> np.ndarray:
    """(samples, documents): the consistent weighted samples of documents that begin at ``starts``.

    A sample is the least a = ln c - r (t - beta) - r over the shingles, t = floor(ln w / r + beta), with r and c from
    Gamma(2, 1) and beta uniform, all drawn by the shingle's hash. Its value, with bits of the hash to break ties,
    stands for the shingle and t: documents draw equal values with a chance of their weighted Jaccard similarity.
    """
    gamma = _gamma_quantiles()
    log_gamma, log_w = _CACHE["log"], np.log(weights).astype(np.float32)
    low = H.mix(keys) >> np.uint64(32)
    out = np.empty((samples, len(starts)), np.uint64)
    for k in range(samples):
        bits = H.mix(keys + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        r = gamma[bits & np.uint64(0xFFFF)]
        beta = (bits >> np.uint64(40)).astype(np.float32) * np.float32(2.0 ** -24)
        a = log_gamma[(bits >> np.uint64(16)) & np.uint64(0xFFFF)] - r * (np.floor(log_w / r + beta) - beta) - r
        order = a.view(np.uint32)
        order = np.where(order >> np.uint32(31), ~order, order | np.uint32(1 << 31)).astype(np.uint64)
        out[k] = np.minimum.reduceat(order << np.uint64(32) | low, starts)
    return out


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands): one 64-bit key for the samples of each band."""
    out = np.empty((samples.shape[1], bands), np.int64)
    for b in range(bands):
        key = np.full(samples.shape[1], b + 1, np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            key = H.mix(key * np.uint64(0x9E3779B97F4A7C15) + samples[k])
        out[:, b] = key.view(np.int64)
    return out


def _shingles(texts: list[bytes | None], size: int, shift: int):
    """Distinct (key, document) pairs in order of key: sorted distinct keys, the key's index, document and tf of each."""
    hashes, counts = H.word_hashes(texts, H.ALNUM_LOWER)
    keys, starts = H.word_windows(hashes, counts, size)
    ends = np.cumsum(counts)
    owner = np.searchsorted(ends, starts, "right")
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.array([H.mix(H.prefix_sums(hashes[ends[d] - counts[d]:ends[d]])[-1:] + np.uint64(counts[d]))[0]
                          for d in short], np.uint64)
        keys, owner = np.concatenate((keys, whole)), np.concatenate((owner, short))
    keys = keys >> np.uint64(shift) << np.uint64(shift)
    by_doc = np.argsort(owner, kind="stable")
    keys, owner = keys[by_doc], owner[by_doc]
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    new_key = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    new = new_key.copy()
    if len(keys):
        new[1:] |= owner[1:] != owner[:-1]
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(keys)))
    return keys[new_key], np.cumsum(new_key)[at] - 1, owner[at], tf


def weighted_jaccard(a_keys: np.ndarray, a_weights: np.ndarray, b_keys: np.ndarray, b_weights: np.ndarray) -> float:
    """Sum of minima over sum of maxima; keys sorted and distinct."""
    at = np.minimum(np.searchsorted(b_keys, a_keys), len(b_keys) - 1)
    same = b_keys[at] == a_keys
    both = np.minimum(a_weights[same], b_weights[at[same]]).sum()
    return float(both / (a_weights.sum() + b_weights.sum() - both))


def _planes(x: np.ndarray, width: int) -> bytes:
    return x.view(np.uint8).reshape(len(x), -1)[:, :width].T.tobytes()


def _from_planes(data: bytes, width: int, dtype) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], np.dtype(dtype).itemsize), np.uint8)
    out[:, :width] = planes.T
    return out.view(dtype).ravel()


def _similarities(pairs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``pairs`` (a, b) with the weighted Jaccard similarity of their nodes."""
    side = lambda name: nodes.select(
        F.col("node").alias(name), F.struct("keys", "weights").alias(f"{name}_vector"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, 256) for whole in batches for lo in range(0, whole.num_rows, 256)):
            known: dict[bytes, tuple] = {}

            def vector(node, row):
                if node not in known:
                    known[node] = (_from_planes(row["keys"], width, np.uint64),
                                   _from_planes(row["weights"], 4, np.float32).astype(np.float64))
                return known[node]

            a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
            scores = []
            for x, y, u, v in zip(a, b, batch["a_vector"], batch["b_vector"]):
                scores.append(weighted_jaccard(*vector(x, u.as_py() if x not in known else None),
                                               *vector(y, v.as_py() if y not in known else None)))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(scores, pa.float64())],
                                             names=["a", "b", "similarity"])

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_vector", "b_vector") \
        .mapInArrow(verify, "a binary, b binary, similarity double")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                    threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: id, group_id (the least id of its group), group_size, keep (is it that one)."""
    small_batches(docs.sparkSession)
    blocks = B.Blocks(docs, id_col, text_col)
    buckets, n_docs = blocks.count, max(blocks.rows, 1)
    shift = max(0, 64 - max(32, blocks.bytes.bit_length() + 10))  # a shingle meets a wrong one at odds of 1 in 1,000 at most
    width = (64 - shift + 7) // 8

    def count(table: pa.Table) -> pa.Table:
        block = table["_block"][0].as_py()
        keys, index, _, _ = _shingles(table["_text"].cast(pa.binary()).to_pylist(), size, shift)
        return B.pack(block, 0, keys, np.bincount(index, minlength=len(keys)).astype(np.uint32), buckets, shift)

    def sample(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys, index, owner, tf = _shingles(table["_text"].cast(pa.binary()).to_pylist(), size, shift)
        df = B.answers_of(answers, len(keys), np.uint32)[index]
        rarity = np.log((n_docs + 1) / (df + 1.0)) / math.log(n_docs + 1)
        weights = ((1 + np.log(tf)) * (1 + IDF_SPAN * np.maximum(rarity, 0))).astype(np.float32)
        n = table.num_rows
        total = np.bincount(owner, weights, n)
        shared = np.bincount(owner, weights * (df > 1), n)
        maybe = (total > 0) & (shared >= (threshold - 1e-6) * total)
        pick = np.flatnonzero(maybe[owner])
        pick = pick[np.argsort(owner[pick], kind="stable")]
        keys, weights, owner, df = keys[index[pick]], weights[pick], owner[pick], df[pick]
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.empty(0, int)
        drawn = band_keys(signatures(keys, weights, starts, bands * rows), bands, rows) if len(starts) else np.empty((0, bands), np.int64)
        ends = np.append(starts[1:], len(owner))
        vectors = [(_planes(keys[s:e] >> np.uint64(shift), width), _planes(weights[s:e], 4)) for s, e in B.rows_between(starts, ends)]
        return pa.table([
            table["_id"].take(pa.array(owner[starts])),
            pa.array([hashlib.md5(k + w).digest() for k, w in vectors], pa.binary()),
            pa.array(drawn.tolist(), pa.list_(pa.int64())),
            pa.array([k for k, _ in vectors], pa.binary()), pa.array([w for _, w in vectors], pa.binary()),
            pa.array([_planes(np.ascontiguousarray(df[s:e]), 4) for s, e in B.rows_between(starts, ends)], pa.binary())],
            names=["id", "node", "bands", "keys", "weights", "counts"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Total weight of each node, and that of the shingles that only its copies have."""
        for batch in batches:
            total, own = [], []
            for copies, w, df in zip(batch["copies"].to_pylist(), batch["weights"], batch["counts"]):
                w, df = _from_planes(w.as_py(), 4, np.float32).astype(np.float64), _from_planes(df.as_py(), 4, np.uint32)
                total.append(float(w.sum()))
                own.append(float(w[df <= copies].sum()))
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in ("node", "copies", "bands", "keys", "weights")],
                                              pa.array(total, pa.float64()), pa.array(own, pa.float64())],
                                             names=["node", "copies", "bands", "keys", "weights", "total", "own"])

    counts = B.compare(blocks.each(count, B.PACKED), buckets, B.in_total, False, np.uint32, shift)
    found = stored(blocks.each_with(
        counts, sample, "id long, node binary, bands array<long>, keys binary, weights binary, counts binary"), "near")
    nodes = cut(found.groupBy("node").agg(F.first(F.struct("bands", "keys", "weights", "counts")).alias("v"),
                                          F.count(F.lit(1)).alias("copies")).select("node", "copies", "v.*")
                .mapInArrow(measure, "node binary, copies long, bands array<long>, keys binary, weights binary, total double, own double"))

    in_band = nodes.select("node", F.round(F.col("own") / F.col("total"), 3).alias("share"), "copies",
                           F.posexplode("bands").alias("band", "key"))
    turn = F.struct("share", -F.col("copies"), F.xxhash64("node", "band"), F.col("node").alias("node"))
    leaders = in_band.groupBy("band", "key").agg(F.min(turn)["node"].alias("leader"), F.count(F.lit(1)).alias("n")) \
        .where("n > 1").select("band", "key", "leader")
    members = cut(in_band.select("node", "band", "key").join(leaders, ["band", "key"]).where("node != leader"))
    pair = [F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")]
    near = cut(_similarities(members.select(*pair).distinct(), nodes, width))
    links = near.where(F.col("similarity") >= threshold).select("a", "b")
    labels = components(links)

    # Nodes that are not in their leader's group, with the others of the bucket that are not in their own.
    root = lambda name: labels.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    placed = members.join(root("node"), "node", "left").join(root("leader"), "leader", "left") \
        .withColumns({"node_root": F.coalesce("node_root", "node"), "leader_root": F.coalesce("leader_root", "leader")}) \
        .withColumns({"a": pair[0], "b": pair[1]}).join(near, ["a", "b"]) \
        .join(nodes.select("node", "bands", "total", "own"), "node") \
        .select("band", "key", "node", F.col("node_root").alias("root"), (F.col("node_root") != F.col("leader_root")).alias("outside"),
                "similarity", "bands", "total", "own")
    outside = placed.where("outside").drop("outside")
    outside = outside.withColumnsRenamed({c: f"x_{c}" for c in outside.columns if c not in ("band", "key")})
    common = F.least(F.col("x_total") - F.col("x_own"), F.col("total") - F.col("own"))  # no pair shares more
    bound = common / (F.col("x_total") + F.col("total") - common)
    first_band = F.array_position(F.zip_with("x_bands", "bands", lambda p, q: p == q), True) == F.col("band") + 1
    rest = outside.join(placed, ["band", "key"]).where(
        (F.col("x_root") != F.col("root")) & (~F.col("outside") | (F.col("x_node") < F.col("node"))) & (bound >= threshold - 1e-6)
        & (F.abs(F.col("x_similarity") - F.col("similarity")) <= 1 - threshold + 1e-6) & first_band) \
        .select(F.least("x_node", "node").alias("a"), F.greatest("x_node", "node").alias("b")).distinct() \
        .join(near, ["a", "b"], "left_anti")
    more = cut(_similarities(rest, nodes, width).where(F.col("similarity") >= threshold).select("a", "b"))
    if not more.isEmpty():
        labels = components(links.union(more))

    grouped = found.select("id", "node").join(labels, "node", "left") \
        .select("id", F.coalesce("root", "node").alias("root")).groupBy("id").agg(F.min("root").alias("root"))
    least = grouped.groupBy("root").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("group_size"))
    groups = grouped.join(least, "root").where("group_size > 1").select(F.col("id").alias(id_col), "group_id", "group_size")
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias(id_col))
    return ids.join(groups, id_col, "left").select(
        id_col, F.coalesce("group_id", id_col).alias("group_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col(id_col).isNull() | F.col("group_id").isNull() | (F.col("group_id") == F.col(id_col))).alias("keep"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose group keeps another id.

    The ids that go are written first: Spark then knows their size before it plans the join, and moves the texts only if the ids are
    too many for its own broadcast limit.
    """
    name = max(docs.columns, key=len) + "_gone"  # no column of docs has it
    gone = stored(near_duplicates(docs.select(id_col, text_col), id_col, text_col, **options).where("NOT keep")
                  .select(F.col(f"`{id_col}`").alias(name)).distinct(), "gone")
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(f"`{name}`"), "left_anti")
