"""Token ids in training order: a keyed Feistel permutation gives every sequence a global slot; shards have a fixed stride.

Documents are turned into token ids (an end-of-text id after each) and read as one stream in order of id. Sequence k has the tokens from
k * ``length`` on (the last one is filled up with the end-of-text id); a block of documents knows its place in the stream from the
counts of the blocks before it, so sequences go across blocks and don't depend on how the documents were parted. Sequence k of n goes
to slot P(k), where P is a balanced Feistel network over the next power of four, walked along its cycle until it is below n: a
permutation of 0 .. n - 1 that needs no sort, no table and no other sequence. Each partition takes a range of slots and writes shards of
``per_shard`` sequences: little-endian 16-bit ids, so that slot s is at byte (s mod per_shard) * 2 * length of shard s // per_shard.
A reader can start at any slot and goes through its shards from there in order.

Null texts have no tokens; an empty text is an end-of-text id. Rows of equal ids are in order of their tokens, null ids come last, by a hash of their text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm import blocks as B
from barloom.llm import hashing as H
from barloom.llm.cluster import shared_folder, ship

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's public pre-token pattern (fixed value) and its free id.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = 50256
LENGTH = 2048
PER_SHARD = 1024
KEY = 20240501
ROUNDS = 6

SHARDS = ("shard long, first_slot long, stride int, n_tokens array<int>, doc_ids array<array<long>>, data binary")
_ENCODERS: dict[int, object] = {}


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _feistel(x: np.ndarray, half: int, key: int, rounds: range) -> np.ndarray:
    mask, width = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> width, x & mask
    forward = rounds.step > 0
    for r in rounds:
        salt = np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
        if forward:
            left, right = right, left ^ (H.mix(right + salt) & mask)
        else:
            left, right = right ^ (H.mix(left + salt) & mask), left
    return left << width | right


def _walk(x: np.ndarray, n: int, key: int, rounds: range) -> np.ndarray:
    half = _half_bits(n)
    out = _feistel(np.asarray(x, np.uint64), half, key, rounds)
    while len(far := np.flatnonzero(out >= np.uint64(n))):
        out[far] = _feistel(out[far], half, key, rounds)
    return out.astype(np.int64)


def slots_of(sequences: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slot of each sequence number below n."""
    return _walk(sequences, n, key, range(ROUNDS))


def sequences_at(slots: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The inverse of slots_of."""
    return _walk(slots, n, key, range(ROUNDS - 1, -1, -1))


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(ranks: dict[bytes, int]):
    import tiktoken

    if id(ranks) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(ranks)] = tiktoken.Encoding("shards", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[id(ranks)]


def _zipped(ids: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(ids.tobytes())


def _unzipped(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint16)


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", ranks: dict[bytes, int] | None = None,
                 length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> str:
    """Write the shards of ``docs`` as a table below ``folder`` and return it."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(ranks or read_ranks())
    blocks = B.Blocks(docs, id_col, text_col)
    parts = B.shuffle_partitions(spark)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value).encode_ordinary
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = [np.append(np.array(encode(t), np.uint16), np.uint16(END_OF_TEXT)) for t in part["_text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part["_block"], part["_id"], part["_hash"], pa.array(list(map(len, ids)), pa.int32()),
                    pa.array(list(map(_zipped, ids)), pa.binary())], names=["_block", "_id", "_hash", "_n", "_tokens"])

    # Blocks of null ids are ranges of the hash, as blocks of ids are ranges of ids.
    hashed = F.when(F.col("_id").isNull(), F.shiftrightunsigned(F.xxhash64("_text"), 33)).otherwise(F.lit(0).cast("long"))
    spare = max(1, blocks.count // 2)
    block = F.when(F.col("_id").isNull(), (blocks.count + F.floor(F.col("_hash") * spare / (1 << 31))).cast("int")).otherwise(F.col("_block"))
    # One exchange by block; the counts and the packing both read it.
    tokens = blocks.frame.where(F.col("_text").isNotNull()).withColumn("_hash", hashed).withColumn("_block", block) \
        .select("_block", "_id", "_hash", "_text") \
        .mapInArrow(tokenise, "_block int, _id long, _hash long, _n int, _tokens binary").repartition(parts, "_block")

    def count(table: pa.Table) -> pa.Table:
        return pa.table({"_block": table["_block"][:1], "_count": pa.array([sum(table["_n"].to_pylist())], pa.int64())})

    sizes = tokens.groupBy("_block").applyInArrow(count, "_block int, _count long")
    order = Window.orderBy("_block")  # one row a block
    offsets = sizes.select("_block", (F.sum("_count").over(order) - F.col("_count")).alias("_first"),
                           F.sum("_count").over(Window.partitionBy(F.lit(0))).alias("_total"))

    def pack(table: pa.Table, offset: pa.Table) -> pa.Table:
        """The parts of sequences that the block holds; only its first and last one go on in another block."""
        first, total = offset["_first"][0].as_py(), -(-offset["_total"][0].as_py() // length)
        rows = sorted(table.to_pylist(), key=lambda r: (r["_id"] is None, r["_id"] or 0, r["_hash"], r["_tokens"]))
        ids = [_unzipped(r["_tokens"]) for r in rows]
        stream = np.concatenate(ids)
        ends = np.cumsum([len(x) for x in ids])
        starts = ends - [len(x) for x in ids]
        sequences = np.arange(first // length, (first + len(stream) - 1) // length + 1)
        lo = np.maximum(sequences * length - first, 0)
        hi = np.minimum((sequences + 1) * length - first, len(stream))
        from_doc, to_doc = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left")
        numbers = [r["_id"] for r in rows]
        return pa.table({
            "slot": slots_of(sequences, total, key), "total": np.full(len(sequences), total), "start": first + lo - sequences * length,
            "n_tokens": (hi - lo).astype(np.int32),
            "doc_ids": pa.array([numbers[a:b] for a, b in B.rows_between(from_doc, to_doc)], pa.list_(pa.int64())),
            "tokens": pa.array([_zipped(stream[a:b]) for a, b in B.rows_between(lo, hi)], pa.binary())})

    rows = tokens.groupBy("_block").cogroup(offsets.groupBy("_block")).applyInArrow(
        pack, "slot long, total long, start long, n_tokens int, doc_ids array<long>, tokens binary")
    shard = F.expr(f"slot div {per_shard}")
    target = F.expr(f"cast((slot div {per_shard}) * {parts} div ((total - 1) div {per_shard} + 1) as int)")
    ranged = rows.withColumn("shard", shard).repartitionById(parts, target).sortWithinPartitions("slot", "start")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(number: int, own: list[dict]) -> pa.RecordBatch:
            """A shard of sequences, each a list of parts in order."""
            data = [np.concatenate([_unzipped(r["tokens"]) for r in parts]) for parts in own]
            data = [np.append(x, np.full(length - len(x), END_OF_TEXT, np.uint16)).tobytes() for x in data]
            return pa.RecordBatch.from_pylist([{
                "shard": number, "first_slot": number * per_shard, "stride": 2 * length,
                "n_tokens": [sum(r["n_tokens"] for r in parts) for parts in own],
                "doc_ids": [[i for r in parts for i in r["doc_ids"]] for parts in own], "data": b"".join(data)}], schema=shape)

        shape = pa.schema([("shard", pa.int64()), ("first_slot", pa.int64()), ("stride", pa.int32()), ("n_tokens", pa.list_(pa.int32())),
                           ("doc_ids", pa.list_(pa.list_(pa.int64()))), ("data", pa.binary())])
        at: int = -1
        own: list[list[dict]] = []
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != at and own:
                    yield row(at, own)
                    own = []
                at = r["shard"]
                if own and own[-1][0]["slot"] == r["slot"]:
                    own[-1].append(r)
                else:
                    own.append([r])
        if own:
            yield row(at, own)

    ranged.mapInArrow(build, SHARDS).write.option("compression", "zstd").parquet(folder)
    return folder


def read_sequences(spark: SparkSession, folder: str, first_slot: int = 0) -> DataFrame:
    """(slot, shard, byte_offset, n_tokens, doc_ids, tokens) from ``first_slot`` on; tokens are the stride's bytes.
    Shards before it are not read; how many sequences a shard has is taken from the shards."""
    ship(spark)
    shards = spark.read.schema(SHARDS).parquet(folder)
    later = shards.where("shard > 0").select(F.expr("first_slot div shard").alias("per_shard")).first() if first_slot > 0 else None
    first_shard = first_slot // later["per_shard"] if later else 0

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n, stride = len(r["n_tokens"]), r["stride"]
                rows = [k for k in range(n) if r["first_slot"] + k >= first_slot]
                yield pa.RecordBatch.from_pydict({
                    "slot": pa.array([r["first_slot"] + k for k in rows], pa.int64()), "shard": pa.array([r["shard"]] * len(rows), pa.int64()),
                    "byte_offset": pa.array([k * stride for k in rows], pa.int64()),
                    "n_tokens": pa.array([r["n_tokens"][k] for k in rows], pa.int32()),
                    "doc_ids": pa.array([r["doc_ids"][k] for k in rows], pa.list_(pa.int64())),
                    "tokens": pa.array([r["data"][k * stride:(k + 1) * stride] for k in rows], pa.binary())})

    return shards.where(F.col("shard") >= first_shard).mapInArrow(
        split, "slot long, shard long, byte_offset long, n_tokens int, doc_ids array<long>, tokens binary")


def in_training_order(docs: DataFrame, **options) -> DataFrame:
    """The sequences of ``docs``, written to new shards in the shared folder and read back."""
    spark = docs.sparkSession
    return read_sequences(spark, write_shards(docs, shared_folder(spark, "shards"), **options))
