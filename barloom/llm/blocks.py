"""Documents in blocks of neighbouring ids, and an exchange of packed hash lists between them.

A hash of every window of a corpus is more rows than its text has bytes to spare. Here a block
(a few MB of whole documents) sorts its hashes, keeps each once, cuts the sorted list at fixed
hash values into buckets and packs each piece as byte planes of its gaps: 5 to 6 bytes a hash in
one row for each (block, bucket). The task of a bucket compares the lists of all blocks, and each
list gets an answer of a bit or a few bytes a hash, in the same order, which the block reads beside
its documents. Blocks hold ranges of ids, so "in an earlier document" is "in an earlier block", and
inside a block it is decided on the spot.

The answers need no row ids: a block makes the same list again from the same documents. The
exchange of the documents by block is written once and read by every pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.cluster import ship
from barloom.llm.hashing import groups_of

BLOCK_BYTES = 4 << 20
NULL_ID = np.iinfo(np.int64).max

PACKED = "_block int, _order int, _bucket int, _n int, _width int, _keys binary, _values binary"
ANSWERS = "_block int, _bucket int, _n int, _answers binary"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Blocks:
    """``frame``: _block, _id, _text, _rest (all other columns as a struct) of ``docs``.

    Ids must be integers. Rows with a null id count as later than every other id and as equal to
    each other. ``count`` blocks hold ids; rows with null ids go to further blocks by their text's hash.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES):
        spark = docs.sparkSession
        ship(spark)
        ident, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
        rest = [f for f in docs.schema.fields if f.name not in (id_col, text_col)]
        self.rest = T.StructType(rest)
        size = docs.agg(F.sum(F.octet_length(text)).alias("n"), F.count(F.lit(1)).alias("rows"),
                        F.min(ident).alias("least"), F.count(ident).alias("ids")).first()
        self.bytes, self.rows, self.least, self.nulls = size["n"] or 0, size["rows"], size["least"], size["rows"] - size["ids"]
        wanted = max(1, -(-self.bytes // block_bytes), shuffle_partitions(spark))
        cuts = docs.select(F.percentile_approx(
            ident, [k / wanted for k in range(1, wanted)] or [0.5], 20 * wanted).alias("cuts")).first()["cuts"]
        self.cuts = sorted(set(cuts or []))
        self.count = len(self.cuts) + 1
        spare = max(1, self.count // 2)
        block = F.when(ident.isNull(), F.lit(self.count) + F.pmod(F.xxhash64(text), F.lit(spare)).cast("int")) \
            .otherwise(self._block_of(ident))
        self.frame = docs.select(
            block.alias("_block"), ident.alias("_id"), text.alias("_text"),
            (F.struct(*[F.col(f"`{f.name}`") for f in rest]) if rest else F.lit(None).cast("struct<_none:int>")).alias("_rest"))

    def _block_of(self, ident):
        """The number of cuts at or below the id, by binary search over the literal array."""
        if not self.cuts:
            return F.lit(0)
        n = len(self.cuts)
        cuts = F.lit(self.cuts)
        steps = F.lit([1 << k for k in range(n.bit_length() - 1, -1, -1)])
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
            (at + step <= n) & (F.get(cuts, at + step - 1) <= ident), at + step).otherwise(at))

    @staticmethod
    def _tidy(fn: Callable) -> Callable:
        """fn, after which a worker hands back the buffers that it no longer needs."""

        def run(*tables: pa.Table) -> pa.Table:
            out = fn(*tables)
            pa.default_memory_pool().release_unused()
            return out

        # Spark tells the forms of a grouped function apart by the number of its parameters.
        return (lambda docs: run(docs)) if fn.__code__.co_argcount == 1 else (lambda docs, answers: run(docs, answers))

    def each(self, fn: Callable[[pa.Table], pa.Table], schema) -> DataFrame:
        """fn over the documents of each block."""
        return self.frame.groupBy("_block").applyInArrow(self._tidy(fn), schema)

    def each_with(self, answers: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
        """fn over the documents of each block and the answers its lists got."""
        return self.frame.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(self._tidy(fn), schema)


class Documents:
    """The rows of one block in order of id: ids, ranks (equal for equal ids), texts as bytes."""

    def __init__(self, table: pa.Table):
        ids = np.array([NULL_ID if x is None else x for x in table["_id"].to_pylist()], np.int64)
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        self.ranks = np.cumsum(np.concatenate(([0], (np.diff(self.ids) != 0).astype(np.int64)))) if len(ids) else ids
        texts = table["_text"].cast(pa.binary()).to_pylist()
        self.texts = [texts[k] for k in self.order]
        self.table = table.take(pa.array(self.order))


def _lower(bucket: int, buckets: int) -> int:
    return -(-(bucket << 32) // buckets) << 32


def lower_bounds(buckets: int) -> np.ndarray:
    return np.array([_lower(b, buckets) for b in range(buckets)], np.uint64)


def pack(block: int, order: int, keys: np.ndarray, values: np.ndarray | None, buckets: int, shift: int = 0) -> pa.Table:
    """Rows of PACKED from sorted distinct keys and, if given, a value for each. The lowest ``shift`` bits, at
    most 32, are not sent and must be zero."""
    edges = np.append(np.searchsorted(keys, lower_bounds(buckets)), len(keys))
    rows: list[tuple] = []
    for b in range(buckets):
        part = keys[edges[b]:edges[b + 1]]
        if len(part):
            gaps = np.diff(part, prepend=np.uint64(_lower(b, buckets))) >> np.uint64(shift)
            width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
            planes = gaps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
            rows.append((b, len(part), width, planes,
                         None if values is None else values[edges[b]:edges[b + 1]].tobytes()))
    cols = list(zip(*rows)) if rows else [[]] * 5
    whole = lambda x: pa.array(x, pa.int32())
    return pa.table({
        "_block": whole([block] * len(rows)), "_order": whole([order] * len(rows)), "_bucket": whole(cols[0]),
        "_n": whole(cols[1]), "_width": whole(cols[2]), "_keys": pa.array(cols[3], pa.binary()),
        "_values": pa.array(cols[4], pa.binary())})


def note(block: int, data: bytes) -> pa.Table:
    """A row of PACKED that a block writes to itself: it comes back among the answers as it is."""
    whole = lambda x: pa.array([x], pa.int32())
    return pa.table({"_block": whole(block), "_order": whole(0), "_bucket": whole(-1 - block), "_n": whole(0),
                     "_width": whole(0), "_keys": pa.array([data], pa.binary()), "_values": pa.array([None], pa.binary())})


def without_note(answers: pa.Table) -> tuple[bytes, pa.Table]:
    own = np.array(answers["_bucket"].to_pylist()) < 0
    return answers.filter(pa.array(own))["_answers"][0].as_py(), answers.filter(pa.array(~own))


def _unpack(n: int, width: int, planes: bytes, lower: int, shift: int) -> np.ndarray:
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return np.cumsum(gaps.view(np.uint64).ravel() << np.uint64(shift), dtype=np.uint64) + np.uint64(lower)


def compare(packed: DataFrame, buckets: int,
            fn: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], bits: bool, values_as=np.uint8,
            shift: int = 0) -> DataFrame:
    """ANSWERS: fn(keys, orders, values) of each bucket gives one answer for each key it got."""

    def bucket(table: pa.Table) -> pa.Table:
        if table["_bucket"][0].as_py() < 0:
            return table.select(["_block", "_bucket", "_n", "_keys"]).rename_columns(["_block", "_bucket", "_n", "_answers"])
        lower = _lower(table["_bucket"][0].as_py(), buckets)
        sizes = table["_n"].to_pylist()
        keys = np.concatenate([_unpack(n, w, k.as_buffer(), lower, shift) for n, w, k in
                               zip(sizes, table["_width"].to_pylist(), table["_keys"])])
        orders = np.repeat(np.array(table["_order"].to_pylist(), np.int32), sizes)
        values = np.concatenate([np.frombuffer(v.as_buffer(), values_as) if v.is_valid else np.zeros(n, values_as)
                                 for n, v in zip(sizes, table["_values"])])
        answers = fn(keys, orders, values)
        at = np.concatenate(([0], np.cumsum(sizes)))
        parts = [answers[at[k]:at[k + 1]] for k in range(len(sizes))]
        return pa.table({
            "_block": table["_block"], "_bucket": table["_bucket"], "_n": table["_n"],
            "_answers": pa.array([(np.packbits(p) if bits else p).tobytes() for p in parts], pa.binary())})

    return packed.groupBy("_bucket").applyInArrow(bucket, ANSWERS)


def answers_of(table: pa.Table, expected: int, dtype=None) -> np.ndarray:
    """The answers to a block's list, in its order; bits unless dtype is given."""
    parts = sorted(zip(table["_bucket"].to_pylist(), table["_n"].to_pylist(), table["_answers"].to_pylist()))
    arrays = [np.frombuffer(a, dtype) if dtype else np.unpackbits(np.frombuffer(a, np.uint8), count=n) > 0
              for _, n, a in parts]
    out = np.concatenate(arrays) if arrays else np.zeros(0, dtype or bool)
    if len(out) != expected:
        raise ValueError(f"a block made {expected} keys and got {len(out)} answers: its documents changed between passes")
    return out


def in_earlier(keys: np.ndarray, orders: np.ndarray, _values: np.ndarray) -> np.ndarray:
    """Whether a list of a smaller order has the key too."""
    order, starts, sizes = groups_of(keys)
    ranked = orders[order]
    out = np.zeros(len(keys), bool)
    if len(keys):
        out[order] = ranked > np.repeat(np.minimum.reduceat(ranked, starts), sizes)
    return out


def in_several(keys: np.ndarray, _orders: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether another list has the key too, or one has it with a value over 0."""
    order, starts, sizes = groups_of(keys)
    out = np.zeros(len(keys), bool)
    if len(keys):
        out[order] = np.repeat((sizes > 1) | (np.maximum.reduceat(values[order], starts) > 0), sizes)
    return out


def in_total(keys: np.ndarray, _orders: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of the values that all lists have for the key."""
    order, starts, sizes = groups_of(keys)
    out = np.zeros(len(keys), values.dtype)
    if len(keys):
        out[order] = np.repeat(np.add.reduceat(values[order], starts), sizes)
    return out


def rows_between(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    return zip(starts.tolist(), ends.tolist())
