"""Conversation structure repair: the cheapest edits that make the turns of a conversation alternate.

Roles count by their initials, which must read ``(s?(ua)+)?`` after the repair. A row is kept (cost 0), given the role user or assistant (3)
or deleted (4); blank rows and repeats of an earlier row must go; an unfinished row that stays costs 3 more; an empty user or assistant row
may be inserted anywhere (3). Of all cheapest repairs the one whose audit, its edits' initials in order, is least in ASCII is made.

Between two rows only four states can be told apart (nothing yet, system, user, assistant), so a row is a 4 x 4 matrix of least
costs and a run of rows the (min, +) product of theirs. Rows are range-partitioned in conversation order, so one conversation may span
many tasks: each task sends one matrix for each conversation piece, the pieces of a conversation are chained, and each task gets back
the costs to the end from where its piece leaves off. From these, the nodes (row, state) on optimal arcs are ranked by their least audits of
1, 2, 4, ... edits, and the pointers to the nodes that many edits on are doubled with them; the ranks pick each node's arc and the pointers
mark the path. Products and paths take log2(rows) vectorised rounds. In the end, one pass streams each conversation's rows
behind its audit, in bounded memory.

Null roles and texts are one space. Order in a conversation is by turn (nulls first), then role, the text's first PREFIX characters and its MD5;
rows equal in all are copies of one another. The null id is a conversation like others. Columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.cluster import ship, stored

RELABEL, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
PREFIX = 32
_SPACE = " \t\n\x0b\x0c\r"
_FAR = 1 << 28
_ROWS_A_SLICE = 1 << 16

# States: 0 nothing yet, 1 after the system row, 2 after a user's, 3 after an assistant's. 0 and 3 may end.
_NEXT = np.array([2, 2, 3, 2])  # by a user's row from 0, 1 and 3, by an assistant's from 2
_END = np.array([0, 2 * INSERT, INSERT, 0], np.int32)
_LABELS = np.frombuffer(b"\0DIKR", np.uint8)


def _keep_target(initial: int, state: int) -> int | None:
    """State after a kept row of that initial (0 s, 1 u, 2 a, 3 other)."""
    if initial == 0:
        return 1 if state == 0 else None
    return int(_NEXT[state]) if initial == (2 if state == 2 else 1) else None


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) products of stacked matrices."""
    out = np.full(a.shape[:-1] + b.shape[-1:], _FAR, np.int32)
    for c in range(a.shape[-1]):
        np.minimum(out, a[..., :, c, None] + b[..., c, None, :], out=out)
    return np.minimum(out, _FAR)


def _row_matrices() -> np.ndarray:
    """By row code: least costs from each state before a row, insertions there included, to each state after it."""
    insert = np.full((4, 4), _FAR, np.int32)
    np.fill_diagonal(insert, 0)
    insert[range(4), _NEXT] = INSERT
    insert = _times(insert, _times(insert, insert))
    rows = np.full((9, 4, 4), _FAR, np.int32)
    for code in range(9):
        np.fill_diagonal(rows[code], DELETE)
        if code < 8:
            extra = UNFINISHED if code >= 4 else 0
            for state in range(4):
                rows[code, state, _NEXT[state]] = min(rows[code, state, _NEXT[state]], RELABEL + extra)
                kept = _keep_target(code % 4, state)
                if kept is not None:
                    rows[code, state, kept] = min(rows[code, state, kept], extra)
    return _times(np.broadcast_to(insert, rows.shape), rows)


#: A row's code is its initial, 4 more if unfinished, or 8 if it must go.
_ROW = _row_matrices()
_KEPT = np.array([[-1 if _keep_target(i % 4, s) is None else _keep_target(i % 4, s) for s in range(4)] for i in range(8)] + [[-1] * 4])


def _suffix_products(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each row the product of the matrices from it to the end of its piece; ``ends`` has each row's piece end."""
    out = _ROW[codes]
    at, step = np.arange(len(codes)), 1
    while True:
        more = np.flatnonzero(at + step < ends)
        if not len(more):
            return out
        longer = _times(out[more], out[more + step])
        out[more] = longer
        step *= 2


def _least_paths(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, exits: np.ndarray, last: np.ndarray,
                 entries: np.ndarray) -> tuple[list[bytes], list[int]]:
    """Audit and last state of the least optimal path of each piece from its entry state.

    ``exits`` has, for each piece, the least costs to the conversation's end from the states after it, insertions there included.
    """
    pieces = len(starts)
    sizes = ends - starts
    piece = np.repeat(np.arange(pieces), sizes)
    column = np.arange(len(codes)) + piece  # each piece has a column more than rows
    final = ends + np.arange(pieces)
    cost = np.empty((len(codes) + pieces, 4), np.int32)
    cost[column] = _times(_suffix_products(codes, ends[piece]), exits[piece][:, :, None])[:, :, 0]
    cost[final] = exits

    label = np.zeros(cost.shape, np.int8)
    jump = np.arange(cost.size).reshape(cost.shape)
    here, after, code = cost[column], cost[column + 1], codes[:, None]
    extra = np.where((code >= 4) & (code < 8), UNFINISHED, 0)
    base = column[:, None] * 4

    def arcs():
        """(label, where it is optimal, target) of the arcs out of the rows' nodes, greatest label first."""
        to = np.broadcast_to(_NEXT, here.shape)
        yield 4, (code < 8) & (np.take_along_axis(after, to, 1) + RELABEL + extra == here), base + 4 + to
        kept = _KEPT[codes]
        known = np.maximum(kept, 0)
        yield 3, (kept >= 0) & (np.take_along_axis(after, known, 1) + extra == here), base + 4 + known
        yield 2, np.take_along_axis(here, to, 1) + INSERT == here, base + to
        yield 1, after + DELETE == here, base + 4 + np.arange(4)

    for k, optimal, target in arcs():  # labels out of a node differ, so the least label settles its rank of length one
        label[column] = np.where(optimal, k, label[column])
        jump[column] = np.where(optimal, target, jump[column])
    ending = final[last]
    for state in (1, 2):
        label[ending, state] = 2
        jump[ending, state] = ending * 4 + _NEXT[state]

    label, step = label.ravel(), jump.ravel()
    rank, jump, jumps = label.astype(np.int64), step, [step]
    while (rank[jump] > 0).any():  # rank: order of the least audits of 2**k edits, 0 for none
        pair = rank * (int(rank.max()) + 1) + rank[jump]
        rank = np.unique(pair, return_inverse=True)[1]
        jump = jump[jump]
        jumps.append(jump)
    start = (starts + np.arange(pieces)) * 4 + entries
    marked = np.zeros(len(label), bool)
    marked[start] = True
    for jump in jumps:
        marked[jump[np.flatnonzero(marked)]] = True
    path = np.flatnonzero(marked)
    flat = cost.ravel()
    path = path[np.lexsort((-flat[path], path // 4))]  # an insertion stays in its column and lowers the cost to go
    owner = np.searchsorted(final, path // 4)
    edits = label[path] > 0
    letters = _LABELS[label[path[edits]]].tobytes()
    bounds = np.searchsorted(owner[edits], np.arange(pieces + 1)).tolist()
    states = path[~edits] % 4
    return [letters[a:b] for a, b in zip(bounds, bounds[1:])], states.tolist()


# ---- rows in order

def _order(conv: str, turn: str) -> list[Column]:
    return [F.col(conv), F.col(turn), F.col("_role"), F.col("_prefix"), F.col("_digest")]


def _rows(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """_conv, _turn, _role, _text and the order's keys."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return rows.select(F.col(f"`{conv_col}`").alias("_conv"), F.col(f"`{turn_col}`").cast("long").alias("_turn"),
                       text(role_col).alias("_role"), text(text_col).alias("_text")) \
        .withColumns({"_prefix": F.left("_text", F.lit(PREFIX)), "_digest": F.unhex(F.md5("_text"))})


def _faults(rows: DataFrame) -> DataFrame:
    """A slim table in order: _at (its upper bits number the task), _conv, _turn, _initial, _fault (0, 1 blank, 2 duplicate, 3 truncated)."""
    initial = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in ("s", 0, "u", 1, "a", 2)]), F.left("_role", F.lit(1))), F.lit(3))
    tail = F.right(F.rtrim("_text", F.lit(_SPACE)), F.lit(1))
    keys = _order("_conv", "_turn")
    slim = rows.select("_conv", "_turn", "_role", "_prefix", "_digest", initial.cast("byte").alias("_initial"),
                       (tail == "").alias("_blank"), (~tail.isin(".", "!", "?")).alias("_open"),
                       F.monotonically_increasing_id().alias("_copy"))
    placed = stored(slim.repartitionByRange(*keys, "_copy").sortWithinPartitions(*keys, "_copy").select(
        F.monotonically_increasing_id().alias("_at"), "_conv", "_turn", "_initial", "_blank", "_open",
        F.unhex(F.md5(F.concat(F.to_json(F.struct("_conv", "_role")).cast("binary"), "_digest"))).alias("_same")), "turns")
    first = placed.where("NOT _blank").groupBy("_same").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")) \
        .where("_n > 1").drop("_n")
    fault = F.when(F.col("_blank"), 1).when(F.col("_at") > F.col("_first"), 2).when(F.col("_open"), 3).otherwise(0)
    return stored(placed.join(first, "_same", "left").select(
        "_at", "_conv", "_turn", "_initial", fault.cast("byte").alias("_fault"),
        F.shiftright("_at", 33).cast("int").alias("_part")), "faults")


class _Pieces:
    """The rows of one task in order, cut where the conversation changes."""

    def __init__(self, table: pa.Table):
        order = np.argsort(table["_at"].to_numpy(), kind="stable")
        self.table = table.take(pa.array(order))
        self.at = self.table["_at"].to_numpy()
        conv = self.table["_conv"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        self.starts = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
        self.ends = np.append(self.starts[1:], len(conv))
        self.initial = self.table["_initial"].to_numpy().astype(np.int64)
        self.fault = self.table["_fault"].to_numpy().astype(np.int64)
        self.codes = np.where((self.fault == 1) | (self.fault == 2), 8, self.initial + 4 * (self.fault == 3))

    def slices(self) -> Iterator[tuple[int, int]]:
        """Runs of whole pieces of about _ROWS_A_SLICE rows."""
        a = 0
        while a < len(self.starts):
            b = max(a + 1, int(np.searchsorted(self.ends, self.starts[a] + _ROWS_A_SLICE, "right")))
            yield a, b
            a = b


def _piece_table(table: pa.Table) -> pa.Table:
    """One row a piece: its counts, its ends and its matrix."""
    p = _Pieces(table)
    matrices = np.concatenate([
        _suffix_products(p.codes[p.starts[a]:p.ends[b - 1]], np.repeat(p.ends[a:b], p.ends[a:b] - p.starts[a:b]) - p.starts[a])
        [p.starts[a:b] - p.starts[a]] for a, b in p.slices()])
    i = p.initial
    inside = np.zeros(len(i), np.int64)
    inside[1:] = ~(((i[:-1] == 0) | (i[:-1] == 2)) & (i[1:] == 1) | (i[:-1] == 1) & (i[1:] == 2))
    inside[p.starts] = 0
    turns = p.table["_turn"]
    known = turns.is_valid().to_numpy()
    turn = turns.fill_null(0).to_numpy()
    new = known.copy()
    new[1:] &= ~known[:-1] | (turn[1:] != turn[:-1])
    new[p.starts] = known[p.starts]
    total = lambda x: np.add.reduceat(x.astype(np.int64), p.starts)
    has = total(known) > 0
    first_known = np.minimum(p.starts + total(~known), p.ends - 1)  # nulls come first
    return pa.table({
        "_conv": p.table["_conv"].take(pa.array(p.starts)), "_part": p.table["_part"].take(pa.array(p.starts)),
        "_at": pa.array(p.at[p.starts]), "rows": pa.array(p.ends - p.starts),
        **{name: pa.array(total(p.fault == k)) for k, name in ((1, "blank"), (2, "duplicate"), (3, "truncated"))},
        "illegal": pa.array(total(inside)), "first": pa.array(i[p.starts]), "final": pa.array(i[p.ends - 1]),
        "turns": pa.array(total(new)), "least": pa.array(turn[first_known], mask=~has),
        "greatest": pa.array(turn[p.ends - 1], mask=~has),
        "matrix": pa.array(matrices.reshape(-1, 16).tolist(), pa.list_(pa.int32()))})


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's counts and its least cost from its pieces, and each piece's costs to the end."""
    for batch in batches:
        out = []
        for pieces in batch["pieces"].to_pylist():
            counts = {k: sum(p[k] for p in pieces) for k in ("blank", "duplicate", "truncated", "illegal")}
            turns, last_turn = 0, None
            for p, q in zip(pieces, pieces[1:]):
                counts["illegal"] += (p["final"], q["first"]) not in _LEGAL
            for p in pieces:
                turns += p["turns"] - (p["least"] is not None and p["least"] == last_turn)
                last_turn = last_turn if p["greatest"] is None else p["greatest"]
            least = [p["least"] for p in pieces if p["least"] is not None]
            span = last_turn - least[0] + 1 - turns if least else 0
            costs, exits = _END[:, None], []
            for p in reversed(pieces):
                exits.append({"_part": p["_part"], "_at": p["_at"], "costs": costs.ravel().tolist(),
                              "first": p is pieces[0], "last": p is pieces[-1]})
                costs = _times(np.array(p["matrix"], np.int32).reshape(4, 4), costs)
            out.append({**counts, "gaps": span if span < 1 << 63 else None, "cost": int(costs[0, 0]), "exits": exits})
        kinds = pa.list_(pa.struct([("_part", pa.int32()), ("_at", pa.int64()), ("costs", pa.list_(pa.int32())),
                                    ("first", pa.bool_()), ("last", pa.bool_())]))
        names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        yield pa.RecordBatch.from_arrays(
            [batch["_conv"], *[pa.array([o[n] for o in out], pa.int64()) for n in names], pa.array([o["exits"] for o in out], kinds)],
            names=["_conv", *names, "exits"])


def _paths(rows: pa.Table, exits: pa.Table) -> pa.Table:
    """The audit and last state of each piece, from every state that it may be entered in."""
    p = _Pieces(rows)
    order = np.argsort(exits["_at"].to_numpy())
    costs = np.array(exits["costs"].to_pylist(), np.int32).reshape(-1, 4)[order]
    first, last = (np.array(exits[c].to_pylist(), bool)[order] for c in ("first", "last"))
    out: list[tuple[int, int, bytes, int]] = []
    # Only the first piece of a task can go on from a task before.
    for entry, a, b in [(0, a, b) for a, b in p.slices()] + [(entry, 0, 1) for entry in (1, 2, 3) if not first[0]]:
        base = p.starts[a]
        audits, states = _least_paths(p.codes[base:p.ends[b - 1]], p.starts[a:b] - base, p.ends[a:b] - base,
                                      costs[a:b], last[a:b], np.full(b - a, entry))
        out += [(int(p.starts[k]), entry, audits[k - a], states[k - a]) for k in range(a, b)]
    at, entry, audit, state = zip(*out)
    return pa.table({"_conv": p.table["_conv"].take(pa.array(at)), "_at": pa.array(p.at[list(at)]), "entry": pa.array(entry, pa.int32()),
                     "audit": pa.array(audit, pa.binary()).cast(pa.string()), "state": pa.array(state, pa.int32())})


def _join_audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of a conversation, entered in turn where the one before leaves off."""
    for batch in batches:
        audits = []
        for pieces in batch["pieces"].to_pylist():
            state, at, audit = 0, None, []
            for p in pieces:
                if p["_at"] != at and p["entry"] == state:
                    at, state = p["_at"], p["state"]
                    audit.append(p["audit"])
            audits.append("".join(audit))
        yield pa.RecordBatch.from_arrays([batch["_conv"], pa.array(audits, pa.string())], names=["_conv", "audit"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows from a stream of conversations: a row with the audit, then the rows in order."""
    edits: Iterator[str] = iter("")
    place = user = 0
    for batch in batches:
        conv, places, roles, texts, keep = batch["_conv"], [], [], [], []

        def emit(k: int, role: str | None, text: str) -> None:
            nonlocal place, user
            new = ("user", "assistant")[user] if role is None else role
            if not (place == 0 and new[:1] == "s"):
                user = 1 - user
            keep.append(k)
            places.append(place)
            roles.append(new)
            texts.append(text)
            place += 1

        audits, own_roles, own_texts = (batch[c].to_pylist() for c in ("_audit", "_role", "_text"))
        for k, (audit, role, text) in enumerate(zip(audits, own_roles, own_texts)):
            if audit is not None:
                edits, place, user = iter(audit), 0, 0
                rest = audit.rstrip("I")
                if not rest:  # a conversation of insertions only has no rows, so no audit either
                    continue
                tail = len(audit) - len(rest)
                left = sum(c != "I" for c in rest)
                continue
            for edit in edits:
                if edit == "I":
                    emit(k, None, "")
                    continue
                if edit != "D":
                    emit(k, role if edit == "K" else None, text)
                left -= 1
                break
            if left == 0:
                for _ in range(tail):
                    emit(k, None, "")
        yield pa.RecordBatch.from_arrays([conv.take(pa.array(keep, pa.int64())), pa.array(places, pa.int64()),
                                          pa.array(roles, pa.string()), pa.array(texts, pa.string())],
                                         names=["_conv", "place", "role", "text"])


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report, repaired). report: one row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    repaired: id, place, role, text of the rows after the edits; each conversation in one partition, in order."""
    ship(rows.sparkSession)
    kind = rows.schema[conv_col].dataType.simpleString()
    whole = _rows(rows, conv_col, turn_col, role_col, text_col)
    faults = _faults(whole)
    pieces = faults.groupBy("_part").applyInArrow(
        _piece_table, f"_conv {kind}, _part int, _at long, rows long, blank long, duplicate long, truncated long, illegal long, "
                      "first long, final long, turns long, least long, greatest long, matrix array<int>")
    listed = lambda df, *names: df.groupBy("_conv").agg(  # noqa: E731  one for each task that the conversation spans
        F.sort_array(F.collect_list(F.struct(*names))).alias("pieces"))
    chained = stored(listed(pieces, "_at", *[c for c in pieces.columns if c not in ("_conv", "_at")]).mapInArrow(
        _chain, f"_conv {kind}, {_COUNTS}, exits array<struct<_part:int,_at:long,costs:array<int>,first:boolean,last:boolean>>"), "pieces")
    exits = chained.select(F.inline("exits"))
    paths = faults.groupBy("_part").cogroup(exits.groupBy("_part")).applyInArrow(
        _paths, f"_conv {kind}, _at long, entry int, audit string, state int")
    audits = stored(listed(paths, "_at", "entry", "audit", "state").mapInArrow(_join_audits, f"_conv {kind}, audit string"), "audits")
    report = chained.drop("exits").join(audits.withColumnRenamed("_conv", "_own"), F.col("_conv").eqNullSafe(F.col("_own"))) \
        .drop("_own").withColumnRenamed("_conv", conv_col)
    stream = whole.withColumn("_audit", F.lit(None).cast("string")).unionByName(
        audits.withColumnRenamed("audit", "_audit"), allowMissingColumns=True).withColumn("_row", F.col("_audit").isNull())
    repaired = stream.repartition("_conv").sortWithinPartitions("_conv", "_row", *_order("_conv", "_turn")[1:]) \
        .select("_conv", "_audit", "_role", "_text").mapInArrow(_apply, f"_conv {kind}, place long, role string, text string") \
        .withColumnRenamed("_conv", conv_col)
    return report, repaired


def repaired_digests(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """SHA-256 of ``role:text`` of a conversation's rows joined by newlines; ``repaired`` as repair() returns it, read as a stream."""
    ship(repaired.sparkSession)
    kind = repaired.schema[conv_col].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None

        def done(ids: list, values: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(values, pa.string())], names=["_conv", "sha"])

        id_type = pa.null()
        for batch in batches:
            ids, values, id_type = [], [], batch["_conv"].type
            for conv, place, role, text in zip(*(batch[c].to_pylist() for c in ("_conv", "place", "role", "text"))):
                if place == 0:
                    if state is not None:
                        ids.append(own)
                        values.append(state.hexdigest())
                    own, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield done(ids, values)
        if state is not None:
            yield done([own], [state.hexdigest()])

    return repaired.withColumnRenamed(conv_col, "_conv").mapInArrow(digest, f"_conv {kind}, sha string") \
        .select(F.col("_conv").alias(conv_col), F.col("sha").alias("repaired_sha256"))


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with the faults that crc32 of ``conv:turn`` modulo 20 picks: 0 drops a row, 1 empties its text, 2 takes out its .!?,
    3 repeats it, 4 makes it a user's. Nulls are one space, in the key too; ids and turns stay null."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    pick = F.crc32(F.concat(text(conv_col), F.lit(":"), text(turn_col)).cast("binary")) % 20
    return rows.select(F.col(f"`{conv_col}`").alias(conv_col), F.col(f"`{turn_col}`").alias(turn_col), text(role_col).alias(role_col),
                       text(text_col).alias(text_col), pick.alias("_pick")).where("_pick != 0").select(
        conv_col, turn_col, F.when(F.col("_pick") == 4, "user").otherwise(F.col(role_col)).alias(role_col),
        F.when(F.col("_pick") == 1, "").when(F.col("_pick") == 2, F.translate(text_col, ".!?", "")).otherwise(F.col(text_col)).alias(text_col),
        F.explode(F.when(F.col("_pick") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")
