"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces with log scores.

The vocabulary file gives pieces in order of rank; a piece of rank r gets the Zipf log score -ln(r + 1) - ln(ln V + 0.5772).
A text gets a space in front, spaces are the whitespace marker, and the segmentation of the greatest sum of scores wins; of equal sums
the one whose last piece starts first. A character that is no piece by itself costs the least score - UNKNOWN_COST and becomes its UTF-8 bytes as byte
pieces. A marker character of the text itself is such a character, so decoding gives every text back exactly.

No piece has a space after another character or a line feed, so a text is cut before each run of spaces and at line feeds, and the parts
are segmented on their own. Each task keeps the parts it has met (emptied when full) and segments the new ones of about a
megabyte of text together, one trie step for all of them at a time. A part that has few of its length beside it, such as a long one without
spaces, is segmented on its own: the pieces in a window of its bytes are found together, and the best sums go over them byte by byte.

A null text has null ids and no tokens; an empty text has no tokens.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.cluster import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
UNKNOWN_COST = 10.0
_PART = re.compile(rb" *[^ \n]+| +|\n")
_CACHE_PARTS = 200_000
_GROUP_BYTES = 1 << 20
_WINDOW = 1 << 14
#: A byte of all parts together takes the time of about so many bytes of a part alone, and a part alone at least that of so many bytes.
_ALONE_BYTES, _ALONE_LEAST = 50, 100


class DoubleArray:
    """Trie over bytes in two arrays: the child of state s by byte b is t = base[s] + b + 1 if check[t] == s."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for number, key in enumerate(keys):
            at = 0
            for b in key:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    values.append(-1)
                at = children[at][b]
            values[at] = number
        size = 2 * len(children) + (1 << 13)
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        open_ = np.ones(size, bool)  # places that no state has yet
        check[0], open_[0] = 0, False
        place = [0] * len(children)
        free = 1
        for node in range(len(children)):
            codes = np.array(sorted(children[node]), np.int64)
            if not len(codes):
                continue
            while not open_[free]:
                free += 1
            at = max(0, free - int(codes[0]) - 1)
            while True:
                if at + 4096 + 300 > len(check):
                    base, value = np.append(base, np.zeros(size, np.int32)), np.append(value, np.full(size, -1, np.int32))
                    check, open_ = np.append(check, np.full(size, -1, np.int32)), np.append(open_, np.ones(size, bool))
                fits = np.logical_and.reduce([open_[at + c + 1:at + c + 1 + 4096] for c in codes])
                if fits.any():
                    at += int(fits.argmax())
                    break
                at += 4096
            base[place[node]] = at
            for c in codes.tolist():
                t, child = at + c + 1, children[node][c]
                check[t], place[child], value[t], open_[t] = place[node], t, values[child], False
        used = int(np.flatnonzero(~open_)[-1]) + 300
        self.base, self.check, self.value = base[:used], check[:used], value[:used]


class Vocabulary:
    """Pieces with log scores, their trie, and byte pieces. ``keys``: bytes of each id, None for control pieces."""

    def __init__(self, keys: list[bytes | None], scores: list[float], byte_ids: list[int]):
        if len(keys) > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        special = set(byte_ids)
        own = [k for k, key in enumerate(keys) if key is not None and k not in special]
        if any(b" " in keys[k].lstrip(b" ") or b"\n" in keys[k] for k in own):
            raise ValueError("a piece has a space or line feed inside")
        self.trie = DoubleArray([keys[k] for k in own])
        self.ids = np.array(own, np.int64)
        self.scores = np.array([scores[k] for k in own], np.float64)
        self.unknown = float(self.scores.min()) - UNKNOWN_COST
        self.byte_ids = np.array(byte_ids, np.int64)
        self.keys = [key or b"" for key in keys]

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        """From a SentencePiece model file with byte pieces; its pieces' order by score gives their ranks."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        keys: list[bytes | None] = []
        bytes_at: dict[int, int] = {}
        for k in range(size):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                bytes_at[int(piece[3:-1], 16)] = k
                keys.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                keys.append(None)
            else:
                keys.append(piece.replace(MARKER, " ").encode())
        special = set(bytes_at.values())
        own = sorted((k for k in range(size) if keys[k] is not None and k not in special), key=lambda k: -model.get_score(k))
        scores = [0.0] * size
        for rank, k in enumerate(own):
            scores[k] = -math.log(rank + 1) - math.log(math.log(len(own)) + 0.5772)
        return cls(keys, scores, [bytes_at[b] for b in range(256)])


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[bytes, bytes] = {}

    def segment(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each part as 16-bit numbers; parts of like lengths are segmented together."""
        out: list[bytes] = [b""] * len(parts)
        lengths = np.array([len(p) for p in parts], np.int64)
        order = np.argsort(lengths, kind="stable")
        k = 0
        while k < len(order):
            most = int(lengths[order[k]]) * 5 // 4 + 2
            stop = int(np.searchsorted(lengths[order], most, "right"))
            stop = max(k + 1, min(stop, k + max(1, (1 << 21) // most)))
            group = order[k:stop]
            chosen = [parts[i] for i in group]
            alone = len(group) * (most + _ALONE_LEAST) < _ALONE_BYTES * most
            for place, ids in zip(group.tolist(), map(self._alone, chosen) if alone else self._together(chosen)):
                out[place] = ids
            k = stop
        return out

    def _together(self, parts: list[bytes]) -> list[bytes]:
        v, trie = self.v, self.v.trie
        n, size = len(parts), max(map(len, parts))
        text = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in parts), np.uint8).reshape(n, size).T
        ends = np.array([len(p) for p in parts])
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        piece = np.full((size + 1, n), -1, np.int32)
        start = np.zeros((size + 1, n), np.int32)
        for i in range(size):
            rows = np.flatnonzero((best[i] > -np.inf) & (ends > i))
            if not len(rows):
                continue
            first = text[i, rows]
            width = 1 + (first >= 0xC0) + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
            alone = np.ones(n, bool)
            at, state = rows, np.zeros(len(rows), np.int64)
            for j in range(i, size):
                to = trie.base[state] + text[j, at] + 1
                good = (trie.check[to] == state) & (j < ends[at])
                at, state = at[good], to[good].astype(np.int64)
                if not len(at):
                    break
                value = trie.value[state]
                hit = value >= 0
                self._offer(best, piece, start, at[hit], i, j + 1, value[hit], v.scores[value[hit]])
                alone[at[hit]] &= width[np.searchsorted(rows, at[hit])] != j + 1 - i
            lone = alone[rows]
            for w in range(1, 5):
                pick = rows[lone & (width == w)]
                if len(pick) and i + w <= size:
                    self._offer(best, piece, start, pick, i, i + w, np.full(len(pick), -1, np.int32), v.unknown)
        return self._walk_back(text, ends, piece, start)

    def _matches(self, text: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and numbers of all pieces that start at lo..hi, in order of start, then of end."""
        trie, found = self.v.trie, []
        at, state = np.arange(lo, hi), np.zeros(hi - lo, np.int64)
        reach = 0
        while len(at):
            to = trie.base[state] + text[at + reach] + 1
            good = trie.check[to] == state
            at, state, reach = at[good], to[good].astype(np.int64), reach + 1
            value = trie.value[state]
            hit = value >= 0
            found.append((at[hit], at[hit] + reach, value[hit]))
            inside = at + reach < len(text)
            at, state = at[inside], state[inside]
        starts, ends, values = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order], values[order]

    def _alone(self, part: bytes) -> bytes:
        """Ids of one part. Besides the text a task keeps 8 bytes for each of its bytes, and the sums of one window."""
        v, n = self.v, len(part)
        text = np.frombuffer(part, np.uint8)
        piece, start = np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.int32)
        best, last, origin = [0.0], [-1], [0]  # from the window's first byte on
        for lo in range(0, n, _WINDOW):
            hi = min(lo + _WINDOW, n)
            starts, ends, values = self._matches(text, lo, hi)
            first = np.searchsorted(starts, np.arange(lo, hi + 1)).tolist()
            scores, stops, values = v.scores[values].tolist(), (ends - lo).tolist(), values.tolist()
            lead = text[lo:hi]
            widths = (1 + (lead >= 0xC0) + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)).tolist()
            room = max(hi - lo + 4, max(stops, default=0)) + 1 - len(best)
            best, last, origin = best + [-math.inf] * room, last + [-1] * room, origin + [0] * room
            for i, width in enumerate(widths):
                total = best[i]
                if total == -math.inf:
                    continue
                lone = True
                for k in range(first[i], first[i + 1]):
                    end = stops[k]
                    if end - i == width:
                        lone = False
                    if total + scores[k] > best[end]:
                        best[end], last[end], origin[end] = total + scores[k], values[k], lo + i
                if lone and total + v.unknown > best[i + width]:
                    best[i + width], last[i + width], origin[i + width] = total + v.unknown, -1, lo + i
            done = hi - lo
            piece[lo + 1:hi + 1], start[lo + 1:hi + 1] = last[1:done + 1], origin[1:done + 1]
            best, last, origin = best[done:], last[done:], origin[done:]
        return self._with_bytes(text, n, piece, start)

    @staticmethod
    def _offer(best, piece, start, rows, i, end, value, score) -> None:
        total = best[i, rows] + score
        better = total > best[end, rows]
        rows = rows[better]
        best[end, rows], piece[end, rows], start[end, rows] = total[better], value[better], i

    def _walk_back(self, text, ends, piece, start) -> list[bytes]:
        """Ids of each part, from its end to its start, one step at a time for all parts."""
        v, rows, end, steps = self.v, np.arange(len(ends)), ends.copy(), []
        while (active := end > 0).any():
            steps.append(np.where(active, piece[end, rows], -2))
            end = np.where(active, start[end, rows], 0)
        path = np.stack(steps[::-1], axis=1)
        there = path != -2
        ids = v.ids[path[there]].astype(np.uint16).tobytes()
        stops = np.cumsum(2 * there.sum(axis=1)).tolist()
        out = [ids[lo:hi] for lo, hi in zip([0, *stops], stops)]
        for row in np.flatnonzero((path == -1).any(axis=1)).tolist():
            out[row] = self._with_bytes(text[:, row], int(ends[row]), piece[:, row].tolist(), start[:, row].tolist())
        return out

    def _with_bytes(self, text, end: int, piece, start) -> bytes:
        """Ids of one part with characters that are no pieces."""
        own: list[int] = []
        while end > 0:
            lo = start[end]
            if piece[end] >= 0:
                own.append(int(self.v.ids[piece[end]]))
            else:
                own.extend(self.v.byte_ids[text[lo:end]][::-1].tolist())
            end = lo
        return np.array(own[::-1], np.uint16).tobytes()

    def encode(self, text: bytes) -> bytes:
        """Ids of a text as 16-bit numbers. Long texts are read a megabyte at a time, cut before a run of spaces."""
        if not text:
            return b""
        text, out, at = b" " + text, [], 0
        while at < len(text):
            cut = text.find(b" ", at + _GROUP_BYTES)
            while cut > 0 and text[cut - 1:cut] == b" ":
                cut = text.find(b" ", cut + 1)
            cut = len(text) if cut < 0 else cut
            out.append(self._encode_parts(_PART.findall(text[at:cut])))
            at = cut
        return b"".join(out)

    def prepare(self, texts: list[bytes]) -> None:
        """Segment the new parts of these texts together."""
        new = {p for t in texts if t for p in _PART.findall(b" " + t) if p not in self.known}
        if len(self.known) + len(new) > _CACHE_PARTS:
            self.known.clear()
            new = {p for t in texts if t for p in _PART.findall(b" " + t)}
        parts = list(new)
        self.known.update(zip(parts, self.segment(parts)))

    def _encode_parts(self, parts: list[bytes]) -> bytes:
        ids = list(map(self.known.get, parts))
        if None in ids:
            new = list({p for p in parts if p not in self.known})
            if len(self.known) + len(new) > _CACHE_PARTS:
                self.known.clear()
                new = list(set(parts))
            self.known.update(zip(new, self.segment(new)))
            ids = [self.known[p] for p in parts]
        return b"".join(ids)


def decode_ids(keys: list[bytes], ids: list[int]) -> str:
    """The text of ids; without the space that encoding put in front."""
    text = b"".join(map(keys.__getitem__, ids))
    return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


def _groups(batch: pa.RecordBatch, texts: list[bytes | None]) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of a batch with about _GROUP_BYTES of text."""
    lo = size = 0
    for k, text in enumerate(texts):
        size += len(text or b"")
        if size >= _GROUP_BYTES or k == len(texts) - 1:
            yield batch.slice(lo, k + 1 - lo), texts[lo:k + 1]
            lo, size = k + 1, 0


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with a column of token ids."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    at = docs.columns.index(text_col)
    out = docs.withColumn(ids_col, F.lit(None).cast("array<int>")).schema
    new_at = out.names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for part, texts in _groups(batch, batch.column(at).cast(pa.binary()).to_pylist()):
                if len(texts) > 1:
                    encoder.prepare([t for t in texts if t])
                ids = [None if t is None else encoder.encode(t) for t in texts]
                ends = np.cumsum([0] + [len(x or b"") // 2 for x in ids]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(x or b"" for x in ids), np.uint16).astype(np.int32))
                column = pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([x is None for x in ids], pa.bool_()))
                columns = [part.column(k) for k in range(part.num_columns)]
                columns[new_at:new_at + (len(out) == len(columns))] = [column]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return docs.mapInArrow(run, out)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with a column of the texts of its token ids."""
    spark = encoded.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(vocabulary.keys)
    at = encoded.columns.index(ids_col)
    out = encoded.withColumn(text_col, F.lit(None).cast("string")).schema
    new_at = out.names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column(at)
                texts = [None if x is None else decode_ids(keys, x) for x in lists.to_pylist()]
                columns = [part.column(k) for k in range(part.num_columns)]
                columns[new_at:new_at + (len(out) == len(columns))] = [pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return encoded.mapInArrow(run, out)
