"""Benchmark decontamination: a generalised suffix automaton of the items, read by the documents' words.

Items and documents are normalised alike: ASCII letters to lower case; ASCII letters, digits and all non-ASCII
characters make words. The automaton holds every run of words of every item. A document's words are
streamed through it, and the state gives the longest run that ends at each word and is in an item. A word is hit if it lies
inside any occurrence of a window: ``size`` consecutive words of an item, or a whole item that has fewer.

The items are cut into automata of at most ``block_words`` words (an item never spans two), so that one has a bounded
size however large the benchmark is; each pass over the documents takes the automata of one group of that size.

A null or empty text has no words and isn't contaminated; items without words match nothing; items of equal text all count;
items with a null id are named "null"; rows of equal ids are judged on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import hashing as H
from barloom.llm.batches import by_bytes
from barloom.llm.cluster import ship

SIZE = 13
BLOCK_WORDS = 1 << 20
COVERAGE = 0.05


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(H.ALNUM_LOWER).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the items that hold each state's windows.

    ``read`` cuts the matching length at ``size``: a state then stands for runs of at most that length, and it
    belongs to items whose window ends there.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        self.size = size
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, set[int]] = {}
        short: dict[int, set[int]] = {}
        self.names = [name for name, _ in items]
        for k, (_, words) in enumerate(items):
            state = 0
            for n, word in enumerate(words):
                state = self._extend(state, self.number.setdefault(word, len(self.number)))
        # A second reading of the items marks the states of their windows: clones made later would not be seen by the first.
        for k, (_, words) in enumerate(items):
            state = matched = 0
            for n, word in enumerate(words):
                state, matched = self._step(state, matched, self.number[word])
                if matched >= size:
                    ends.setdefault(state, set()).add(k)
            if words and len(words) < size:
                short.setdefault(state, set()).add(k)
        self.windows = {s: tuple(sorted(x)) for s, x in ends.items()}
        self.short: dict[int, tuple[tuple[int, tuple[int, ...]], ...]] = {}
        if short:
            lengths = {s: len(items[min(x)][1]) for s, x in short.items()}
            for state in range(len(self.next)):
                found, at = [], state
                while at > 0:
                    if at in short:
                        found.append((lengths[at], tuple(sorted(short[at]))))
                    at = self.link[at]
                if found:
                    self.short[state] = tuple(found)

    def _extend(self, last: int, word: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            q = nxt[last][word]
            return q if length[q] == length[last] + 1 else self._clone(last, q, word)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p != -1:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, word)
        return new

    def _clone(self, p: int, q: int, word: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        """Longest match after one more word, cut to ``size`` and moved to the state of that length."""
        nxt, link, length = self.next, self.link, self.length
        while state and word not in nxt[state]:
            state = link[state]
            matched = length[state]
        state = nxt[state].get(word, 0)
        matched = matched + 1 if state else 0
        if matched >= self.size:
            matched = self.size
            while length[link[state]] >= self.size:
                state = link[state]
        return state, matched

    def read(self, words: list[bytes]) -> list[tuple[int, int, tuple[int, ...]]]:
        """(start, end, items) of the windows that occur in ``words``."""
        out = []
        nxt, link, length, size = self.next, self.link, self.length, self.size
        windows, short, number = self.windows, self.short, self.number
        state = matched = 0
        for end, word in enumerate(map(number.get, words), 1):
            if word is None:
                state = matched = 0
                continue
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            state = nxt[state].get(word, 0)
            if not state:
                matched = 0
                continue
            matched += 1
            if matched >= size:
                matched = size
                while length[link[state]] >= size:
                    state = link[state]
                if state in windows:
                    out.append((end - size, end, windows[state]))
            if short and state in short:
                out += [(end - n, end, items) for n, items in short[state] if n <= matched]
        return out


def _item_groups(items: DataFrame, id_col: str, text_col: str, block_words: int) -> list[list[tuple[str, bytes]]]:
    """The items in groups of about ``block_words`` words, read group by group in order of id."""
    named = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("name"),
                         F.col(f"`{text_col}`").cast("binary").alias("text"))
    size = named.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    groups = max(1, -(-size // (6 * block_words)))
    return [named.where(F.pmod(F.xxhash64("name"), F.lit(groups)) == k) for k in range(groups)]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", size: int = SIZE, coverage: float = COVERAGE,
                  block_words: int = BLOCK_WORDS, keep_columns: bool = False, span_words: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, item_ids (as strings, sorted), spans (hit word intervals),
    contaminated (n_hit > 0 and n_hit >= coverage * n_words) and clean_text (its words without the hit spans if
    contaminated, else the text itself). With span_words, clean_text also loses every hit span of at least so many words in documents
    that aren't contaminated; the flag is by coverage alone.

    With keep_columns: the rows of ``docs`` that aren't contaminated, as they are.
    """
    spark = docs.sparkSession
    ship(spark)
    share = Fraction(str(coverage))  # the number as written: 0.4 is two fifths
    automata = []
    for group in _item_groups(items, item_id, item_text, block_words):
        rows = [(r["name"], bytes(r["text"] or b"")) for r in group.collect()]  # at most about block_words words
        automata.append(spark.sparkContext.broadcast(rows))
    built: dict[int, Automaton] = {}

    def automaton(k: int) -> Automaton:
        if k not in built:
            if len(built) >= 4:
                built.clear()
            built[k] = Automaton([(name, words_of(text)) for name, text in automata[k].value], size)
        return built[k]

    def judge(texts: list[bytes | None]):
        words = [words_of(t) for t in texts]
        hits = [np.zeros(len(w) + 1, np.int32) for w in words]
        found: list[set[str]] = [set() for _ in words]
        for k in range(len(automata)):
            machine = automaton(k)
            for steps, names, w in zip(hits, found, words):
                for start, end, own in machine.read(w):
                    steps[start] += 1
                    steps[end] -= 1
                    names.update(machine.names[x] for x in own)
        masks = [np.cumsum(steps[:-1]) > 0 for steps in hits]
        return words, masks, found

    def long_runs(mask: np.ndarray) -> np.ndarray:
        """The hit spans of at least span_words words; none without that limit."""
        out = np.zeros(len(mask), bool)
        if span_words is not None and mask.any():
            for start, end in zip(*H.runs(mask)):
                out[start:end] = end - start >= span_words
        return out

    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    if keep_columns:
        names = docs.columns
        at = names.index(text_col)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in by_bytes(batches, at):
                _, masks, _ = judge(batch.column(at).cast(pa.binary()).to_pylist())
                yield batch.filter(pa.array([not (m.any() and int(m.sum()) >= share * len(m)) for m in masks], pa.bool_()))

        return docs.mapInArrow(keep, docs.schema)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            texts = batch["text"].cast(pa.binary()).to_pylist()
            words, masks, found = judge(texts)
            n_hit = [int(m.sum()) for m in masks]
            bad = [n > 0 and n >= share * len(w) for n, w in zip(n_hit, words)]
            cuts = [m if b else long_runs(m) for m, b in zip(masks, bad)]
            clean = [b" ".join(w[i] for i in np.flatnonzero(~c)) if b or c.any() else t
                     for t, w, c, b in zip(texts, words, cuts, bad)]
            spans = [[{"start": s, "end": e} for s, e in zip(*map(np.ndarray.tolist, H.runs(m)))] if n else []
                     for m, n in zip(masks, n_hit)]
            yield pa.RecordBatch.from_arrays([
                batch["id"], pa.array([len(w) for w in words], pa.int64()), pa.array(n_hit, pa.int64()),
                pa.array([sorted(f) for f in found], pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(bad, pa.bool_()), pa.array(clean, pa.binary()).cast(pa.string())], names=out.names)

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(span)), T.StructField("contaminated", T.BooleanType()),
        T.StructField("clean_text", T.StringType())])
    return docs.select(ident.alias("id"), text.alias("text")).mapInArrow(report, out)
