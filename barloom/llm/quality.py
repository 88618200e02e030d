"""Quality classifier: a generalised additive model with pairwise interactions over features of the text.

Each feature is cut into bins at quantiles and has a lookup table with an addend for each bin; chosen pairs of features have a table over
coarser bins of both. The tables are learned by cyclic boosting: in turn, each feature gets a shallow tree (up to three leaves) on the
gradients of the log loss, added to its table at a small rate; then the pairs with the greatest gain on what is left get trees of one cut on
each axis in the same way. A score is the logistic function of the intercept and the addends of a text's bins.

The model is fitted on about ``sample_rows`` labelled rows chosen by a hash of the id, never on rows whose crc32(id as text) mod 3 is 1, so
its cost is fixed; scoring reads every whole text. Labels, ids, languages and sources are no features.

Null and empty texts have the features of no words (all 0). Labels other than 0 and 1, and null ones, aren't learned from. Without a label to learn
from all scores are 0.5, with labels of one kind all are its smoothed share. Repeated ids are rows of their own, in scoring and learning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import hashing as H
from barloom.llm.batches import by_bytes
from barloom.llm.cluster import ship
from barloom.llm.language_id import held_out

SAMPLE_ROWS = 20_000
BINS, PAIR_BINS = 48, 12
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 8
RATE, RIDGE, LEAF = 0.1, 1.0, 5

#: Over bytes (n), words between white space (w), lines (at line feeds) and runs of WINDOW words.
FEATURES = ("log_bytes", "log_words", "word_bytes", "letters", "digits", "symbols", "capitals", "line_feeds", "stops", "commas", "brackets",
            "distinct_words", "commonest_word", "repeated_runs", "repeated_lines", "symbol_ends", "log_longest", "short_words", "capital_words",
            "symbol_pairs")
WINDOW = 5

_UPPER, _LETTER, _DIGIT, _SYMBOL, _SPACE, _FEED, _STOP, _COMMA, _BRACKET = (1 << k for k in range(9))


def _classes() -> np.ndarray:
    out = np.zeros(256, np.int32)
    for b in range(256):
        c = chr(b) if b < 128 else "é"
        space = b == 32 or 9 <= b <= 13
        out[b] = (_UPPER * ("A" <= c <= "Z") | _LETTER * (c.isalpha()) | _DIGIT * ("0" <= c <= "9")
                  | _SYMBOL * (33 <= b < 127 and not c.isalnum()) | _SPACE * space | _FEED * (b == 10)
                  | _STOP * (c in ".!?") | _COMMA * (c in ",;:") | _BRACKET * (c in "|{}<>[]\\/_="))
    return out


_CLASS = _classes()
_COUNTED = np.array([(_CLASS & bit) > 0 for bit in (_LETTER, _DIGIT, _SYMBOL, _UPPER, _FEED, _STOP, _COMMA, _BRACKET, _SPACE)], np.float64).T
_ASCII_LETTER = ((_CLASS & _LETTER) > 0) & (np.arange(256) < 128)
_LINES = bytes(32 if b == 10 else 1 if b == 32 or 9 <= b <= 13 else b for b in range(256))


def _repeats(hashes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, and how often its commonest one occurs; 44 bits of a hash tell the values of a text apart."""
    keys, counts = H.distinct(hashes >> np.uint64(20) << np.uint64(20) | owner.astype(np.uint64))
    of = (keys & np.uint64((1 << 20) - 1)).astype(np.int64)
    most = np.zeros(texts, np.int64)
    np.maximum.at(most, of, counts)
    return np.bincount(of, minlength=texts), most


def features(texts: list[bytes | None]) -> np.ndarray:
    """One row of FEATURES for each text; at most 2**20 texts."""
    texts = [t or b"" for t in texts]
    m = len(texts)
    chars = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    counts = np.array([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts], np.float64).reshape(m, 256)
    letters, digits, symbols, upper, feeds, stops, commas, brackets, blanks = (counts @ _COUNTED).T
    n = counts.sum(axis=1)
    kind = _CLASS[chars]
    space = (kind & _SPACE) > 0
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    lengths = ends - starts
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    owner = np.searchsorted(offsets, starts, "right") - 1
    per_text = lambda mask: np.bincount(owner[mask], minlength=m)
    words = np.bincount(owner, minlength=m)
    hashes, word_counts = H.word_hashes(texts, H.WHITESPACE)
    distinct, most = _repeats(hashes, np.repeat(np.arange(m), word_counts), m)
    runs, at = H.word_windows(hashes, word_counts, WINDOW)
    run_owner = np.searchsorted(np.cumsum(word_counts), at, "right")
    run_counts = np.bincount(run_owner, minlength=m)
    distinct_runs, _ = _repeats(runs, run_owner, m)
    line_hashes, lines = H.word_hashes([t.translate(_LINES) for t in texts], bytes(range(256)))
    distinct_lines, _ = _repeats(line_hashes, np.repeat(np.arange(m), lines), m)
    longest = np.zeros(m)
    np.maximum.at(longest, owner, lengths)
    symbol = (kind & _SYMBOL) > 0
    capital = (kind & _UPPER) > 0
    pair = np.flatnonzero(symbol[1:] & (chars[1:] == chars[:-1])) + 1
    pairs = np.bincount(np.searchsorted(offsets, pair, "right") - 1, minlength=m)
    ratio = lambda a, b: a / np.maximum(b, 1)
    return np.column_stack([
        np.log1p(n), np.log1p(words), ratio(n - blanks, words), ratio(letters, n), ratio(digits, n), ratio(symbols, n),
        ratio(upper, counts[:, _ASCII_LETTER].sum(axis=1)), ratio(feeds, words), ratio(stops, words), ratio(commas, words), ratio(brackets, n),
        ratio(distinct, words), ratio(most, words), ratio(run_counts - distinct_runs, run_counts), ratio(lines - distinct_lines, lines),
        ratio(per_text((lengths > 1) & symbol[ends - 1] & symbol[ends - 2]), words), np.log1p(longest), ratio(per_text(lengths <= 3), words),
        ratio(per_text((lengths > 1) & capital[starts] & capital[np.minimum(starts + 1, len(chars) - 1)]), words), ratio(pairs, n)])


# ---- boosting

def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins; no gain if a side had fewer than LEAF rows."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = gl ** 2 / (hl + RIDGE) + (g.sum() - gl) ** 2 / (h.sum() - hl + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain = np.where((nl >= LEAF) & (n.sum() - nl >= LEAF), gain, 0)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Addends of a tree of up to three leaves over the bins."""
    edges = [0, len(g)]
    for _ in range(2):
        cuts = [(*_best_cut(g[a:b], h[a:b], n[a:b]), a) for a, b in zip(edges, edges[1:])]
        gain, k, a = max(cuts, key=lambda c: c[0])
        if gain <= 0:
            break
        edges = sorted([*edges, a + k])
    return np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + RIDGE)) for a, b in zip(edges, edges[1:])])


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and addends of the best tree with one cut on each axis of a grid."""
    def quadrants(x):
        low = x.cumsum(axis=0).cumsum(axis=1)
        a, b, ab, whole = low[:-1, -1:], low[-1:, :-1], low[:-1, :-1], low[-1, -1]
        return np.stack([ab, a - ab, b - ab, whole - a - b + ab])

    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    gq, hq, nq = quadrants(g), quadrants(h), quadrants(n)
    value = gq / (hq + RIDGE)
    gain = np.where((nq >= LEAF).all(axis=0), (gq * value).sum(axis=0) - g.sum() ** 2 / (h.sum() + RIDGE), 0)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = value[:, i, j]
    return float(gain[i, j]), out if gain[i, j] > 0 else np.zeros_like(g)


@dataclass
class Model:
    """Cuts and tables of the features, coarser cuts and tables of the pairs."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, k], "right")]
        if self.pairs:
            coarse = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.pair_cuts)]
            for (i, j), table in zip(self.pairs, self.pair_tables):
                total += table[coarse[i], coarse[j]]
        return _logistic(total)


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Distinct inner quantiles; a value on a cut belongs to the bin above it."""
    if not len(x):
        return np.empty(0)
    ranked = np.sort(x)
    cuts = np.unique(ranked[np.arange(1, bins) * len(x) // bins])
    return cuts[cuts > ranked[0]]


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> Model:
    """The model of rows of features and labels (0, 1); ties go to the earlier feature or pair."""
    k = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))), [_cuts(x[:, f], BINS) for f in range(k)], [], [_cuts(x[:, f], PAIR_BINS) for f in range(k)], [], [])
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if not 0 < y.sum() < len(y):
        return model
    bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.cuts)]
    sizes = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables)]
    total = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for b, table, n in zip(bins, model.tables, sizes):
            p = _logistic(total)
            step = RATE * _tree(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)), n)
            table += step
            total += step[b]
    coarse = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.pair_cuts)]
    wide = [len(c) + 1 for c in model.pair_cuts]

    def grid(i: int, j: int, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(coarse[i] * wide[j] + coarse[j], weights, wide[i] * wide[j]).reshape(wide[i], wide[j])

    p = _logistic(total)
    gains = [(-_pair_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)), grid(i, j))[0], i, j) for i in range(k) for j in range(i + 1, k)]
    model.pairs = [(i, j) for gain, i, j in sorted(gains)[:pairs] if gain < 0]
    model.pair_tables = [np.zeros((wide[i], wide[j])) for i, j in model.pairs]
    counts = [grid(i, j) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table, n in zip(model.pairs, model.pair_tables, counts):
            p = _logistic(total)
            step = RATE * _pair_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)), n)[1]
            table += step
            total += step[coarse[i], coarse[j]]
    return model


# ---- Spark

def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of a sample of about ``sample_rows`` labelled rows; their features are made in tasks, the tables on the driver."""
    ship(docs.sparkSession)
    ident = F.col(f"`{id_col}`")
    known = labels.select(ident.alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    n = known.count()
    span = 1 << 30
    chosen = known.where(F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(span)) < min(span, span * sample_rows // max(1, n)))
    # About sample_rows rows, whatever the tables' sizes.
    rows = docs.select(ident.alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text")).join(F.broadcast(chosen), "id").select("text", "y")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            x = features(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["y"], pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.mapInArrow(measure, "y int, x array<double>").toArrow()
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = got["y"].to_numpy().astype(np.float64)
    order = np.lexsort([y, *x.T])  # the sums of floats don't depend on the order that tasks end in
    return boost(x[order], y[order])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ident = F.col(f"`{id_col}`")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            scores = shared.value.score(features(batch["text"].to_pylist()))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["held_out"], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                                             names=["id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(ident.alias("id"), held_out(ident).alias("held_out"), F.col(f"`{text_col}`").cast("binary").alias("text")) \
        .mapInArrow(rate, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
