"""Language ID by words first: log frequencies of known words per language, backing off to shorter character n-grams.

Words are maximal runs of letters, in lower case. A known word adds its log frequency in each language; an unseen word adds
the mean log frequency of its n-grams (with word ends) for the greatest n of MAX_N .. 1 at which it has a known one.
The language of the greatest sum wins; the score is its share of the softmax of the sums.

Only rows with a language and a crc32(id as text) mod 3 other than 1 are learned from; the language, source and id of a row are never used to
predict it. The model is fitted on about ``sample_rows`` rows of each language, chosen by a hash of the id, and keeps the ``words``
most frequent words and ``grams`` most frequent n-grams of the sample, so its size is fixed by parameters.

A null text and a text without a letter is "und" with score 0, as is everything if nothing was learned. Null ids count as empty text in the
hash. Ties between languages go to the first in order of name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.batches import by_bytes
from barloom.llm.cluster import cut, ship, small_batches

SAMPLE_ROWS = 2000
WORDS = 200_000
GRAMS = 80_000
MAX_N = 5
MIN_SCORE = 0.0
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 100_000


def held_out(ident: Column) -> Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit(""))) % 3 == 1


def words_of(text: str | None) -> list[str]:
    """Words in lower case; none if no character is a letter (numerals such as fractions are in \\w too)."""
    words = _WORD.findall((text or "").lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def grams_of(word: str, n: int) -> list[str]:
    ends = f"<{word}>"
    return [ends[i:i + n] for i in range(len(ends) - n + 1)]


class Model:
    """Log frequencies of words and n-grams: one row for each, one column for each language."""

    def __init__(self, languages: list[str], words: dict[str, int], grams: list[dict[str, int]], logs: np.ndarray):
        self.languages, self.words, self.grams, self.logs = languages, words, grams, logs

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """A model in one task, with the rows of unseen words it has met; that cache is emptied when full."""

    def __init__(self, model: Model):
        self.model = model
        self.known = model.words  # the cache is kept in the one dictionary of this worker, apart by its row numbers
        self.fixed = len(model.logs)
        self.rows = np.zeros((self.fixed + _CACHE_WORDS, len(model.languages)), np.float32)
        self.rows[:self.fixed] = model.logs
        self.forget()

    def forget(self) -> None:
        for word in [w for w, k in self.known.items() if k >= self.fixed]:
            del self.known[word]
        self.used = self.fixed

    def _unseen(self, word: str) -> int:
        found: list[int] = []
        for n in range(MAX_N, 0, -1):
            table = self.model.grams[n]
            found = [table[g] for g in grams_of(word, n) if g in table]
            if found:
                break
        self.rows[self.used] = self.model.logs[found].mean(axis=0) if found else 0
        self.known[word] = self.used
        self.used += 1
        return self.used - 1

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        languages, scores = [], []
        for text in texts:
            words = words_of(text)
            if not words or not self.model.languages:
                languages.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = np.zeros(len(self.model.languages))
            for k in range(0, len(words), _CACHE_WORDS):
                part = words[k:k + _CACHE_WORDS]
                if self.used + len(part) > len(self.rows):
                    self.forget()
                rows = list(map(self.known.get, part))
                if None in rows:
                    rows = [self.known[w] if w in self.known else self._unseen(w) for w in part]
                total += self.rows[rows].sum(axis=0, dtype=np.float64)
            best = int(total.argmax())
            languages.append(self.model.languages[best])
            scores.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
        return languages, scores


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_rows: int = SAMPLE_ROWS, words: int = WORDS, grams: int = GRAMS) -> Model:
    """Counts are made in the tasks and summed in Spark; the most frequent entries come to the driver."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    lang, ident = F.col(f"`{lang_col}`"), F.col(f"`{id_col}`")
    learn = docs.where(lang.isNotNull() & ~held_out(ident))
    per_lang = {r[0]: r[1] for r in learn.groupBy(lang).count().collect()}
    if not per_lang:
        return Model([], {}, [{} for _ in range(MAX_N + 1)], np.zeros((0, 0), np.float32))
    span = 1 << 30
    share = F.create_map(*[F.lit(x) for k, n in per_lang.items() for x in (k, min(span, round(span * sample_rows / n)))])
    sample = learn.where(F.pmod(F.xxhash64(F.coalesce(ident.cast("string"), F.lit(""))), F.lit(span)) < share[lang]) \
        .select(lang.alias("lang"), F.col(f"`{text_col}`").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counts: Counter) -> pa.RecordBatch:
            langs, sizes, texts = zip(*counts) if counts else ((), (), ())
            return pa.RecordBatch.from_arrays([
                pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(texts, pa.string()),
                pa.array(list(counts.values()), pa.int64())], names=["lang", "n", "gram", "times"])

        counts: Counter = Counter()
        for batch in by_bytes(batches, "text"):
            seen: dict[str, Counter] = {}
            for own, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                seen.setdefault(own, Counter()).update(words_of(text))
            for own, words_ in seen.items():
                for word, times in words_.items():
                    counts[own, 0, word] += times
                    for n in range(1, MAX_N + 1):
                        for gram in grams_of(word, n):
                            counts[own, n, gram] += times
            if len(counts) > 150_000:
                yield rows(counts)
                counts = Counter()
        yield rows(counts)

    totals = sample.mapInArrow(count, "lang string, n int, gram string, times long") \
        .groupBy("n", "gram", "lang").agg(F.sum("times").alias("times"))
    table = cut(totals.groupBy("n", "gram").agg(
        F.sum("times").alias("times"), F.map_from_entries(F.collect_list(F.struct("lang", "times"))).alias("by_lang")))
    languages = sorted(per_lang)
    by_lang = F.array(*[F.coalesce(F.col("by_lang")[k], F.lit(0)) for k in languages])
    top = pa.concat_tables([
        table.where(kind).orderBy(F.desc("times"), "n", "gram").limit(limit).select("n", "gram", by_lang.alias("counts")).toArrow()
        for kind, limit in ((F.col("n") == 0, words), (F.col("n") > 0, grams))]).combine_chunks()
    counts = top["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(languages))
    sizes = top["n"].to_numpy()
    logs = np.zeros(counts.shape, np.float32)
    for n in range(MAX_N + 1):
        own = sizes == n
        logs[own] = np.log((counts[own] + 0.5) / (counts[own].sum(axis=0) + 0.5 * max(1, own.sum())))
    places: list[dict[str, int]] = [{} for _ in range(MAX_N + 1)]
    for k, (n, gram) in enumerate(zip(sizes.tolist(), top["gram"].to_pylist())):
        places[n][gram] = k
    return Model(languages, places[0], places, logs)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    ident = F.col(f"`{id_col}`")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = shared.value.reader()
        for batch in by_bytes(batches, "text"):
            languages, scores = reader.predict(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["held_out"], pa.array(languages, pa.string()),
                                              pa.array(scores, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    kind = dict(docs.select(ident.alias("id")).dtypes)["id"]
    return docs.select(ident.alias("id"), held_out(ident).alias("held_out"), F.col(f"`{text_col}`").alias("text")) \
        .mapInArrow(predict, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` that have a letter and whose language has at least the score ``min_score``, as they are.

    A model without languages (nothing to learn from) can't tell any language apart: all rows with a letter stay.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = shared.value.reader()
        for batch in by_bytes(batches, at):
            texts = batch.column(at).to_pylist()
            if not reader.model.languages:
                yield batch.filter(pa.array([bool(words_of(t)) for t in texts], pa.bool_()))
                continue
            languages, scores = reader.predict(texts)
            yield batch.filter(pa.array([x != UNKNOWN and s >= min_score for x, s in zip(languages, scores)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
