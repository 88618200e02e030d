"""License scan: ordered signature rules behind a keyword prefilter, resolved by containment. Built-in functions only.

A text becomes its words (lower case; ASCII letters, digits and all non-ASCII characters) joined by single spaces. Rules
whose gate and keyword are in it are matched (a gate is looked for once for all its rules); all their matches are detections (rank, label, start, end in characters of that form).
Sorted by start, then longest, then rank, a detection is suppressed if an earlier one contains it; of equal intervals
the one of the first rule stays.

The base phrases are counted apart: their labels are always reported. A null or empty text has no words, no labels, null
positions and score 0. The score is the greatest weight of the detections that stay, at least BASE_WEIGHT with a base phrase.
Each text is handled in its own row: no exchange, and repeated rows are repeated results.
"""

from __future__ import annotations

import json
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.license_rules import STEMS, rules

#: Phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
BASE_WEIGHT = 0.6

_RULES = "array<struct<gate:string,rules:array<struct<rank:int,label:string,keyword:string,pattern:string,weight:double>>>>"
_FOUND = "array<struct<start:int,stop:int,rank:int,label:string,weight:double>>"


def canonical(docs: DataFrame, text: Column, *others: Column) -> DataFrame:
    """``others`` and _form: the words with a space before, between and after; one space if there are none.

    In two steps, so that the words, which both branches of the second use, are made once.
    """
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    made = docs.select(*others, words.alias("_words"))
    form = F.when(F.col("_words") == "", " ").otherwise(F.concat(F.lit(" "), "_words", F.lit(" ")))
    return made.withColumn("_form", form).drop("_words")


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _matches(form: Column, rule: Column) -> Column:
    """All matches of one rule: what lies between the matches gives their places."""
    hits = F.regexp_extract_all(form, rule["pattern"], F.lit(0))
    gaps = F.split(form, rule["pattern"], F.lit(-1))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        stop = start + F.length(pair["hit"])
        one = F.struct(start.alias("start"), stop.alias("stop"), rule["rank"].alias("rank"), rule["label"].alias("label"),
                       rule["weight"].alias("weight"))
        return F.struct(stop.alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    first = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("found"))
    return F.when(F.size(hits) > 0, F.aggregate(pairs, first, step)["found"]).otherwise(F.array().cast(_FOUND))


def _unsuppressed(found: Column) -> Column:
    """Detections that no detection before them contains."""
    order = F.array_sort(found, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"])
                         .when(x["stop"] != y["stop"], y["stop"] - x["stop"]).otherwise(x["rank"] - y["rank"]))

    def step(acc: Column, d: Column) -> Column:
        return F.when(d["stop"] <= acc["stop"], acc).otherwise(
            F.struct(d["stop"].alias("stop"), F.concat(acc["kept"], F.array(d)).alias("kept")))

    return F.aggregate(order, F.struct(F.lit(-1).alias("stop"), F.array().cast(_FOUND).alias("kept")), step)["kept"]


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    gates = groupby(sorted(rules(), key=lambda r: r.gate), key=lambda r: r.gate)
    table = F.from_json(F.lit(json.dumps([{"gate": g, "rules": [r._asdict() for r in own]} for g, own in gates])), _RULES)
    form = F.col("_form")
    given = canonical(docs, F.col(f"`{text_col}`"), F.col(f"`{id_col}`").alias("_id"))
    touched = F.lit(False)
    for stem in STEMS:
        touched = touched | F.contains(form, F.lit(stem))
    sized = given.select("_id", F.when(touched, form).otherwise(F.lit(" ")).alias("_form"),
                         F.when(form == " ", 0).otherwise(_spaces(form) - 1).cast("long").alias("n_words"))

    counts = [F.regexp_count(form, F.lit(f" {p}(?= )")) for p in BASE]
    firsts = [F.when(F.contains(form, F.lit(f" {p} ")), _spaces(F.substring_index(form, f" {p} ", 1))) for p in BASE]
    lasts = [F.when(F.contains(form, F.lit(f" {p} ")), _spaces(form) - 1 - F.lit(p.count(" ") + 1) -
                    _spaces(F.substring_index(form, f" {p} ", -1))) for p in BASE]
    opened = F.flatten(F.transform(F.filter(table, lambda g: F.contains(form, g["gate"])), lambda g: g["rules"]))
    gated = F.filter(opened, lambda r: F.contains(form, r["keyword"]))
    found = F.flatten(F.transform(gated, lambda r: _matches(form, r)))
    scanned = sized.select(
        "_id", "n_words",
        F.when(form == " ", F.lit(0)).otherwise(sum(counts[1:], counts[0])).cast("long").alias("n_base"),
        F.when(form != " ", F.least(*firsts)).cast("long").alias("first_word"),
        F.when(form != " ", F.greatest(*lasts)).cast("long").alias("last_word"),
        F.when(form == " ", F.array().cast("array<string>")).otherwise(
            F.filter(F.array(*[F.when(F.contains(form, F.lit(f" {p} ")), label) for p, label in BASE.items()]),
                     lambda x: x.isNotNull())).alias("_base"),
        F.when(form == " ", F.array().cast(_FOUND)).otherwise(_unsuppressed(found)).alias("detections"))
    own = F.transform("detections", lambda d: d["label"])
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0))
    return scanned.select(
        F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", own)), ",").alias("labels"),
        F.greatest(best, F.when(F.col("n_base") > 0, BASE_WEIGHT).otherwise(0.0)).alias("score"), "detections")
