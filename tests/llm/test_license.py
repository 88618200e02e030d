"""The scan against a plain matcher, and its rules."""

import re

from barloom.llm import license_rules as R
from barloom.llm.license_scan import BASE, license_scan

TEXTS = [
    "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.",
    "Licensed under CC BY-NC 4.0. All rights reserved.", "Licensed under the Apache License, Version 2.0.", None, "", "  ...  ",
    "no rules here", "SPDX-License-Identifier: GPL-2.0-only and gnu lesser general public license v2.1 or later",
    "MIT license mit LICENSE (mit-license) gnu general public license", "cc by cc by cc, by x cc byy", "copyright (c) 2019 2020 Foo",
    "Permission is hereby granted, free of charge, to any person obtaining a copy", "Kit licence: BSD 3-Clause licence; été GPLv3+",
    "the apache 2.0 and apache software licence 2.0, Creative Commons Attribution-ShareAlike 4.0 International", "mit license " * 300,
    "creative commons attribution noncommercial no derivatives 3.0 unported", "mozilla public license 2.0 ; mpl 1.1; eclipse public licence",
]


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for p, label in BASE.items() for k in range(len(words)) if words[k:k + len(p.split())] == p.split()]
    form = " " + " ".join(words) + " " if words else " "
    found = sorted(((m.start(), -m.end(), r.rank, r.label, r.weight) for r in R.rules() if r.keyword in form
                    for m in re.finditer(r.pattern, form)))
    kept, most = [], -1
    for start, stop, _, label, weight in found:
        if -stop > most:
            kept.append((label, weight))
            most = -stop
    at = [k for k, _ in places]
    base = {label for _, label in places}
    score = max([w for _, w in kept] + [0.6] * bool(places) + [0.0])
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {x for x, _ in kept})), score)


def test_scan_is_the_plain_matcher(spark, odd_docs, no_docs):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:8] for r in license_scan(df).collect()}
    assert got == {k: plain(t) for k, t in enumerate(TEXTS)}
    rows = license_scan(odd_docs).collect()
    assert sorted(repr((r[0], *tuple(r)[1:8])) for r in rows) == sorted(repr((d.doc_id, *plain(d.text))) for d in odd_docs.collect())
    assert license_scan(no_docs).count() == 0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    assert {r[0]: tuple(r)[1:8] for r in license_scan(docs).collect()} == want


def test_the_plan_has_no_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = license_scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_rules():
    rules = R.rules()
    assert len(rules) > 300 and [r.rank for r in rules] == list(range(len(rules)))
    # A rule's matches contain its keyword and a stem: probed with the forms that its family's name can take.
    for text in filter(None, TEXTS):
        form = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())) + " "
        for r in rules:
            for m in re.finditer(r.pattern, form):
                whole = form[m.start() - 1:m.end() + 1]
                assert any(s in whole for s in R.STEMS)
