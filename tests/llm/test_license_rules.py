"""The rules as such: SPDX tags and written sentences, by a matcher that runs every rule, and what stands before the rules
(stems, gates, keywords) loses none of their matches."""

import random
import re
from re import _constants as C
from re import _parser

from barloom.llm import license_rules as R
from barloom.llm.license_scan import BASE, license_scan

TAGS = {
    "MIT": "mit", "ISC": "isc", "Zlib": "zlib", "BSL-1.0": "bsl-1.0", "EPL-2.0": "epl-2.0", "OFL-1.1": "ofl-1.1", "Artistic-2.0": "artistic-2.0",
    "PSF-2.0": "psf-2.0", "MS-PL": "ms-pl", "NCSA": "ncsa", "PostgreSQL": "postgresql", "MIT-0": "mit-0", "0BSD": "bsd-0-clause",
    "GPL-2.0-or-later": "gpl-2.0", "Apache-2.0 OR MIT": "apache-2.0,mit", "(MIT AND ISC) OR NCSA": "isc,mit,ncsa",
    "BSD-3-Clause-Clear": "bsd-3-clause-clear", "Python-2.0": "psf-2.0",
}

SENTENCES = {
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "bsd",
    "Neither the name of the Foo Corp. nor the names of its contributors may be used to endorse or promote products derived from "
    "this software": "bsd-3-clause",
    "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, "
    "or (at your option) any later version.": "gpl-3.0",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
    "that the above copyright notice and this permission notice appear in all copies.": "isc",
    "The origin of this software must not be misrepresented;": "zlib",
    "See <https://creativecommons.org/licenses/by-nc-sa/4.0/>": "cc-by-nc-sa-4.0",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
}


RULES = [(r, re.compile(r.pattern)) for r in R.rules()]


def form_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return " " + " ".join(words) + " " if words else " "


def ungated(text):
    """Labels and score by all rules, without stems, gates or keywords."""
    form = form_of(text)
    found = sorted((m.start(), -m.end(), r.rank, r.label, r.weight) for r, p in RULES for m in p.finditer(form))
    kept, most = [], -1
    for _, stop, _, label, weight in found:
        if -stop > most:
            kept.append((label, weight))
            most = -stop
    base = {label for p, label in BASE.items() if f" {p} " in form}
    return ",".join(sorted(base | {x for x, _ in kept})), max([w for _, w in kept] + [0.6] * bool(base) + [0.0])


def test_tags_and_sentences(spark):
    given = [f"// SPDX-License-Identifier: {t}\nint main;" for t in TAGS] + list(SENTENCES)
    got = {r[0]: r for r in license_scan(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")).collect()}
    for k, want in enumerate([*TAGS.values(), *SENTENCES.values()]):
        assert set(want.split(",")) <= set(got[k].labels.split(",")) and got[k].score >= 0.9, (given[k], got[k])
        assert (got[k].labels, got[k].score) == ungated(given[k])
    assert [got[k].labels for k in range(len(TAGS))] == list(TAGS.values())


def test_every_short_id():
    for ident in R.SPDX.split():
        name, _, label = ident.partition("=")
        labels, score = ungated(f"SPDX-License-Identifier: {name}")
        assert score == 1.0 and set(labels.split(",")) - {"cc-by"} == {label or name.lower()}, ident


def draw(tree, rng):
    """A random text of a pattern; what is looked for around it is left out."""
    out = ""
    for op, arg in tree:
        if op is C.LITERAL:
            out += chr(arg)
        elif op is C.NOT_LITERAL:
            out += "x"
        elif op is C.IN:
            kind, value = rng.choice(arg)
            out += chr(value) if kind is C.LITERAL else chr(rng.randint(*value)) if kind is C.RANGE else \
                {C.CATEGORY_DIGIT: "3", C.CATEGORY_WORD: "w"}.get(value, "x") if kind is C.CATEGORY else "x"
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            out += "".join(draw(inner, rng) for _ in range(rng.randint(low, min(high, low + 2))))
        elif op is C.SUBPATTERN:
            out += draw(arg[3], rng)
        elif op is C.BRANCH:
            out += draw(rng.choice(arg[1]), rng)
        else:
            assert op in (C.ASSERT, C.ASSERT_NOT), op
    return out


def draws(rule, rng, n):
    """Forms in which the rule matches, and the match with a space at both ends."""
    tree = _parser.parse(rule.pattern)
    for _ in range(n):
        head = "spdx " if "(?<= spdx )" in rule.pattern else "spdx license " if "(?<= spdx license )" in rule.pattern else ""
        form = f" {head}{draw(tree, rng)} "
        m = re.search(rule.pattern, form)
        assert m, (rule, form)
        yield form


def test_stems_gates_and_keywords_are_in_every_match():
    rng = random.Random(3)
    lost = {(r.label, r.keyword, form) for r, _ in RULES for form in draws(r, rng, 25)
            if r.keyword not in form or r.gate not in form or not any(s in form for s in R.STEMS)}
    assert not lost, sorted(lost)[:20]


def test_nothing_is_lost_before_the_rules(spark):
    rng = random.Random(4)
    given = ["Licensed under the ASL 2.0", "APL 2.0", "ASL2", "mpl2", "Apache version 2.0", "apache v2", "the Apache people"]
    given += [form for r, _ in rng.sample(RULES, 150) for form in draws(r, rng, 1)]
    got = {r[0]: (r.labels, r.score)
           for r in license_scan(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")).collect()}
    assert got == {k: ungated(t) for k, t in enumerate(given)}
    assert [got[k][0] for k in range(7)] == ["apache-2.0", "apache-2.0", "apache-2.0", "mpl-2.0", "apache-2.0", "apache-2.0", ""]
