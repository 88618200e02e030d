"""Conversation repair against a plain shortest-path search, row by row."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from barloom.llm import queries
from barloom.llm.conversation_repair import damage, repair, repaired_digests

SPACE = " \t\n\x0b\x0c\r"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        role, text = (" " if x is None else x for x in (role, text))
        pick = zlib.crc32(":".join(shown).encode()) % 20
        if pick == 0:
            continue
        if pick == 1:
            text = ""
        if pick == 2:
            text = "".join(c for c in text if c not in ".!?")
        if pick == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if pick == 3 else 1)
    return out


def order(row):
    _, turn, role, text = row
    return (turn is not None, turn or 0, role, text[:32], hashlib.md5(text.encode()).digest())


def solve(rows):
    """All the numbers of one conversation; rows in order."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        body = text.strip(SPACE)
        faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    turns = [t for _, t, _, _ in rows if t is not None]
    initials = [r[:1] for _, _, r, _ in rows]
    step = {0: 2, 1: 2, 2: 3, 3: 2}
    n = len(rows)
    best = [[None] * 4 for _ in range(n + 1)]
    best[n][0], best[n][3] = (0, ""), (0, "")
    for i in range(n, -1, -1):
        if i < n:
            extra = 3 if faults[i] == 3 else 0
            for s in range(4):
                options = [(4, "D", s)]
                if faults[i] not in (1, 2):
                    options.append((3 + extra, "R", step[s]))
                    if initials[i] == "s" and s == 0:
                        options.append((extra, "K", 1))
                    if initials[i] == ("a" if s == 2 else "u"):
                        options.append((extra, "K", step[s]))
                ways = [(c + best[i + 1][t][0], e + best[i + 1][t][1]) for c, e, t in options if best[i + 1][t]]
                best[i][s] = min(ways, default=None)
        for _ in range(4):
            for s in range(4):
                to = best[i][step[s]]
                if to and (best[i][s] is None or (to[0] + 3, "I" + to[1]) < best[i][s]):
                    best[i][s] = (to[0] + 3, "I" + to[1])
    cost, audit = best[0][0]
    out, state, i = [], 0, 0
    for e in audit:
        new = "assistant" if state == 2 else "user"
        if e == "I":
            out.append(f"{new}:")
            state = step[state]
            continue
        _, _, role, text = rows[i]
        i += 1
        if e == "D":
            continue
        out.append(f"{role if e == 'K' else new}:{text}")
        state = 1 if e == "K" and role[:1] == "s" else step[state]
    assert i == n and state in (0, 3)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def brute(rows, original):
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {conv: solve(sorted(groups[conv], key=order)) if groups[conv] else nothing for conv in {r[0] for r in original}}


def as_dict(rows):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS[1:]) for r in rows}


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op13_conversation_repair"](spark, sf)
    assert got.columns == COLUMNS
    assert as_dict(got.collect()) == brute(damaged(rows), rows)


def random_rows(rng, n, conversations, turns):
    texts = ["Yes.", "No", " ", "", None, "Well!  \n", "What?", "the ", "x" * 40 + ".", "x" * 40 + "!"]
    return [(rng.choice(conversations), rng.choice(turns), rng.choice(["system", "user", "assistant", "tool", "", None, "s", "User"]),
             rng.choice(texts) if rng.random() < 0.4 else f"line {rng.randrange(10**6)}{rng.choice(['.', '', '!'])}") for _ in range(n)]


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_odd_rows(spark, partitions):
    """Nulls in every column, ties, repeated rows, one conversation over all tasks; any number of partitions gives the same."""
    rng = random.Random(7)
    rows = random_rows(rng, 500, list(range(60)) + [None], [None, *range(12)])
    rows += random_rows(rng, 400, [7], list(range(300)))
    rows += [(99, 1, "user", "again.")] * 50 + [(98, None, None, None)] * 3 + [(97, 5, "system", "Alone.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        extra = frame.selectExpr("conv_id", "turn", "role", "text", "1 AS _at", "2 AS audit", "3 AS _conv", "'z' AS _role")
        report, repaired = repair(damage(extra))
        shas = {r.conv_id: r.repaired_sha256 for r in repaired_digests(repaired).collect()}
        got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit,
                           shas.get(r.conv_id, hashlib.sha256(b"").hexdigest())) for r in report.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {k: v for k, v in brute(damaged(rows), rows).items() if v[6]}
    assert got == want


def test_string_ids_and_empty_tables(spark):
    rows = [("a", 1, "user", "Hi."), ("a", 2, "user", "So"), ("b", 4, "assistant", "Fine."), ("a", None, "system", "Be good.")]
    frame = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    report, repaired = repair(frame)
    want = {k: v for k, v in brute(rows, rows).items()}
    shas = {r.conv_id: r.repaired_sha256 for r in repaired_digests(repaired).collect()}
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, shas[r.conv_id])
            for r in report.collect()} == want
    none, no_rows = repair(frame.where("false"))
    assert none.count() == 0 and no_rows.count() == 0 and repaired_digests(no_rows).count() == 0


def test_repaired_rows_alternate(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    _, repaired = repair(damage(rows))
    talks = defaultdict(list)
    for r in repaired.collect():
        talks[r.conv_id].append((r.place, r.role[:1]))
    for turns in talks.values():
        roles = "".join(x for _, x in sorted(turns)).removeprefix("s")
        assert roles and roles == "ua" * (len(roles) // 2)
