"""Composition of DuckDB oracle statements from named common table expressions."""

from __future__ import annotations

import re

class Book:
    """Named CTEs; a statement pulls in exactly the ones it uses, in definition order."""

    def __init__(self):
        self.ctes: dict[str, str] = {}

    def cte(self, name: str, sql: str) -> None:
        self.ctes[name] = sql

    def _collect(self, sql: str, seen: set) -> None:
        for word in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", sql):
            if word in self.ctes and word not in seen:
                seen.add(word)
                self._collect(self.ctes[word], seen)

    def statement(self, select: str, doubles: str = "") -> str:
        """The full statement, with the named double columns at six places."""
        seen: set = set()
        self._collect(select, seen)
        used = [f"{n} AS MATERIALIZED (\n{self.ctes[n]}\n)" for n in self.ctes if n in seen]
        rep = ", ".join(f"floor(floor({c}::DOUBLE * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6 AS {c}" for c in doubles.split())
        body = f"SELECT *{f' REPLACE ({rep})' if rep else ''} FROM (\n{select}\n)"
        return ("WITH " + ",\n".join(used) + "\n" if used else "") + body


def values(rows) -> str:
    """SQL VALUES rows; floats become DOUBLE."""
    def lit(v):
        if isinstance(v, str):
            return "'" + v + "'"
        if isinstance(v, float):
            return f"{v!r}::DOUBLE"
        return str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"


# CRC32 (reflected polynomial) of an ASCII string, as list folds over bytes and bits.
def crc32(text: str) -> str:
    byte_step = ("list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], "
                 "lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))")
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), "
            f"lambda ch: ascii(ch)::BIGINT)), lambda acc, b: {byte_step}), 4294967295)")


PRIME = 2147483647


def seed(text: str, master: int) -> str:
    return f"(({crc32(text)} + {master}) % {PRIME})"


def draw(seed_sql: str, counter: str) -> str:
    x = f"((({seed_sql}) + ({counter})::BIGINT * 48271) % {PRIME})"
    sq = f"({x} * {x} % {PRIME})"
    return f"({sq} * {sq} % {PRIME} * {x} % {PRIME})"
