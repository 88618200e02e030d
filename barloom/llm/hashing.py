"""Vectorised rolling hashes over bytes and words; the small numeric helpers of the block operators.

All hashes are 64-bit polynomial (Rabin-Karp) hashes modulo 2**64 with an odd base, so a window's
hash comes from two prefix sums and one inverse power, followed by a mixing step.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E6C63D0876A9A99
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
_WORDS_A_SLICE = 1 << 17

#: Byte tables for ``bytes.translate``. Separators become a space; UTF-8 bytes over 0x7F are word bytes.
WHITESPACE = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
ALNUM_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = the polynomial of values[i:j], times base**i."""
    up, _ = _powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64, copy=False) * up[:len(values)], out=out[1:])
    return out


def gram_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Mixed hash of every run of ``size`` values; ``sums`` from prefix_sums."""
    n = len(sums) - size
    if n <= 0:
        return np.empty(0, np.uint64)
    _, down = _powers(n)
    return mix((sums[size:] - sums[:n]) * down[:n])


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hash of each values[start:end], their lengths included."""
    _, down = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(texts: list[bytes | None], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text."""
    hashes, counts, group, size = [], [], [], 0
    for k, text in enumerate(texts):
        group.append(text or b"")
        size += len(group[-1])
        if size >= 1 << 20 or k == len(texts) - 1:
            h, c = _word_hashes(group, table)
            hashes.append(h)
            counts.append(c)
            group, size = [], 0
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def _word_hashes(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    chars = np.frombuffer((b" " + b" ".join(texts) + b" ").translate(table), np.uint8)
    space = chars == 32
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, offsets + 1))
    out = np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), _WORDS_A_SLICE):
        s, e = starts[k:k + _WORDS_A_SLICE], ends[k:k + _WORDS_A_SLICE]
        base = s[0]
        sums = prefix_sums(chars[base:e[-1]].astype(np.uint64) + np.uint64(1))
        _, down = _powers(len(sums))
        out[k:k + len(s)] = mix((sums[e - base] - sums[s - base]) * down[s - base])
    return out, counts


def word_windows(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words inside one text, and the first word's index of each."""
    ends = np.repeat(np.cumsum(counts), counts)
    starts = np.flatnonzero(np.arange(size, len(hashes) + size) <= ends)
    return gram_hashes(prefix_sums(hashes), size)[starts], starts


def ranges_covered(starts: np.ndarray, size: int, length: int) -> np.ndarray:
    """Mask of the positions inside any [start, start + size); starts are distinct, no range passes length."""
    steps = np.zeros(length + 1, np.int8)
    steps[starts] += 1
    steps[starts + size] -= 1
    return np.cumsum(steps[:-1], dtype=np.int32) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edges = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and how often each occurs (by sorting, faster here than hashing)."""
    ranked = np.sort(keys)
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(keys) else np.empty(0, np.int64)
    return ranked[starts], np.diff(np.append(starts, len(keys)))


def groups_of(keys: np.ndarray, stable: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort order of keys, starts of the groups of equal keys in it, and their lengths."""
    order = np.argsort(keys, kind="stable" if stable else None)
    ranked = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(keys) else np.empty(0, np.int64)
    return order, starts, np.diff(np.append(starts, len(keys)))
