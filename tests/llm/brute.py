"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import xxhash


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def roots(n: int, linked) -> list[int]:
    """The smallest index in reach, by comparing all pairs."""
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    found = [w.lower() for w in words(text)]
    if not found:
        return 0
    grams = [b" ".join(found[i : i + shingle]) for i in range(max(1, len(found) - shingle + 1))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def base_counts(text: str | None) -> tuple:
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    windows = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    covered = {i + k for i in range(len(found) - 7) if windows[tuple(found[i : i + 8])] > 1 for k in range(8)}
    n = len(found)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def without_windows(rows: list[tuple[int, str]]) -> dict[int, str]:
    """Texts by id without the lines that later three-line windows cover."""
    first: dict[tuple, tuple] = {}
    split = {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(" \t\n\r\x0b\x0c")]
        split[i] = lines, full
        for at in range(len(full) - 2):
            first.setdefault(tuple(lines[k].strip(" \t\n\r\x0b\x0c") for k in full[at : at + 3]), (i, at))
    out = {}
    for i, (lines, full) in split.items():
        drop: set[int] = set()
        for at in range(len(full) - 2):
            if first[tuple(lines[k].strip(" \t\n\r\x0b\x0c") for k in full[at : at + 3])] != (i, at):
                drop |= set(range(full[at], full[at + 2] + 1))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in drop)
    return out


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
