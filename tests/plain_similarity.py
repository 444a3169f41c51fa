"""Jaro-Winkler on two Python strings, which the library's SQL versions are held against."""

from __future__ import annotations


def jaro(a: str, b: str) -> float:
    """1 for equal texts, 0 if one is empty; half transpositions keep their fraction."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, left = [True] * len(b), []
    for i, c in enumerate(a):
        at = b.find(c, max(0, i - reach), i + reach + 1)
        while at >= 0 and not free[at]:
            at = b.find(c, at + 1, i + reach + 1)
        if at >= 0:
            free[at] = False
            left.append(c)
    if not left:
        return 0.0
    right = [c for c, f in zip(b, free, strict=True) if not f]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def winkler(a: str, b: str, scale: float = 0.1) -> float:
    """Jaro with a bonus for a common prefix of up to 4, given from 0.7 on."""
    j = jaro(a, b)
    if j < 0.7:
        return j
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return j + same * scale * (1 - j)


def folded(a: str, b: str) -> float:
    """Jaro-Winkler without case or outer blanks: the shorter text is matched to the longer, and the prefix bonus is always given."""
    x, y = sorted((a.lower().strip(), b.lower().strip()), key=len)
    if x == y:
        return 1.0
    if not x:
        return 0.0
    j = jaro(x, y)
    same = next((k for k, (p, q) in enumerate(zip(x[:4], y[:4], strict=False)) if p != q), min(len(x), 4))
    return j + 0.1 * same * (1 - j) if j else 0.0
