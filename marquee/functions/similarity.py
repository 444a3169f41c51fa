"""String similarity of texts of any length in SQL functions, and for joins' many pairs in numpy.

A matched character of the second text is overwritten by ``TAKEN``, a code point that no text should hold (one that does is never
matched), so what is still free is read off the text itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.text import trim

# fixed values: the likeness from which things count as equal
THRESHOLDS = {"exact": 1.0, "high": 0.85, "medium": 0.7, "low": 0.5, "venue": 0.8, "title": 0.75, "location": 0.9}
TAKEN = "\uffff"
#: Characters of one side's texts, filled up to the longest, that are compared at once.
CELLS = 1 << 19
#: Masks of one ``Texts`` (8 bytes each), and pairs whose masks are compared at once.
MASKS, RUN = 1 << 22, 1 << 14


def _bound(then, **values: Column) -> Column:
    """``then`` of a struct of values, each worked out once."""
    return F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), then)[0]


def _char(x: Column, k: Column) -> Column:
    return F.substr(x, k, F.lit(1))


def _jaro(a: Column, b: Column) -> Column:
    """1 for equal texts, 0 if one is empty; half transpositions keep their fraction."""
    n, m = F.length(a), F.length(b)
    reach = F.greatest(F.floor(F.greatest(n, m) / 2).cast("int") - 1, F.lit(0))

    def step(state: Column, i: Column) -> Column:
        """Matches the i-th character (from 1) with the first free one within reach."""
        low = F.greatest(i - reach, F.lit(1))
        at = F.position(_char(a, i), F.substr(state["free"], low, i + reach + 1 - low))
        return _bound(lambda s: F.when(s["at"] > 0, F.struct(F.overlay(state["free"], F.lit(TAKEN), low + s["at"] - 1, F.lit(1)).alias("free"), F.concat(state["left"], _char(a, i)).alias("left"))).otherwise(state), at=at)

    def score(state: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), m), lambda k: _char(state["free"], k) == TAKEN)
        right = F.array_join(F.transform(places, lambda k: _char(b, k)), "")

        def of(s: Column) -> Column:
            found = F.length(s["left"])
            swaps = F.size(F.filter(F.sequence(F.lit(1), found), lambda k: _char(s["left"], k) != _char(s["right"], k))) / 2
            return F.when(found == 0, 0.0).otherwise((found / n + found / m + (found - swaps) / found) / 3)

        return _bound(of, left=state["left"], right=right)

    matched = F.aggregate(F.sequence(F.lit(1), n), F.struct(b.alias("free"), F.lit("").alias("left")), step, score)
    return F.when(a == b, 1.0).when((n == 0) | (m == 0), 0.0).otherwise(matched)


def _same_start(a: Column, b: Column) -> Column:
    """How many of the first four characters agree, from the first on."""
    same = lambda k: (_char(a, F.lit(k)) == _char(b, F.lit(k))) & (F.least(F.length(a), F.length(b)) >= k)
    return F.when(~same(1), 0).when(~same(2), 1).when(~same(3), 2).when(~same(4), 3).otherwise(4)


def jaro_winkler(a: Column, b: Column, scale: float = 0.1) -> Column:
    """Jaro with a bonus for a common start of up to 4, given from 0.7 on; null where one is null."""

    def bonus(s: Column) -> Column:
        return F.when(s["j"] < 0.7, s["j"]).otherwise(s["j"] + _same_start(s["a"], s["b"]) * F.lit(scale) * (1 - s["j"]))

    score = _bound(lambda s: _bound(bonus, a=s["a"], b=s["b"], j=_jaro(s["a"], s["b"])), a=a, b=b)
    return F.when(a.isNotNull() & b.isNotNull(), score)


def text_similarity(a: Column, b: Column) -> Column:
    """Jaro-Winkler without case or outer blanks: the shorter text is matched to the longer, and the bonus is always given; null where one is null."""
    x, y = trim(F.lower(a)), trim(F.lower(b))
    first = F.length(x) <= F.length(y)

    def bonus(s: Column) -> Column:
        return F.when(s["j"] == 0, 0.0).otherwise(s["j"] + 0.1 * _same_start(s["a"], s["b"]) * (1 - s["j"]))

    score = _bound(lambda s: _bound(bonus, a=s["a"], b=s["b"], j=_jaro(s["a"], s["b"])), a=F.when(first, x).otherwise(y), b=F.when(first, y).otherwise(x))
    return F.when(a.isNotNull() & b.isNotNull(), score)


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def _grid(texts: list[str], fill: int) -> np.ndarray:
    """Code points, a row a text, filled up to the longest."""
    size = np.array([len(t) for t in texts])
    grid = np.full((len(texts), size.max()), fill, np.int32)
    grid[np.arange(size.max()) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), np.int32)
    return grid


def _winklers(x: list[str], y: list[str], scale: float) -> np.ndarray:
    """Jaro-Winkler of pairs of different texts that aren't empty, all pairs a character at a time."""
    a, b = _grid(x, -1), _grid(y, -2)
    n, m = (a >= 0).sum(1), (b >= 0).sum(1)
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    far, at, pair = reach.max(), np.arange(b.shape[1]), np.arange(len(x))
    free, left = b >= 0, np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        near = slice(max(i - far, 0), i + far + 1)
        if near.start >= b.shape[1]:
            break
        fits = (b[:, near] == a[:, i, None]) & free[:, near] & (np.abs(at[near] - i) <= reach[:, None])
        first = fits.argmax(1)
        hit = np.flatnonzero(fits[pair, first])
        free[hit, first[hit] + near.start] = False
        left[hit, i] = True
    found = left.sum(1)
    taken = (b >= 0) & ~free
    swaps = np.bincount(np.repeat(pair, found)[a[left] != b[taken]], minlength=len(x)) / 2
    some = np.maximum(found, 1)
    jaro = np.where(found == 0, 0.0, (found / n + found / m + (found - swaps) / some) / 3)
    k = min(4, a.shape[1], b.shape[1])
    start = np.logical_and.accumulate(a[:, :k] == b[:, :k], axis=1).sum(1)
    return np.where(jaro < 0.7, jaro, jaro + start * scale * (1 - jaro))


#: For each reach and place of a character, the places of the other text that it may be matched with, as bits.
_NEAR = np.array([[sum(1 << p for p in range(max(k - reach, 0), min(k + reach, 63) + 1)) for k in range(64)] for reach in range(32)], np.uint64).ravel()


class Texts:
    """Likeness (``jaro_winkler``) of many pairs out of a list of texts, given by places in it; a null's likeness is 0.

    A text of up to 64 characters is a mask of places for each character of the list, so that a step of all pairs is a few operations on bits.
    What two texts begin with alike is matched with itself, so steps begin where the first pair differs. Longer texts go to ``_winklers``.
    """

    def __init__(self, texts: pa.Array):
        coded = texts.dictionary_encode()
        self.at = coded.indices.cast("int64").fill_null(-1).to_numpy(zero_copy_only=False)
        self.values = coded.dictionary.to_pylist()
        self.size = np.array([len(t) for t in self.values], np.int64)
        some = np.flatnonzero((self.size > 0) & (self.size <= 64))
        self.fits = np.zeros(len(self.values), bool)
        if not len(some):
            return
        grid = _grid([self.values[k] for k in some], -1)
        letters, codes = np.unique(grid, return_inverse=True)
        self.width = len(letters) + 1
        if len(self.values) * self.width > MASKS:
            return
        self.fits[some] = True
        codes = codes.reshape(grid.shape)
        codes[grid < 0] = len(letters)
        self.codes = np.full((grid.shape[1], len(self.values)), len(letters), np.int64)
        self.codes[:, some] = codes.T
        masks = np.zeros((len(self.values), self.width), np.uint64)
        for k in range(grid.shape[1]):
            full = some[grid[:, k] >= 0]
            masks[full, self.codes[k, full]] |= np.uint64(1 << k)
        self.masks = masks.ravel()

    def likeness(self, i: np.ndarray, j: np.ndarray, scale: float = 0.1) -> np.ndarray:
        x, y = self.at[i], self.at[j]
        out = ((x == y) & (x >= 0)).astype(float)
        todo = np.flatnonzero((x != y) & (x >= 0) & (y >= 0))
        if not len(todo):
            return out
        todo = todo[(self.size[x[todo]] > 0) & (self.size[y[todo]] > 0)]
        bits = self.fits[x[todo]] & self.fits[y[todo]]
        short, other = todo[bits], todo[~bits]
        for k in range(0, len(short), RUN):
            few = short[k : k + RUN]
            out[few] = self._by_bits(x[few], y[few], scale)
        while len(other):
            few = other[: max(CELLS // int(max(self.size[x[other]].max(), self.size[y[other]].max())), 1)]
            out[few] = _winklers([self.values[k] for k in x[few]], [self.values[k] for k in y[few]], scale)
            other = other[len(few) :]
        return out

    def _by_bits(self, x: np.ndarray, y: np.ndarray, scale: float) -> np.ndarray:
        n, m = self.size[x], self.size[y]
        shortest, longest = int(min(n.min(), m.min())), int(n.max())
        alike = 0
        while alike < shortest and (self.codes[alike].take(x) == self.codes[alike].take(y)).all():
            alike += 1
        begun = np.uint64((1 << alike) - 1)
        taken, left = np.full(len(x), begun), np.full(len(x), begun)
        base, near = y * self.width, np.maximum(np.maximum(n, m) // 2 - 1, 0) * 64
        places = [self.masks.take(base + self.codes[k].take(x)) for k in range(alike, longest)]
        for k, place in enumerate(places, alike):
            free = place & _NEAR.take(near + k) & ~taken
            first = free & (~free + np.uint64(1))
            taken |= first
            left |= (first != 0).astype(np.uint64) << np.uint64(k)
        found = np.bitwise_count(left).astype(np.int64)
        swaps, rest = np.zeros(len(x), np.int64), taken & ~begun
        for k, place in enumerate(places, alike):
            hit = (left >> np.uint64(k)) & np.uint64(1)
            first = rest & (~rest + np.uint64(1))
            swaps += (hit != 0) & (place & first == 0)
            rest ^= first & (~hit + np.uint64(1))
        swaps = swaps / 2
        jaro = np.where(found == 0, 0.0, (found / n + found / m + (found - swaps) / np.maximum(found, 1)) / 3)
        start, same = np.zeros(len(x), np.int64), np.ones(len(x), bool)
        for k in range(min(4, len(self.codes))):
            one = self.codes[k].take(x)
            same &= (one == self.codes[k].take(y)) & (one != self.width - 1)
            start += same
        return np.where(jaro < 0.7, jaro, jaro + start * scale * (1 - jaro))


def pair_likeness(a: Column, b: Column, scale: float = 0.1) -> Column:
    """``jaro_winkler`` for many pairs, in an Arrow UDF; equal texts don't go there. It is the same for (b, a)."""

    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        x, y = x.to_pylist(), y.to_pylist()
        out = np.full(len(x), np.nan)
        out[[i for i, p in enumerate(x) if p is not None and y[i] is not None]] = 0.0
        full = [i for i, p in enumerate(x) if p and y[i]]
        longest = {i: max(len(x[i]), len(y[i])) for i in full}
        full.sort(key=longest.get)
        while full:  # the longest pairs first, as many as fit
            few = full[-max(CELLS // longest[full[-1]], 1) :]
            out[few] = _winklers([x[i] for i in few], [y[i] for i in few], scale)
            del full[-len(few) :]
        return pa.array(out, mask=np.isnan(out))

    differ = lambda c: F.when(a != b, c)
    return F.when(a == b, 1.0).otherwise(run(differ(a), differ(b)))
