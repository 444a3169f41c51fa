"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document. Expectation
maximisation over the votes of all documents estimates each labeller's accuracy (how
it votes on good and on bad documents) and so, for each pattern of votes, the
probability that a document is good. These posterior labels train a linear scorer over
hashed words, word shapes and shape pairs, and the scorer judges every document.

The EM needs only the number of documents of each vote pattern: at most 3 to the number
of labellers, whatever the input. The scorer is fitted on ``TRAIN_ROWS`` documents at
most, half of each side where there are enough, taken by a hash of id and text; its
weights are 2 to the ``BITS`` numbers. Scoring is one pass without a shuffle; memory is
one batch of texts.

Defined cases: a null or empty text has no words, every labeller is silent on it, its
score is 0 and it is not kept; texts of any length are read whole; repeated rows get the
same result; an empty table gives an empty result; without any document on one side, the
posterior itself is the score; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.plans.staging import staged

BITS = 16
TRAIN_ROWS = 4_000
GOOD, BAD, SILENT = 1, 0, 2
_MEMO = 300_000
_SYMBOLS = frozenset("#*$%&|<>@~^=_\\{}[]")


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else SILENT


def labels(text: str, words: list[str]) -> list[int]:
    """The labellers' votes on one text."""
    n = len(words)
    if not n:
        return [SILENT] * len(LABELLERS)
    chars = Counter(text)
    symbols = sum(c for x, c in chars.items() if x in _SYMBOLS)
    upper, letters = sum(c for x, c in chars.items() if x.isupper()), sum(c for x, c in chars.items() if x.isalpha())
    stops = chars["."] + chars["?"] + chars["!"] + chars["。"]
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = sum(c for c in triples.values() if c > 1) / max(1, n - 2)
    lines = [x for x in text.split("\n") if x.strip()]
    short = sum(len(w) == 1 and not w.isalnum() for w in words) / n
    return [
        _vote(symbols > 0.15 * n, symbols <= 0.02 * n),
        _vote(chars["|"] > 0.15 * n, False),
        _vote(again > 0.1, n >= 20 and again < 0.02),
        _vote(n >= 20 and stops < 0.005 * n or chars["!"] > 0.4 * n, 0.02 * n <= stops <= 0.4 * n),
        _vote(upper > 0.35 * max(letters, 1), letters > 0 and upper < 0.12 * letters),
        _vote(repeated > 0.4, n >= 20 and repeated < 0.1),
        _vote(len(lines) >= 4 and len(set(lines)) < 0.5 * len(lines), False),
        _vote(short > 0.2, short < 0.03),
    ]


LABELLERS = ("symbols", "bars", "adjacent", "sentences", "case", "triples", "lines", "lone marks")


def pattern(votes: list[int]) -> int:
    return sum(v * 3**k for k, v in enumerate(votes))


def fit_em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior P(good) of each pattern, and P(vote | class) as (labeller, class, vote)."""
    m = len(LABELLERS)
    votes = patterns[:, None] // 3 ** np.arange(m) % 3
    good, bad = (votes == GOOD).sum(axis=1), (votes == BAD).sum(axis=1)
    p = np.where(good == bad, 0.5, np.where(bad * 2 >= good, 0.1, 0.9))  # a bad vote names a fault, so it weighs more at the start
    table = np.zeros((m, 2, 3))
    for _ in range(rounds):
        w = np.stack([counts * (1 - p), counts * p])
        for j in range(m):
            for v in range(3):
                table[j, :, v] = (w * (votes[:, j] == v)).sum(axis=1) + 1.0
        table /= table.sum(axis=2, keepdims=True)
        prior = (w.sum(axis=1) + 1.0) / (counts.sum() + 2.0)
        logs = np.log(prior)[:, None] + np.stack([sum(np.log(table[j, c, votes[:, j]]) for j in range(m)) for c in (0, 1)])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    return p, table


class Features(dict):
    """Word to the hashed places of the word and its shape; a worker's memo."""

    def __missing__(self, w: str) -> tuple[int, int]:
        shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in w)
        short = "".join(c for k, c in enumerate(shape) if k == 0 or shape[k - 1] != c)
        value = (xxhash.xxh3_64_intdigest("w" + w.lower()) & (1 << BITS) - 1, xxhash.xxh3_64_intdigest("s" + short) & (1 << BITS) - 1)
        if len(self) < _MEMO:
            self[w] = value
        return value

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of a text's features; the values have length 1 as a vector."""
        pairs = np.array([self[w] for w in words], np.int64)
        shapes = pairs[:, 1]
        two = (shapes[1:] * 31 + shapes[:-1] * 17 + 7) % (1 << BITS)
        same = np.full(int((pairs[1:, 0] == pairs[:-1, 0]).sum()), 5)  # a word right after itself
        at, n = np.unique(np.concatenate([pairs[:, 0], shapes, two, same]), return_counts=True)
        x = np.sqrt(n)
        return at, x / np.linalg.norm(x)


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 150, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Weights (the last is the constant) by logistic regression; sides weigh equally."""
    at, x = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    side = y >= 0.5
    weight = np.where(side, 0.5 / max(side.sum(), 1), 0.5 / max((~side).sum(), 1))
    w, square = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(row, w[at] * x, len(rows)) + w[-1]
        error = weight * (1 / (1 + np.exp(-z)) - y)
        g = np.append(np.bincount(at, error[row] * x, 1 << BITS), error.sum()) + ridge * np.append(w[:-1], 0)
        square += g * g
        w -= rate * g / np.sqrt(square)
    return w


def classify(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, weak_label (posterior), score (the scorer's probability of good) and kept."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text"), F.lit(1 << 30)).alias("h"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n[pattern(labels(text or "", (text or "").split()))] += 1
        yield pa.RecordBatch.from_pydict({"pattern": list(n), "n": list(n.values())}, pa.schema([("pattern", pa.int32()), ("n", pa.int64())]))

    counted = sorted((r["pattern"], r["n"]) for r in staged(docs.select("text").mapInArrow(count, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")), "votes").collect())
    patterns, counts = np.array([p for p, _ in counted], np.int64), np.array([n for _, n in counted], float)
    silent = pattern([SILENT] * len(LABELLERS))
    voting = patterns != silent
    posterior = np.full(len(patterns), 0.5)
    posterior[voting], _ = fit_em(patterns[voting], counts[voting])
    by_pattern = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))
    n_good, n_bad = counts[voting & (posterior >= 0.5)].sum(), counts[voting & (posterior < 0.5)].sum()
    limit = TRAIN_ROWS // 2
    share = [min(1.0, limit / max(n, 1)) * (1 << 30) for n in (n_bad, n_good)]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for batch in batches:
            rows = []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or "").split()
                p = by_pattern[pattern(labels(text or "", words))]
                if words and h < share[p >= 0.5]:
                    at, x = f.of(words)
                    rows.append({"h": h, "y": p, "at": at.astype("<u2").tobytes(), "x": x.astype("<f4").tobytes()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("h", pa.int64()), ("y", pa.float64()), ("at", pa.binary()), ("x", pa.binary())]))

    weights = None
    if n_good and n_bad:
        drawn = source.where(F.col("h") < float(max(share))).select("h", "text").mapInArrow(sample, "h long, y double, at binary, x binary")
        drawn = staged(drawn, "sample")
        got = [r for side in (drawn.where("y >= 0.5"), drawn.where("y < 0.5")) for r in side.orderBy("h", "at").limit(limit).collect()]
        rows = [(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(float)) for r in got]
        weights = spark.sparkContext.broadcast(fit_scorer(rows, np.array([r["y"] for r in got])))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, w = Features(), weights.value if weights is not None else None
        for batch in batches:
            weak, scores = [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").split()
                weak.append(by_pattern[pattern(labels(text or "", words))])
                if not words:
                    scores.append(0.0)
                elif w is None:
                    scores.append(weak[-1])
                else:
                    at, x = f.of(words)
                    scores.append(float(1 / (1 + np.exp(-(w[at] @ x + w[-1])))))
            kept = [s >= threshold for s in scores]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weak, pa.float64()), pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())], names=["doc_id", "weak_label", "score", "kept"])

    return source.select("doc_id", "text").mapInArrow(score, "doc_id long, weak_label double, score double, kept boolean")
