"""Operators that SQL can't express, and the pipeline, against plain-Python versions over whole small tables."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex

import corpus_pipeline
from marquee.llm import jaccard, quality_rules, secrets, weak_quality
from marquee.llm.tokens import memo
from marquee.llm.words import SPACES
from tests.llm.test_llm import brute_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- secrets -----------------------------------------------------------------------------------------

_CANDIDATE = regex.compile(secrets.CANDIDATE)


def features(text, left, right):
    head = text
    n = max(len(head), 1)
    count = lambda p: sum(m.end() > m.start() or True for m in regex.finditer(p, head))
    before, after = left[-secrets.AROUND :], right[: secrets.AROUND]
    last = m[1] if (m := re.search(r"([A-Za-z0-9_-]+)[^A-Za-z0-9_-]*$", before)) else ""
    flag = lambda p, x, f=0: 1.0 if re.search(p, x, f) else 0.0
    return [
        max(len(text), 1.0),
        count(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])") / n,
        count("[0-9]") / n,
        count("[A-Z]") / n,
        len(set(head)) / min(n, 40.0),
        1 - len(re.sub(f"(?i)(?:{secrets.DICTIONARY})", "", head)) / n,
        flag(r"^[a-z]+://|^/|(?<![a-z_-])(?:[a-z_-]{2,}+/){2}|\.(?:html?|png|jpe?g|py|js|txt|json|com|org|net)\b|[0-9]{4}-[0-9][0-9]-[0-9][0-9]", head),
        flag("^[0-9a-fA-F-]+$", head),
        max(flag(f"^[a-z0-9_-]*(?:{secrets.FOR})$", last, re.I), flag(f"(?:{secrets.FOR})[^A-Za-z0-9]{{0,6}}$", before, re.I)),
        max(flag(f"^(?:{secrets.AGAINST})$", last, re.I), flag(f"\\b(?:{secrets.AGAINST})\\b[^.]{{0,12}}$", before, re.I)),
        flag(r"[=:][ \t\n\x0b\f\r]*[\"']?$", before),
        flag(f"^(?:{secrets.PREFIXES})", head),
        flag(r"^[0-9 .+()-]+$", head),
        flag(r"(.)\1{4}", head),
        count(f"(?i)(?=(?:{secrets.PAIRS}))") / n,
        flag(f"^[^A-Za-z0-9]{{0,3}}{secrets._SAID}(?:{secrets.FOR})\\b", after, re.I | re.A),
        flag(f"^[^A-Za-z0-9]{{0,3}}{secrets._SAID}(?:{secrets.AGAINST})\\b", after, re.I | re.A),
    ]


def votes(trees, f):
    def value(tokens):
        t = next(tokens)
        if t != "CASE":
            return float(t.rstrip("D"))
        next(tokens)  # WHEN
        k = int(re.match(r"f\[(\d+)\]", next(tokens))[1])
        next(tokens)  # <=
        bound = float(next(tokens).rstrip("D"))
        next(tokens)  # THEN
        low = value(tokens)
        next(tokens)  # ELSE
        high = value(tokens)
        next(tokens)  # END
        return low if f[k] <= bound else high

    return sum(value(iter(t.split())) for t in trees) / len(trees)


def scan(text, trees):
    """(start, length, candidate, score) of every candidate."""
    hits = list(_CANDIDATE.finditer(text or ""))
    edges = [0, *(x for m in hits for x in m.span()), len(text or "")]
    return [(m.start(), m.end() - m.start(), m[0], votes(trees, features(m[0], text[edges[2 * k] : edges[2 * k + 1]], text[edges[2 * k + 2] : edges[2 * k + 3]]))) for k, m in enumerate(hits)]


def redact(text, trees):
    for start, length, _, score in reversed(scan(text, trees)):
        if score >= 0.5:
            text = text[:start] + "[SECRET]" + text[start + length :]
    return text


def test_secret_findings(spark, docs):
    trees = secrets.forest(spark)
    got = sorted((r["doc_id"], r["start"], r["length"], r["candidate"], round(r["score"], 9)) for r in secrets.findings(docs).collect())
    want = sorted((r["doc_id"], s, n, c, round(v, 9)) for r in docs.collect() for s, n, c, v in scan(r["text"], trees))
    assert got == want and want


def test_one_pass_of_the_pattern(spark, docs):
    """No plan holds the candidates' pattern twice."""
    for df in (secrets.findings(docs), secrets.redacted(docs)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[^-]") <= 1


def test_texts_with_control_characters(spark):
    """A text that holds the characters of the marks is cut at its candidates only."""
    texts = ["\x01\x02 token = \"ab12cd34ef56ab12cd34\" \x01x\x02", "\x01" * 30 + "k=\x01\x02\x01\x02\x01\x02 $0 \\1", "a$0b=$1$2$3$4$5\\ x"]
    trees = secrets.forest(spark)
    rows = secrets.findings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), trees).collect()
    assert sorted((r.doc_id, r.start, r.length, r.candidate, round(r.score, 9)) for r in rows) == sorted((i, a, n, c, round(v, 9)) for i, t in enumerate(texts) for a, n, c, v in scan(t, trees))


def test_words_on_both_sides(spark):
    """What stands after a value decides where nothing before it does, and the whole of a long run counts."""
    raw = hashlib.sha256(b"y").hexdigest()[:40]
    texts = [f"see {raw} is the commit", f"see {raw} is my password", "see " + "readable-words-of-the-house/" * 30 + " at home"]
    rows = {r.doc_id: r.is_secret for r in secrets.findings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows == {0: False, 1: True, 2: False}


def test_five_long_secrets(spark):
    """The shapes that a bounded pattern would cut: all are redacted in full."""
    raw = hashlib.sha256(b"x").hexdigest() * 20
    letters = "".join(np.random.default_rng(4).choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), 109))
    texts = [f'token = "{raw[:700]}" end', f'password = "{"aB3$xY9!" * 12}" end', f"api_key={letters}7{raw[:14]} end", 'password = "CorrectHorseBatteryStaple" end', "-----BEGIN PRIVATE KEY-----\n" + "\n".join(raw[:64] for _ in range(150)) + "\n-----END PRIVATE KEY----- end"]
    out = [r["text"] for r in secrets.redacted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert out == ['token = "[SECRET]" end', 'password = "[SECRET]" end', "api_key=[SECRET] end", 'password = "[SECRET]" end', "[SECRET] end"]


# -- weak labels ----------------------------------------------------------------------------------------


def test_weak_quality_in_one_process(spark, docs):
    w = weak_quality
    rows = [(r["doc_id"], r["text"] or "", r["h"]) for r in docs.selectExpr("doc_id", "text", f"pmod(xxhash64(doc_id, text), {1 << 30}) h").collect()]
    pattern = [w.pattern(w.labels(t, t.split())) for _, t, _ in rows]
    counts = sorted(Counter(p for p in pattern if p != w.pattern([w.SILENT] * len(w.LABELLERS))).items())
    posterior, _ = w.fit_em(np.array([p for p, _ in counts]), np.array([float(n) for _, n in counts]))
    p = dict(zip([p for p, _ in counts], posterior.tolist(), strict=True))
    f = w.Features()
    sides = [[x for x in zip((r[2] for r in rows), pattern, (f.of(r[1].split()) if r[1].split() else None for r in rows), strict=True) if x[2] and (p.get(x[1], 0.5) >= 0.5) == side] for side in (True, False)]
    drawn = [x for s in sides for x in sorted(s, key=lambda x: (x[0], x[2][0].astype("<u2").tobytes()))]
    weights = w.fit_scorer([(a, x.astype("<f4").astype(float)) for _, _, (a, x) in drawn], np.array([p.get(k, 0.5) for _, k, _ in drawn]))
    want = {}
    for (d, t, _), k in zip(rows, pattern, strict=True):
        at, x = f.of(t.split()) if t.split() else (None, None)
        score = 1 / (1 + math.exp(-(weights[at] @ x + weights[-1]))) if at is not None else 0.0
        want[d] = (round(p.get(k, 0.5), 9), round(score, 9), score >= 0.5)
    assert {r["doc_id"]: (round(r["weak_label"], 9), round(r["score"], 9), r["kept"]) for r in w.classify(docs).collect()} == want


# -- the pipeline --------------------------------------------------------------------------------------------


def clean(text):
    """The kept text by the quality rules, or None."""
    words = WORD.findall(text or "")
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {k + d for k in range(len(words) - 2) if triples[tuple(words[k : k + 3])] > 1 for d in range(3)}
    if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
        return None
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    ended = lambda x: x.rstrip(SPACES)[-1:] in set(quality_rules.LINE_ENDS)
    size = sum(map(len, lines))
    punctuated = 2 * sum(len(x) for x in lines if ended(x)) >= size

    def fails(x):
        n = len(WORD.findall(x))
        symbols, bangs, bars = (sum(x.count(c) for c in s) for s in ("#*$%&<>", "!", "|»›•·"))
        noisy = symbols >= 3 and 2 * symbols >= n or bangs >= 6 and 2 * bangs >= n or bars >= 3 and 3 * bars >= n
        stock = sum(len(m[0]) for m in re.finditer("|".join(quality_rules.BOILERPLATE), x, re.I))
        return noisy or punctuated and not ended(x) and n <= 3 or bool(stock) and quality_rules.STOCK_SHARE * stock >= len(x)

    good = [x for x in lines if not fails(x)]
    left = [x for x in text.split("\n") if not x.strip(SPACES) or not fails(x)]
    return "\n".join(left) if 100 * (size - sum(map(len, good))) <= 50 * size else None


def mix(rows):
    """(doc_id, text) copies that the mix takes of (doc_id, text, source)."""
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    size = {s: sum(len(WORD.findall(t)) for _, t, o in rows if o == s) for s in sources}
    target, free, budget = {}, set(sources), 1.5 * sum(size.values())
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if 2 * size[s] <= level * weight[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * size[s] for s in over}
        free -= over
    out = []
    for s in sources:
        own = sorted((hashlib.md5(f"mix:{d}".encode()).hexdigest(), d, t) for d, t, o in rows if o == s)
        epochs, at = int(target[s] // size[s]) if size[s] else 0, 0
        rest = int(target[s]) - epochs * size[s]
        for _, d, t in own:
            n = len(WORD.findall(t))
            extra = max(0, min(n, rest - at))
            at += n
            out += [(d, t)] * (epochs if n else 0)
            if extra:
                out.append((d, t if extra == n else "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", t)[:extra])))
    return out


def test_pipeline_by_hand(spark, docs):
    """All five stages on the whole table, row by row."""
    trees = secrets.forest(spark)
    rows = [(r["doc_id"], clean(r["text"]), r["source"]) for r in docs.collect()]
    rows = [r for r in rows if r[1] is not None]
    groups = brute_components([(d, t) for d, t, _ in rows])
    rows = [r for r, (d, _, root) in zip(rows, groups, strict=True) if d == root]
    rows = [(d, redact(t, trees), s) for d, t, s in rows]
    mixed = mix(rows)
    path, want = public_tokenizers.path("word_bpe_49k.json"), []
    for d, t in mixed:
        ids = np.array([*memo(path).lib.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want += [(d, k, s, min(4096, len(ids) - s), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096
    assert len(by) <= 1.02 * -(-sum(w[3] for w in want) // 4096) + 1


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline_on_odd_tables(spark, tmp_path, kind):
    story = "\n".join(f"Line {k} tells number {k + 100} of a long story about towns{k} and rivers{k}." for k in range(8))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, story, "en", "a", 1), (3, story, "en", "a", 1), (None, story + " End.", None, None, None), (4, story.replace("story", "tale") + ' token = "7c72db563d7f6e50cec00950f7bab1f2223b6afd".', "en", "b", 1)]
    spark.createDataFrame(rows if kind == "odd" else [], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == ({3, 4} if kind == "odd" else set())


# -- large groups in near duplicates ---------------------------------------------------------------------------


def components(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_hot_tiles(spark):
    """Tiles cut by bands and blocks give what brute force gives."""
    rng = np.random.default_rng(9)
    stock = [" ".join(f"s{k}_{i}" for i in range(12)) for k in range(6)]
    rows = []
    for d in range(300):
        own = [stock[k] for k in rng.permutation(6)[: rng.integers(1, 5)]]
        rows.append((d, " ".join([*own, *(f"u{d % 90}_{i}" for i in range(rng.integers(0, 6)))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert components(jaccard.jaccard_components(df, hot_docs=9)) == sorted(brute_components(rows), key=repr)


def test_heat_from_exact_counts(spark, monkeypatch):
    """Where the list of common shingles misses all (one a chunk), tiles that are large are found while they are made."""
    monkeypatch.setattr(jaccard, "LATE_DOCS", 10**9)
    test_hot_tiles(spark)


def test_pairs_of_a_tile_come_in_blocks(monkeypatch):
    """19,000 unlike rows of equal size in one tile: 180 million pairs, a bounded number at a time; small tiles against all pairs."""
    rng = np.random.default_rng(3)
    n = np.sort(rng.integers(4, 40, 300))
    tile, rid, comp, pos = np.sort(rng.integers(0, 3, 300)), np.arange(300), rng.integers(0, 40, 300), rng.integers(0, 3, 300)
    order = np.lexsort((n, tile))
    n, comp, pos = n[order], comp[order], pos[order]
    fits = lambda i, j: tile[i] == tile[j] and comp[i] != comp[j] and 1 + min(n[i] - pos[i] - 1, n[j] - pos[j] - 1) >= jaccard.needed_overlap(n[i], n[j])
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if fits(i, j)}
    for most in (1 << 20, 50):
        monkeypatch.setattr(jaccard, "PAIRS", most)
        got = [p for a, b in jaccard._tile_pairs(tile, rid, comp, n, pos) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert set(got) == want
    monkeypatch.setattr(jaccard, "PAIRS", 1 << 20)
    rows = 19_000
    tracemalloc.start()
    found = sum(len(a) for a, _ in jaccard._tile_pairs(np.zeros(rows, np.int64), np.arange(rows), np.arange(rows), np.full(rows, 40), np.zeros(rows, np.int64)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == rows * (rows - 1) // 2 and peak < 500_000_000


def test_a_row_repeated_50000_times(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = spark.range(50_000).selectExpr("7 doc_id", f"'{text}' text").union(spark.createDataFrame([(3, text + " more"), (9, "something else in this text of its own")], "doc_id long, text string"))
    got = Counter(map(tuple, jaccard.jaccard_components(rows).collect()))
    assert got == {(7, 36, 3): 50_000, (3, 37, 3): 1, (9, 4, 9): 1}
    more = rows.union(spark.createDataFrame([(11, "a text that comes twice in this table")] * 2, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(more).collect()) == [3, 9, 11]


def test_a_tile_of_100000_rows(spark):
    """Documents that share one frequent shingle in their prefixes, and are no copies but for one pair."""
    shared = "five words that all share"
    rows = spark.range(100_000).selectExpr("id doc_id", f"concat('{shared} ', 'a', cast(id % 50000 as string), ' b', cast(id as string)) text")
    pair = spark.createDataFrame([(200_000, shared + " a7 b7 c c c"), (200_001, shared + " a7 b7 c c c"), (200_002, shared)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(rows.union(pair), hot_docs=1000).collect()}
    assert len(got) == 100_003 and got[200_001] == 200_000
    assert sum(d != c for d, c in got.items()) == 1
