"""Quality rules, line first: bad lines go, then documents that lose too much text.

Base rules look at the whole text (see ``base_counts``). The method's verdict looks at
lines with a word: a line fails the punctuation rule (mostly symbols, shouting, or a
short line that ends in no punctuation though lines that do hold at least half of the
text's line characters, so verse, lists, glossaries and code stay whole), the
navigation rule (bars or other separators between short entries) or the boilerplate
rule (stock phrases of four languages that hold a tenth of the line). Failing lines are removed, blank ones
stay where they are; a document is rejected when failing lines held
more than ``max_removed_percent`` of its lines' characters.

All of it is one projection over the row: no shuffle, nothing gathered, memory bounded
by one text. Sorting a text's 3-word windows costs n log n in its words.

Defined cases: a null or blank text has zero counts and fails the base rules (under 50
words); a text of any length is read whole; repeated rows are judged alike; an empty
table gives an empty result; other columns, whatever their names, pass through ``cleaned`` untouched. A line's
end is looked for before its trailing white space, a carriage return too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.words import SPACES, WORD, words
from marquee.plans.rows import packed, unpacked

#: Stock phrases, lower case, as patterns (a dot stands for a letter with a mark); four languages.
BOILERPLATE = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "cookies to improve",
    "enable javascript",
    "licensed under",
    "lorem ipsum",
    "permission is hereby granted",
    "privacy policy",
    "sign up for our newsletter",
    "terms of service",
    "terms of use",
    "this work is licensed",
    "alle rechte vorbehalten",
    "allgemeine gesch.ftsbedingungen",
    "datenschutzerkl.rung",
    "hier klicken",
    "newsletter abonnieren",
    "nutzungsbedingungen",
    "abonnez-vous . notre newsletter",
    "cliquez ici",
    "conditions d.utilisation",
    "politique de confidentialit.",
    "tous droits r.serv.s",
    "haga clic aqu.",
    "pol.tica de privacidad",
    "suscr.bete a nuestro bolet.n",
    "t.rminos de uso",
    "todos los derechos reservados",
)


def stock_pattern(phrases: tuple[str, ...] = BOILERPLATE) -> str:
    """One pattern of all phrases, grouped by their first letters: most places of a text then fail at a few branches."""
    heads = sorted({p[0] for p in phrases})
    return "(?i)" + "|".join(f"{h}(?:{'|'.join(p[1:] for p in phrases if p[0] == h)})" for h in heads)


#: A line is boilerplate where stock phrases hold one in so many of its characters at least; a paragraph that only mentions one isn't.
STOCK_SHARE = 10
_WINDOWS = "array<struct<h:bigint,w:struct<a:string,b:string,c:string>,i:int>>"
#: Last characters of a punctuated line, full stops of other scripts too.
LINE_ENDS = ".!?…:;\"'”’»)]。｡．！？：；」』）】،؛؟۔।॥။።៖។"


def repeated_window_words(w: Column) -> Column:
    """Words (array ``w``) that lie in 3-word windows found twice or more, first included."""
    n = F.size(w)
    zipped = F.slice(F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), n).alias("b"), F.slice(w, F.lit(3), n).alias("c")), F.lit(1), F.greatest(n - 2, F.lit(0)))
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["w"] == y["w"]), F.lit(False))
    neighbours = lambda s: F.filter(s, lambda x, k: same(x, F.get(s, k + 1)) | same(x, F.get(s, k - 1)))
    # hashes alone are sorted first: they show which windows may repeat, and only those are compared by their words
    hashes = F.transform(zipped, lambda x: F.xxhash64(x))
    again = lambda s: F.array_distinct(F.filter(s, lambda h, k: F.coalesce(h == F.get(s, k + 1), F.lit(False))))
    at = lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"))
    some = lambda hs, d: F.transform(F.filter(F.sequence(F.lit(0), F.size(hs) - 1), lambda i: (F.size(d) > 100) | F.array_contains(d, F.get(hs, i))), lambda i: F.struct(F.get(hs, i).alias("h"), at(i).alias("w"), i.alias("i")))
    found = lambda hs, d: F.when(F.size(d) == 0, F.array().cast(_WINDOWS)).otherwise(F.flatten(F.transform(F.array(F.sort_array(some(hs, d))), neighbours)))
    twice = F.flatten(F.transform(F.array(hashes), lambda hs: F.flatten(F.transform(F.array(F.sort_array(hs)), lambda s: F.flatten(F.transform(F.array(again(s)), lambda d: found(hs, d)))))))
    covered = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return F.when(n < 4, F.lit(0)).otherwise(F.size(F.array_distinct(covered)))


def base_counts(text: Column) -> dict[str, Column]:
    """Working columns ``_w`` and ``_lines`` and those made of them: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    symbols = F.when(text.rlike(r"[#*$%&|<>]"), F.regexp_count(text, F.lit(r"[#*$%&|<>]"))).otherwise(0)
    return {
        "_w": words(text),
        "_lines": lines,
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": symbols.cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_window_words(F.col("_w")).cast("long"),
    }


def ends_punctuated(line: Column) -> Column:
    """Whether a line's last character, trailing white space aside, is punctuation."""
    return F.contains(F.lit(LINE_ENDS), F.right(F.rtrim(line, F.lit(SPACES)), F.lit(1)))


def line_fails(line: Column, punctuated: Column) -> Column:
    """Whether one line of a text, ``punctuated`` or not, is removed; see the module's text for the rules."""
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    n = count(WORD)
    pattern = stock_pattern()
    rest = F.length(F.regexp_replace(line, pattern, ""))
    stock = F.when(line.rlike(pattern), STOCK_SHARE * (F.length(line) - rest) >= F.length(line)).otherwise(False)
    symbols, bangs, bars = count(r"[#*$%&<>]"), count("!"), count(r"[|»›•·]")
    noisy = (symbols >= 3) & (2 * symbols >= n) | (bangs >= 6) & (2 * bangs >= n) | (bars >= 3) & (3 * bars >= n)
    short = F.when(~punctuated | ends_punctuated(line), False).otherwise(n <= 3)
    return F.when(line.rlike(r"[#*$%&<>!|»›•·]"), noisy).otherwise(False) | short | stock


def _judged(docs: DataFrame, max_removed_percent: int) -> DataFrame:
    """The caller's rows in ``row`` and beside them the base counts, ``clean_lines`` and the verdict."""
    chars = lambda x: F.length(F.array_join(x, "")).cast("long")
    text = F.col("row.text")
    counts = base_counts(text)
    out = packed(docs).withColumns({k: counts.pop(k) for k in ("_w", "_lines")}).withColumns(counts).drop("_w")
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    punctuated = 2 * chars(F.filter("_lines", ends_punctuated)) >= chars(F.col("_lines"))
    # an array of one holds the text's own condition: as a column Spark would work it out again for each line
    blank = lambda x: F.btrim(x, F.lit(SPACES)) == ""
    every = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    good = F.transform(F.array(punctuated), lambda p: F.filter(every, lambda x: F.when(blank(x), True).otherwise(~line_fails(x, p))))
    out = out.withColumn("_left", F.flatten(good))
    out = out.withColumn("clean_lines", F.filter("_left", lambda x: ~blank(x)))
    out = out.withColumns({"line_chars": chars(F.col("_lines")), "removed_chars": chars(F.col("_lines")) - chars(F.col("clean_lines"))}).drop("_lines")
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("removed_chars") <= max_removed_percent * F.col("line_chars")))


def judged(docs: DataFrame, max_removed_percent: int = 50) -> DataFrame:
    """doc_id and text of every row with the base counts, ``clean_lines`` (array), ``line_chars``, ``removed_chars`` and ``kept``."""
    return _judged(docs.select("doc_id", "text"), max_removed_percent).select("row.doc_id", "row.text", "*").drop("row", "_left")


def cleaned(docs: DataFrame, max_removed_percent: int = 50) -> DataFrame:
    """The kept documents with the columns of ``docs``; their failing lines are removed from the text, blank lines stay, and ``n_chars``, if any, follows."""
    # the row number is never negative: it keeps Spark from moving the filter below and evaluating all rules again for it
    kept = _judged(docs, max_removed_percent).withColumn("_no", F.monotonically_increasing_id()).where("kept and _no >= 0")
    text = F.array_join("_left", "\n")
    return unpacked(kept, docs.columns, text=text, n_chars=F.length(text).cast("long"))
