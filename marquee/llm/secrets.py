"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are runs of 16 or more token characters that are not all punctuation, values of
6 or more characters after ``=`` or ``:``, and private-key blocks. None needs a digit. A random forest votes on each by its length, changes
of character class, digits and case, coverage by dictionary pieces and by common pairs of letters, likeness to a path,
and the words on both sides. All features of a candidate are made of the whole of it. Findings that half its trees or more accept are secrets.

The forest is trained on labelled findings (``labelled_findings`` makes a bounded set of
``TRAINING_ROWS`` by rule; another set can be given) and then becomes one SQL
expression. Scanning is a projection of the row: patterns, features and votes are SQL
functions, nothing is shuffled, and only texts with candidates pay for features. The pattern runs once over
a text, which puts marks around candidates that can't stand in it (they hold its MD5), and the text is cut at the marks; all that
follows is bound inside one expression, so that no optimiser can copy the pattern.

Defined cases: a null or empty text has no candidates; a text of any length is scanned
whole; repeated rows give repeated findings; an empty table gives an empty result; other
columns, whatever their names, pass through ``redacted`` untouched. Training needs findings of both labels.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.plans.rows import packed, unpacked

TRAINING_ROWS = 4_000
#: Words before a candidate that speak for, or against, a secret (fixed lists).
FOR = "token|secret|password|passwd|pwd|apikey|api_key|access_key|auth|authorization|bearer|credential|credentials|private_key|client_secret|secret_key"
AGAINST = "commit|sha|sha1|sha256|md5|checksum|hash|digest|uuid|guid|revision|rev|example|sample|isbn|doi|order|invoice|card|phone|tel|version|build|etag|id"
#: Pieces that readable names are made of (fixed list).
DICTIONARY = "example|sample|placeholder|changeme|password|secret|token|user|name|test|demo|data|file|path|value|index|config|server|client|main|page|image|item|order|http|https|www|com|org|net|html|json|version|release|build|the|and|for|ing|tion|ment|able|ness|ver|con|pre|pro|xxx|abc|your|time|year|people|work|world|life|hand|part|place|week|case|point|number|group|problem|fact|home|water|room|mother|area|money|story|month|right|study|book|word|business|issue|side|kind|head|house|service|friend|father|power|hour|game|line|city|team|body|back|level|office|door|health|person|party|result|change|morning|reason|research|moment|teacher|force|education|school|state|family|student|country|question|government|program|company|system|which|there|would|about|could|other|these|first|after|great|where|street|market|light|night|ich|und|der|die|das|ein|schaft|heit|keit|ung|lich|les|des|que|pour|dans|est|ement|eur|ique|los|las|por|para|cion|dad|mente|ando|tra|inter|trans|over|under|out|able|ful|less|ship|ism|ist|ity|ous|ive|ance|ence|logy|graph|auto|anti|super|micro|public|static|class|func|def|return|import|string|array|object|method|query|select|table|count|list|node|type|key|require|option|undefin|disab|enab|expire|valid|missing|empty|null|none|true|false|default"
#: Pairs of letters that are common in words (fixed list).
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur"
# what may stand between a candidate and a word on what it is
_SAID = r"(?:(?:is|as|was|ist|est|es|for|the|my|our|an|a|your|der|die|das|le|la|el|un|une|API|new|old)\s+){0,4}"
PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|rk_live_|sk-|xoxb-|xoxp-|AIza|eyJ|SG\\.|npm_|-----BEGIN"
# every candidate runs to its end; possessive loops are iterative in Java, so texts of any length fit the stack
_NEXT = r"[&;,?|#](?=[A-Za-z_][A-Za-z0-9_.-]{1,40}[=:])"  # a mark before the next name with a value
_SCHEME = r"(?i:bearer|negotiate)[ ]{1,4}[A-Za-z0-9_+/~.-]{16}"  # names how the token behind it is sent; that one is a candidate of its own
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[^-]++|-(?!----(?:BEGIN|END) [A-Z ]{0,30}PRIVATE KEY-----))++-----END [A-Z ]{0,30}PRIVATE KEY-----"
    r"|(?<![A-Za-z0-9_+/~.-])(?=[_+/~.-]*+[A-Za-z0-9])[A-Za-z0-9_+/~.-]{16,}+={0,2}"
    r"|(?<=[=:][ ]{0,2}[\"']?)(?![=:])(?!" + _SCHEME + r")(?:(?!" + _NEXT + r")[^\s\"']){6,}+"
)
FEATURES = ("length", "changes", "digits", "upper", "distinct", "dictionary", "path", "hex", "for", "against", "assigned", "prefix", "all_digits", "repeats", "pairs", "for_after", "against_after")
#: Characters on each side that its neighbouring words are looked for in.
AROUND = 60


def features(text: Column, left: Column, right: Column) -> Column:
    """Array of doubles, in the order of ``FEATURES``, for a candidate and what stands around it."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    count = lambda pattern, x=text: F.regexp_count(x, F.lit(pattern)).cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    before, after = F.right(left, F.lit(AROUND)), F.left(right, F.lit(AROUND))
    last = F.regexp_extract(before, r"([A-Za-z0-9_-]+)[^A-Za-z0-9_-]*$", 1)
    return F.array(
        n,
        count(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])") / n,
        count("[0-9]") / n,
        count("[A-Z]") / n,
        F.size(F.array_distinct(F.split(text, ""))).cast("double") / F.least(n, F.lit(40.0)),
        1 - F.length(F.regexp_replace(text, f"(?i)(?:{DICTIONARY})", "")) / n,
        flag(text.rlike(r"^[a-z]+://|^/|(?<![a-z_-])(?:[a-z_-]{2,}+/){2}|\.(?:html?|png|jpe?g|py|js|txt|json|com|org|net)\b|\d{4}-\d\d-\d\d")),
        flag(text.rlike("^[0-9a-fA-F-]+$")),
        flag(last.rlike(f"(?i)^[a-z0-9_-]*(?:{FOR})$") | before.rlike(f"(?i)(?:{FOR})[^A-Za-z0-9]{{0,6}}$")),
        flag(last.rlike(f"(?i)^(?:{AGAINST})$") | before.rlike(f"(?i)\\b(?:{AGAINST})\\b[^.]{{0,12}}$")),
        flag(before.rlike(r"[=:]\s*[\"']?$")),
        flag(text.rlike(f"^(?:{PREFIXES})")),
        flag(text.rlike(r"^[0-9 .+()-]+$")),
        flag(text.rlike(r"(.)\1{4}")),
        count(f"(?i)(?=(?:{PAIRS}))") / n,
        flag(after.rlike(f"(?i)^[^A-Za-z0-9]{{0,3}}{_SAID}(?:{FOR})\\b")),
        flag(after.rlike(f"(?i)^[^A-Za-z0-9]{{0,3}}{_SAID}(?:{AGAINST})\\b")),
    )


def labelled_findings(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """candidate, before, after, is_secret: ``rows`` findings made by rule from hashes of their numbers."""
    h = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    mixed = F.translate(F.base64(F.unhex(h("b"))), "+/=", "xQ7")
    pick = lambda values, salt: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(values))) + 1).cast("int"))
    names = ("token", "secret", "api_key", "access_key", "auth_token", "client_secret", "password", "SECRET_KEY", "credential")
    given = F.concat(pick(("see ", "les ", "of ", "", "set ", "export "), "w"), pick(names, "n"), pick((' = "', "=", ": ", " = '", '": "'), "e"))
    other = pick(("in the ", "und ", "call ", "see ", "of ", "x = ", "ref: ", "at ", "page "), "o")
    noted = F.concat(pick(("commit ", "sha1 ", "md5: ", "checksum = ", "uuid ", "revision ", "hash: ", "etag: ", "digest ", "build "), "m"))
    letters = F.translate(mixed, "0123456789", "qwzKvJxYhB")
    word = lambda salt: pick(("correct", "horse", "battery", "staple", "window", "garden", "purple", "monkey", "orbit", "velvet", "thunder", "castle", "river", "copper", "lantern", "winter"), salt)
    plain = lambda salt: pick(("remember", "something", "Introduction", "question", "yesterday", "weather", "government", "Department", "important,", "several", "people.", "history", "together", "Monday"), salt)
    prose = F.concat(pick(("note", "Summary", "he said", "for three reasons", "title", "Author", "remark", "und", "size", "color", "class", "x"), "q"), pick((": ", ": ", ":", " = ", "="), "e"))
    told = lambda words, salt: F.concat(pick((" is the ", " as ", " is my ", " (", ", our ", " was the "), salt), pick(words, salt + "w"))
    secret_after, plain_after = told(("password", "token", "API key auth", "secret", "access_key", "credential"), "y1"), told(("commit", "sha1", "checksum", "revision", "md5 sum", "order", "hash"), "y2")
    afterwards: dict[int, Column] = {}  # kinds that the words after them decide
    kinds = [
        (F.substring(h("a"), 1, 40), given, True),
        (F.substring(h("c"), 1, 32), given, True),
        (F.substring(mixed, 1, 40), given, True),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(h("d"), 1, 16))), pick(("key ", "aws ", "", "id = "), "k"), True),
        (F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), pick(("", "token ", "use ", "git "), "k"), True),
        (F.concat(F.lit("sk_live_"), F.substring(mixed, 3, 24)), pick(("", "stripe ", "key: "), "k"), True),
        (F.concat(F.substring(mixed, 1, 10), F.lit("!9")), F.concat(F.lit("password"), pick((": ", " = ", '="'), "e")), True),
        (F.substring(h("g"), 1, 18), F.concat(pick(("", "and ", "les ", "### "), "w"), pick(("password", "passwd", "pwd", "secret"), "n"), pick(("=", ": ", " = "), "e")), True),
        (F.concat(F.lit("eyJ"), mixed, F.lit("."), F.substring(mixed, 5, 30)), pick(("Bearer ", "token=", "jwt "), "k"), True),
        (F.concat(F.lit("eyJ"), F.repeat(mixed, 14), F.lit("."), F.repeat(F.substring(mixed, 5, 30), 9)), pick(("Bearer ", "token=", "jwt "), "k"), True),
        (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), F.repeat(F.concat(mixed, F.lit("\n")), 60), F.lit("-----END RSA PRIVATE KEY-----")), pick(("", "key: ", "see ", "\n"), "k"), True),
        (F.concat(word("w1"), word("w2"), pick(("", "", "tree", "lamp"), "w3")), given, True),
        (F.concat(word("w1"), pick(("-", "!", "_", "."), "j"), word("w2"), pick(("-", "!", "_", "."), "j"), word("w3")), given, True),
        (F.substring(letters, 1, 40), given, True),
        (F.substring(F.lower(letters), 1, 20), given, True),
        (F.substring(letters, 3, 36), pick(("Bearer ", "key ", "", "use "), "k"), True),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(letters, 1, 16))), pick(("key ", "aws ", "", "id = "), "k"), True),
        (F.concat(pick(("ghp_", "sk_live_", "xoxb-", "npm_"), "p"), F.substring(letters, 1, 30)), pick(("", "token ", "use ", "key: "), "k"), True),
        (plain("v1"), prose, False),
        (F.concat(plain("v1"), pick((",", ".", "", ";"), "z")), other, False),
        (F.concat(pick(("required", "optional", "undefined", "string", "changeme", "password", "function", "placeholder", "example", "disabled", "expired"), "v1"), pick(("", ",", "", "."), "z")), given, False),
        (F.concat_ws("-", pick(("well", "state", "sk", "mother", "long"), "p"), word("w1"), pick(("of", "in", "and", "to"), "y"), pick(("the", "law", "art", "date"), "x"), pick(("known", "style", "wide", "based"), "u")), other, False),
        (F.concat_ws("_", pick(("get", "set", "load", "your"), "p"), pick(("user", "server", "client", "config"), "y"), pick(("token", "name", "value", "path"), "x"), pick(("from", "for", "in", "to"), "u"), pick(("file", "data", "page", "index"), "t")), pick(("token = ", "def ", "x = ", "password: "), "k"), False),
        (F.concat(pick(("org", "com", "java"), "p"), F.lit("."), word("w1"), F.lit("."), word("w2"), F.lit("."), pick(("util", "sql", "core"), "y")), other, False),
        (F.concat(pick(("/", "https://www.", "//", ""), "p"), word("w1"), pick((".com/", ".org/", "/"), "y"), word("w2"), F.lit("/"), word("w3"), pick((".html", "/index", "", ".png"), "t")), pick(("see ", "href=", "url: ", "at "), "k"), False),
        (F.concat(F.initcap(word("w1")), F.initcap(word("w2")), F.initcap(word("w3")), pick(("Factory", "Builder", "Exception", ""), "t")), pick(("class ", "new ", "the ", "x = "), "k"), False),
        (pick(("Donaudampfschifffahrt", "internationalization", "Geschwindigkeitsbegrenzung", "Verantwortungsbewusstsein", "anticonstitutionnellement", "responsabilidades"), "v1"), other, False),
        (F.upper(F.concat(word("w1"), word("w2"), pick(("", "S", "ING", "TREE"), "t"))), other, False),
        (F.concat(word("w1"), pick(("...................", "--------------------", "____________________", "/-/-/-/-/-/-/-/-/"), "t")), other, False),
        (F.substring(h("a"), 1, 40), noted, False),
        (F.substring(h("c"), 1, 32), noted, False),
        (F.regexp_replace(F.substring(h("u"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.concat(pick(("uuid ", "id ", "", "guid = "), "m")), False),
        (F.substring(F.regexp_replace(h("e"), "[^0-9]", "7"), 1, 16), other, False),
        (F.concat(pick(("user_name_", "example_token_", "test_value_", "sample-data-file-", "release_version_", "your_api_key_here_"), "p"), F.substring(h("f"), 1, 2), F.lit("1")), pick(("token = ", "see ", "x = ", "use "), "k"), False),
        (F.concat(F.lit("/"), pick(("data/main/", "images/pages/", "src/config/"), "p"), F.lit("file"), F.substring(h("f"), 1, 3), F.lit("0.json")), other, False),
        (F.concat(F.lit("https://www.example.com/page/"), F.substring(h("f"), 1, 6), F.lit("1")), other, False),
        (F.concat(F.lit("https://www.example.com/page/"), F.repeat(F.concat(F.lit("item/"), F.substring(h("f"), 1, 2), F.lit("/")), 60)), other, False),
        (F.concat(F.lit("20"), F.substring(F.regexp_replace(h("e"), "[^0-9]", "1"), 1, 2), F.lit("-01-12T10:30:00")), other, False),
        (F.concat(F.lit("xxxxxxxxxxxx"), F.substring(h("f"), 1, 3), F.lit("00000")), pick(("password = ", "token=", "card ", ""), "k"), False),
        (F.concat(pick(("user.", "that.", "info."), "p"), F.substring(F.regexp_replace(h("e"), "[^0-9]", "2"), 1, 2), F.lit("mail2.example.com")), other, False),
    ]
    for value in (F.substring(h("a"), 1, 40), F.substring(h("c"), 1, 32), F.substring(mixed, 1, 24)):
        for words, secret in ((secret_after, True), (plain_after, False)):
            afterwards[len(kinds)] = words
            kinds.append((value, other, secret))
    number = F.pmod(F.col("id"), F.lit(len(kinds)))
    choose = lambda i: F.coalesce(*[F.when(number == k, kind[i] if i < 2 else F.lit(kind[i])) for k, kind in enumerate(kinds)])
    after = F.coalesce(*[F.when(number == k, words) for k, words in afterwards.items()], pick((" and", '"', "", ".", " les"), "z"))
    made = spark.range(0, rows, 1, 1)
    return made.select(choose(0).alias("candidate"), choose(1).alias("before"), after.alias("after"), choose(2).alias("is_secret"))


def train(findings: DataFrame, trees: int = 24, depth: int = 7, seed: int = 11) -> list[str]:
    """The trees of a random forest over ``findings``, as SQL for the array ``f`` of features; each gives 0.0 or 1.0."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    f = features(F.col("candidate"), F.col("before"), F.col("after"))
    rows = findings.select(array_to_vector(f).alias("features"), F.col("is_secret").cast("double").alias("label"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="5").fit(rows)
    return [_tree_sql(t.toDebugString) for t in model.trees]


def _tree_sql(text: str) -> str:
    """A tree's printed form as nested CASE."""
    lines = iter([x.strip() for x in text.split("\n")[1:] if x.strip()])

    def node() -> str:
        line = next(lines)
        if m := re.match(r"Predict: ([-\d.E]+)", line):
            return f"{float(m[1])}D"
        feature, bound = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", line).groups()
        low = node()
        next(lines)  # Else
        return f"CASE WHEN f[{feature}] <= {float(bound)!r}D THEN {low} ELSE {node()} END"

    return node()


_FORESTS: dict[int, list[str]] = {}


def forest(spark: SparkSession) -> list[str]:
    """The forest of the built-in labelled findings; trained once a process."""
    if TRAINING_ROWS not in _FORESTS:
        _FORESTS[TRAINING_ROWS] = train(labelled_findings(spark))
    return _FORESTS[TRAINING_ROWS]


def _let(value: Column, then) -> Column:
    """``then(value)``, with ``value`` worked out once."""
    return F.transform(F.array(value), then)[0]


def _vote(tree: str, f: Column) -> Column:
    """A tree's vote on the array ``f``."""
    words = iter(tree.split())

    def node() -> Column:
        word = next(words)
        if word != "CASE":
            return F.lit(float(word.rstrip("D")))
        _, feature, _, bound, _ = (next(words) for _ in range(5))  # WHEN f[k] <= b THEN
        low = node()
        next(words)  # ELSE
        high = node()
        next(words)  # END
        return F.when(f[int(feature[2:-1])] <= float(bound.rstrip("D")), low).otherwise(high)

    return node()


_FOUND = "array<struct<start: int, length: int, candidate: string, score: double>>"


def _scan(text: Column, trees: list[str]) -> Column:
    """struct of pieces and found for a text that isn't null."""
    mark = F.concat(F.lit("\x01"), F.md5(text.cast("binary")), F.lit("\x02"))
    # pieces and candidates by turns, from a piece to a piece
    parts = _let(mark, lambda m: F.split(F.regexp_replace(text, F.lit(CANDIDATE), F.concat(m, F.lit("$0"), m)), m, -1))

    def of(ps: Column) -> Column:
        n = F.floor(F.size(ps) / 2).cast("int")
        each = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        ends = F.aggregate(ps, F.array(F.lit(0)), lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + F.length(p)))

        def one(i: Column, at: Column) -> Column:
            hit = F.get(ps, 2 * i + 1)
            share = _let(features(hit, F.get(ps, 2 * i), F.get(ps, 2 * i + 2)), lambda f: reduce(Column.__add__, [_vote(t, f) for t in trees]) / float(len(trees)))
            return F.struct(F.get(at, 2 * i + 1).alias("start"), F.length(hit).alias("length"), hit.alias("candidate"), share.alias("score"))

        found = F.when(n > 0, _let(ends, lambda at: F.transform(each, lambda i: one(i, at)))).otherwise(F.array().cast(_FOUND))
        return F.struct(F.filter(ps, lambda _, i: i % 2 == 0).alias("pieces"), found.alias("found"))

    return _let(parts, of)


def scanned(docs: DataFrame, trees: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` in ``row``, with ``pieces`` (text between candidates) and ``found``, an array
    of (start, length, candidate, score): start in code points from 0, score the share of votes."""
    trees = trees if trees is not None else forest(docs.sparkSession)
    scan = _scan(F.coalesce(F.col("row.text"), F.lit("")), trees)
    return packed(docs).select("row", scan.alias("scan")).select("row", "scan.pieces", "scan.found")


def findings(docs: DataFrame, trees: list[str] | None = None) -> DataFrame:
    """doc_id, start, length, candidate, score, is_secret: a row for each candidate."""
    # an inner explode would have Spark infer a filter on the array, and with it scan each text three times
    rows = scanned(docs.select("doc_id", "text"), trees).select("row.doc_id", F.explode_outer("found").alias("x")).where("x is not null")
    return rows.select("doc_id", "x.start", "x.length", "x.candidate", "x.score", (F.col("x.score") >= 0.5).alias("is_secret"))


def redacted(docs: DataFrame, trees: list[str] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets replaced by ``mark``; no row goes, and ``n_chars``, if any, follows the text."""
    parts = F.zip_with("pieces", "found", lambda p, x: F.concat(p, F.coalesce(F.when(x["score"] >= 0.5, F.lit(mark)).otherwise(x["candidate"]), F.lit(""))))
    rows = scanned(docs, trees).withColumn("changed", F.exists("found", lambda x: x["score"] >= 0.5))
    rows = rows.withColumn("new", F.when(F.col("changed"), F.array_join(parts, "")))
    new = {"text": F.coalesce("new", "row.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("changed"), F.length("new").cast("long")).otherwise(F.col("row.n_chars"))
    return unpacked(rows, docs.columns, **new)
