"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A record is a JSON object. Its fingerprint is the SHA-256 of its sorted field paths
(array items share the path ``[]``). ``MAPPINGS`` names, for the paths of each known
layout, where turns, roles and texts lie; nothing in the code knows a layout. A fingerprint that
no mapping has selects the mapping with most paths among those whose paths it holds all, so
further fields do no harm; a task settles that once a fingerprint. A record that no mapping
fits is one row with a null role and its status: ``known`` and ``rejects`` part the two.

The template marks each turn by its role and escapes control strings inside texts by a
backslash after their first character (a backslash is doubled), which ``unescape`` undoes.
The loss mask covers the texts of ``assistant`` turns.

A conversation's rows are sorted within one task and stream through it, a turn at a
time: SHA-256 over a conversation is sequential, so the turns of one conversation must
pass one task, but no more than one turn is held.

Defined cases: a null text is empty; a null role is the empty role; a record without turns,
null or unreadable JSON included, is a reject; a null turn comes
last; a null conv_id is a conversation of its own; equal turn numbers are ordered by
their place in the record, role and text; repeated rows are repeated turns; an empty
table gives an empty result; columns that a mapping doesn't name are not used.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Layouts: ``paths`` are all field paths of a record; ``turns`` is the path of an array of
#: turns (or none), ``role`` and ``text`` lie in a turn; ``pairs`` lists (role, path).
MAPPINGS = (
    {"name": "row", "paths": ["conv_id", "turn", "role", "text"], "role": "role", "text": "text", "number": "turn", "verbatim": True},
    {"name": "messages", "paths": ["conv_id", "messages", "messages[]", "messages[].content", "messages[].role"], "turns": "messages", "role": "role", "text": "content"},
    {"name": "messages-only", "paths": ["messages", "messages[]", "messages[].content", "messages[].role"], "turns": "messages", "role": "role", "text": "content"},
    {"name": "from-value", "paths": ["conversations", "conversations[]", "conversations[].from", "conversations[].value"], "turns": "conversations", "role": "from", "text": "value"},
    {"name": "from-value-id", "paths": ["conversations", "conversations[]", "conversations[].from", "conversations[].value", "id"], "turns": "conversations", "role": "from", "text": "value"},
    {"name": "instruction", "paths": ["instruction", "output"], "pairs": [["user", "instruction"], ["assistant", "output"]]},
    {"name": "instruction-input", "paths": ["input", "instruction", "output"], "pairs": [["user", ["instruction", "input"]], ["assistant", "output"]]},
    {"name": "prompt", "paths": ["completion", "prompt"], "pairs": [["user", "prompt"], ["assistant", "completion"]]},
    {"name": "prompt-response", "paths": ["prompt", "response"], "pairs": [["user", "prompt"], ["assistant", "response"]]},
    {"name": "system-prompt", "paths": ["prompt", "response", "system"], "pairs": [["system", "system"], ["user", "prompt"], ["assistant", "response"]]},
    {"name": "question", "paths": ["answer", "question"], "pairs": [["user", "question"], ["assistant", "answer"]]},
    {"name": "nested", "paths": ["data", "data.messages", "data.messages[]", "data.messages[].content", "data.messages[].role"], "turns": "data.messages", "role": "role", "text": "content"},
)
#: Why a record is none: no mapping; no JSON, too deeply nested, or not text in Unicode; a turn's number that is no integer of 64 bits.
REJECTS = ("unknown", "unreadable", "turn")
#: Other names of the three roles, in layouts that don't keep roles as they are (``verbatim``).
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
#: Opening and closing marks by role; any other role is named in its opening mark.
MARKS = {"user": ("[INST] ", " [/INST]\n"), "assistant": ("<s> ", " </s>\n"), "system": ("<<SYS>>\n", "\n<</SYS>>\n")}
OTHER = ("[ROLE] ", " [/ROLE] ", " [/TURN]\n")
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("layout", pa.string())])


def paths(value: object, at: str = "") -> set[str]:
    """Field paths of a JSON value."""
    out: set[str] = set()
    if isinstance(value, dict):
        for k, v in value.items():
            name = f"{at}.{k}" if at else k
            out |= {name} | paths(v, name)
    elif isinstance(value, list):
        for v in value:
            out |= {f"{at}[]"} | paths(v, f"{at}[]")
    return out


def fingerprint(names: set[str] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()


def _at(value: object, path: str) -> object:
    for k in path.split("."):
        value = value.get(k) if isinstance(value, dict) else None
    return value


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def mapped(value: dict, mapping: dict) -> list[tuple[int | None, str, str]]:
    """(number, role, text) of the record's turns as its mapping says."""
    if "pairs" in mapping:
        got = [(role, [_text(_at(value, p)) for p in (where if isinstance(where, list) else [where])]) for role, where in mapping["pairs"]]
        return [(k, role, "\n".join(x for x in parts if x) if len(parts) > 1 else parts[0]) for k, (role, parts) in enumerate(got)]
    rows = _at(value, mapping["turns"]) if "turns" in mapping else [value]
    number = lambda k, x: _at(x, mapping["number"]) if "number" in mapping else k
    names = {} if mapping.get("verbatim") else ROLES
    role = lambda x: names.get(r := _text(_at(x, mapping["role"])), r)
    return [(number(k, x), role(x), _text(_at(x, mapping["text"]))) for k, x in enumerate(rows or [])]


def canonical_turns(records: DataFrame, mappings: tuple[dict, ...] = MAPPINGS) -> DataFrame:
    """conv_id, turn, place, role, text, layout from ``records`` (conv_id, json)."""
    exact = {fingerprint(m["paths"]): m for m in mappings}  # ties above go to the first mapping

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen: dict[str, dict | None] = dict(exact)

        def choose(value: object) -> dict | None:
            found = paths(value)
            mark = fingerprint(found)
            if mark not in chosen:
                if len(chosen) > 10_000:
                    chosen.clear()
                    chosen.update(exact)
                chosen[mark] = max((m for m in mappings if found.issuperset(m["paths"])), key=lambda m: len(m["paths"]), default=None)
            return chosen[mark]

        def read(text: str | None) -> tuple[list[tuple[int | None, str, str]], str]:
            """A record's turns and its layout, or none and why."""
            try:
                value = json.loads(text) if text is not None else None
                mapping = choose(value) if isinstance(value, dict) else None
                if mapping is None:
                    return [], "unknown" if value is not None else "unreadable"
                found = [(int(n) if isinstance(n, float) and n.is_integer() else n, role, body) for n, role, body in mapped(value, mapping)]
                for _, role, body in found:
                    (role + body).encode()  # half of a surrogate pair is no text
            except (ValueError, RecursionError):
                return [], "unreadable"
            if any(n is not None and (type(n) is not int or abs(n) >= 1 << 63) for n, _, _ in found):
                return [], "turn"
            return found, mapping["name"]

        for batch in batches:
            rows = []
            for conv_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, layout = read(text)
                rows += [(conv_id, None, 0, None, text, layout)] if layout in REJECTS else [(conv_id, n, k, role, body, layout) for k, (n, role, body) in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TURNS.types, strict=True)] if rows else [pa.array([], t) for t in _TURNS.types], schema=_TURNS)

    return records.select(F.col("conv_id").cast("long"), "json").mapInArrow(turns, "conv_id long, turn long, place long, role string, text string, layout string")


def known(turns: DataFrame) -> DataFrame:
    """The turns of records that a mapping fits."""
    return turns.where(~F.col("layout").isin(*REJECTS))


def rejects(turns: DataFrame) -> DataFrame:
    """conv_id, json and why (see ``REJECTS``) of the records that no mapping fits."""
    return turns.where(F.col("layout").isin(*REJECTS)).select("conv_id", F.col("text").alias("json"), F.col("layout").alias("why"))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn in the template, and where in it the loss mask begins and ends (equal: none)."""
    start, end = MARKS[role] if role in MARKS else (OTHER[0] + escape(role) + OTHER[1], OTHER[2])
    body = escape(text)
    span = (len(start), len(start) + len(body)) if role == "assistant" else (0, 0)
    return start + body + end, *span


def parse_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns in formatted text; raises ValueError where there is none."""
    at = 0
    while at < len(text):
        for role, (start, end) in MARKS.items():
            if text.startswith(start, at):
                at += len(start)
                break
        else:
            if not text.startswith(OTHER[0], at):
                raise ValueError("no turn begins here")
            stop = text.index(OTHER[1], at + len(OTHER[0]))
            role, at, end = unescape(text[at + len(OTHER[0]) : stop]), stop + len(OTHER[1]), OTHER[2]
        stop = text.index(end, at)
        yield role, unescape(text[at:stop])
        at = stop + len(end)


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, seq, formatted, loss_start, loss_end: a row for each turn, in order.

    A conversation's text is its ``formatted`` in order of ``seq``; the loss mask's bounds
    are places in that row. Rows of a conversation lie together and in order.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq = object(), 0
        for batch in batches:
            rows = []
            for conv_id, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                now, seq = conv_id, seq + 1 if conv_id == now else 0
                rows.append((conv_id, seq, *format_turn(role, text)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    turns = turns.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn", "place")
    order = ("conv_id", F.col("turn").asc_nulls_last(), "place", "role", "text")
    return turns.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(write, "conv_id long, seq long, formatted string, loss_start long, loss_end long")


def digests(rows: DataFrame) -> DataFrame:
    """Read formatted rows back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars a conversation.

    ``rows`` must lie as ``formatted`` leaves them.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None  # now: a conv_id, which may be null
        done: list[tuple] = []

        def close() -> None:
            if state:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for conv_id, text, low, high in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if conv_id != now or state is None:
                    close()
                    now, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                if high > low:
                    loss = unescape(text[low:high])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(text)
            if len(done) > 1000:
                yield batch_of(done)
                done.clear()
        close()
        if done:
            yield batch_of(done)

    return rows.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
