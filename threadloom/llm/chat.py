"""Chat formatting by schema fingerprints.

The nested field paths of a record (sorted, array steps as ``[]``) are hashed; the fingerprint selects a declarative
mapping that turns the record into canonical turns (role, text). Known layouts are single turns, message lists,
instruction with output, prompt with completion, and message lists whose content is a list of text parts; ``Layout`` adds more.
Records of unknown layout, and those that aren't JSON objects, are not formatted: the report counts them by conversation, so none is lost
from sight, and ``rejected`` returns them with their paths.

The template writes ``<s>[TURN role]text[/TURN]`` and so on; every ``\\``, ``<``, ``>``, ``[`` and ``]`` inside a role or
text is escaped by a backslash and a letter, so no text can make a control string and reading is exact. Loss falls on
assistant texts.

Rows are put in order of conversation and turn within partitions and streamed, one row at a time, so a conversation of any
number of turns needs constant memory. Hashes are sequential by nature, so one conversation is one task's work.
Null texts and roles are empty; null turns come first; equal turns are ordered by the role and text of their first turn, then by
the record; a null conversation is one of its own. An empty table gives an empty result. One very long text needs about
10 times its bytes in a worker. Columns other than conv_id, turn and the record are not looked at.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..skew import let

_ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g", "[": "\\o", "]": "\\c"}
_BACK = {v[1]: k for k, v in _ESCAPES.items()}
TRAINED = "assistant"


class Layout(NamedTuple):
    """Where turns are: the list to walk (or none), and (role, role's field or none, text's field) for each element."""

    over: str | None
    turns: tuple[tuple[str | None, str | None, str], ...]


LAYOUTS: dict[tuple[str, ...], Layout] = {
    ("role", "text"): Layout(None, ((None, "role", "text"),)),
    ("content", "role"): Layout(None, ((None, "role", "content"),)),
    ("messages[].content", "messages[].role"): Layout("messages", ((None, "role", "content"),)),
    ("messages[].content[].text", "messages[].content[].type", "messages[].role"): Layout("messages", ((None, "role", "content"),)),
    ("conversations[].from", "conversations[].value"): Layout("conversations", ((None, "from", "value"),)),
    ("instruction", "output"): Layout(None, (("user", None, "instruction"), (TRAINED, None, "output"))),
    ("input", "instruction", "output"): Layout(None, (("user", None, "instruction"), ("user", None, "input"), (TRAINED, None, "output"))),
    ("completion", "prompt"): Layout(None, (("user", None, "prompt"), (TRAINED, None, "completion"))),
    ("prompt", "response"): Layout(None, (("user", None, "prompt"), (TRAINED, None, "response"))),
}


def paths(record: object, at: str = "") -> set[str]:
    """All nested field paths; a list adds ``[]`` once, whatever its length."""
    if isinstance(record, dict):
        return {p for k, v in record.items() for p in paths(v, f"{at}.{k}" if at else k)}
    if isinstance(record, list):
        return {p for v in record for p in paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def fingerprint(found: object) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


_BY_PRINT = {fingerprint(p): layout for p, layout in LAYOUTS.items()}
_EMPTY_LISTS = {f"{layout.over}[]" for layout in LAYOUTS.values() if layout.over}


def _said(value: object) -> str:
    """A text, or the texts of its parts in order."""
    return "".join(part["text"] or "" for part in value) if isinstance(value, list) else str(value or "")


def canonical_turns(record: dict, mappings: dict[str, Layout] | None = None) -> list[tuple[str, str]]:
    """(role, text) of each turn of a record of any known layout."""
    found = paths(record)
    layout = (mappings or _BY_PRINT).get(fingerprint(found))
    if layout is None:
        if len(found) == 1 and found <= _EMPTY_LISTS:
            return []
        raise ValueError(f"no layout for the fields {sorted(found)}")
    elements = record[layout.over] if layout.over else [record]
    return [(role or str(x[field] or ""), _said(x[text])) for x in elements for role, field, text in layout.turns]


def read_record(source: str | None) -> tuple[list[tuple[str, str]], str | None]:
    """(turns, None) of a record's JSON, or ([], why it can't be read)."""
    try:
        return canonical_turns(json.loads(source or "")), None
    except (ValueError, KeyError, TypeError) as error:  # not JSON, or of no known layout
        return [], str(error)


def escape(text: str) -> str:
    return text.translate(_TABLE)


_TABLE = str.maketrans(_ESCAPES)


def unescape(text: str) -> str:
    head, *rest = text.split("\\\\")  # a doubled backslash first, then the others
    return "\\".join(_single(x) for x in (head, *rest))


def _single(text: str) -> str:
    head, *rest = text.split("\\")
    return head + "".join(_BACK[x[0]] + x[1:] for x in rest)


def format_turn(role: str, text: str, first: bool) -> str:
    return f"{'<s>' if first else ''}[TURN {escape(role)}]{escape(text)}[/TURN]"


def read_turns(formatted: str) -> Iterator[tuple[str, str, bool]]:
    """(role, text, whether loss falls on the text) of each turn of formatted output, or of a part of it at turn ends."""
    for turn in formatted.removeprefix("<s>").split("[/TURN]")[:-1]:
        role, _, text = turn.removeprefix("[TURN ").partition("]")
        role = unescape(role)
        yield role, unescape(text), role == TRAINED


class _Reading:
    """What has been read back of one conversation."""

    def __init__(self) -> None:
        self.n, self.chars, self.length, self.rejected = 0, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str) -> None:
        self.length += len(formatted)
        for role, text, trained in read_turns(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
            if trained:
                self.chars += len(text)
                self.loss.update(text.encode("utf-8", "replace"))

    def row(self, conversation: int | None) -> tuple:
        return conversation, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.length, self.rejected


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rejected long"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in _READ.split(", ")]


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(conversation, formatted turn or None for a rejected record, whether the conversation begins) of ordered (conv_id, record) batches, by batch."""
    seen: object = _formatted  # no conversation yet
    started = False
    for batch in batches:
        out: list[tuple] = []
        for conversation, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            new = conversation != seen
            seen, started = conversation, started and not new
            turns, reason = read_record(record)
            if reason is not None:
                out.append((conversation, None, new))
            for role, text in turns:
                out.append((conversation, format_turn(role, text, not started), new))
                started, new = True, False
            if not turns and reason is None:
                out.append((conversation, "", new))  # a record without turns
        yield out


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _formatted(batches):
        kept = [(c, text) for c, text, _ in rows if text]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*kept, strict=True)], schema=pa.schema([("conv_id", pa.int64()), ("formatted", pa.string())]))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, reading, done = None, None, []
    for rows in _formatted(batches):
        for conversation, formatted, new in rows:
            if new:
                if reading is not None:
                    done.append(reading.row(now))
                now, reading = conversation, _Reading()
            if formatted is None:
                reading.rejected += 1
            else:
                reading.add(formatted)
        if len(done) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), _KINDS, strict=True)], _NAMES)
            done = []
    if reading is not None:
        done.append(reading.row(now))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), _KINDS, strict=True)], _NAMES)


_MESSAGE = "struct<role:string,content:string>"
_FIRST = f"role string, text string, content string, messages array<{_MESSAGE}>, conversations array<struct<`from`:string,value:string>>, instruction string, prompt string"


def _first_turn(record: str) -> Column:
    """(role, text) of a record's first turn, by which records of one turn number are ordered."""

    def of(x: Column) -> Column:
        message, said = F.get(x["messages"], F.lit(0)), F.get(x["conversations"], F.lit(0))
        role = F.coalesce(x["role"], message["role"], said["from"], F.when(F.coalesce(x["instruction"], x["prompt"]).isNotNull(), "user"), F.lit(""))
        return F.struct(role.alias("role"), F.coalesce(x["text"], x["content"], message["content"], said["value"], x["instruction"], x["prompt"], F.lit("")).alias("text"))

    return let(F.from_json(record, _FIRST), of)


def _ordered(records: DataFrame) -> DataFrame:
    dealt = records.select("conv_id", "turn", "record").repartition("conv_id").withColumn("first", _first_turn("record"))
    return dealt.sortWithinPartitions("conv_id", "turn", "first", "record").select("conv_id", "record")


def turn_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, record) from rows by turn: each record the JSON of its role and text, or of a pair of turns.

    Conversations come in six layouts by their id, as a corpus of several sources would. In two of them a user's turn and the
    assistant's after it, of a later turn number, are one record: prompt with completion, instruction with output; their other turns
    are single ones.
    """
    role, text, kind = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(6))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), role, text)
    near = {f"{side}_{c}": move(v).over(order) for side, move in (("next", F.lead), ("last", F.lag)) for c, v in (("role", role), ("text", text), ("turn", F.col("turn")))}
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumns(near)
    paired = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(6)) >= 4
    asks = paired & (F.col("role") == "user") & (F.col("next_role") == TRAINED) & (F.col("next_turn") > F.col("turn"))
    answers = paired & (F.col("role") == TRAINED) & (F.col("last_role") == "user") & (F.col("turn") > F.col("last_turn"))
    message, own, said = F.struct(F.col("role").alias("role"), F.col("text").alias("content")), F.col("text"), F.col("next_text")
    record = (
        F.when(asks & (kind == 4), F.to_json(F.struct(own.alias("prompt"), said.alias("completion"))))
        .when(asks, F.to_json(F.struct(own.alias("instruction"), said.alias("output"))))
        .when(kind == 1, F.to_json(message))
        .when(kind == 2, F.to_json(F.struct(F.array(message).alias("messages"))))
        .when(kind == 3, F.to_json(F.struct(F.array(F.struct(F.col("role").alias("from"), own.alias("value"))).alias("conversations"))))
        .otherwise(F.to_json(F.struct("role", "text")))
    )
    return rows.where(~F.coalesce(answers, F.lit(False))).select("conv_id", "turn", record.alias("record"))


def _reject(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        reasons = [read_record(x)[1] for x in batch.column(2).to_pylist()]
        bad = pa.array([r is not None for r in reasons], pa.bool_())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reasons, pa.string())], ["conv_id", "turn", "record", "reason"]).filter(bad)


def rejected(records: DataFrame) -> DataFrame:
    """(conv_id, turn, record, reason) of the records that no layout fits."""
    return records.select("conv_id", "turn", "record").mapInArrow(_reject, "conv_id long, turn long, record string, reason string")


def format_conversations(records: DataFrame) -> DataFrame:
    """(conv_id, formatted): one row per turn, in order within a conversation, from (conv_id, turn, record JSON) of any known layouts."""
    return _ordered(records).mapInArrow(_format, "conv_id long, formatted string")


def conversation_report(records: DataFrame) -> DataFrame:
    """Per conversation, what its formatted output reads back as: turns, their hash, the text under the loss mask, and how many records were rejected."""
    return _ordered(records).mapInArrow(_read_back, _READ)
