"""Chat formatting from an event log.

A conversation is a log of events: a message starts with a role, receives deltas of text, may be
edited as a whole or generated again from nothing. Logs are partitioned by conversation and
sorted by sequence number; each task folds the events of one message after the other and renders
it, holding one message at a time however long the conversation is. The rendered text is stored
in pieces, so no row grows with a conversation either.

Template: ``<s>[INST] user text [/INST]``, ``<s>[SYS] system text [/SYS]``,
``<s>[ASSISTANT] assistant text </s>``, and ``<s>[ROLE]role[/ROLE] text </s>`` for other roles.
Inside texts a backslash is doubled, and one is put behind the first character of any control
string, which takes it apart; reading undoes both. The loss mask is the assistant's text.

Defined results: a null text is empty and a null role is the empty role; turns without number
come last; equal turn numbers are ordered by role, then text; rows that repeat are turns each;
null conv_id is a conversation of its own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_CONTROL = re.compile(r"\\|[<\[](?=/?s>|/?(?:INST|SYS|ASSISTANT|ROLE)\])")
_ESCAPED = re.compile(r"\\(\\?)")
_FRAMES = {"user": ("<s>[INST] ", " [/INST]"), "system": ("<s>[SYS] ", " [/SYS]"),
           "assistant": ("<s>[ASSISTANT] ", " </s>")}
_TURN = re.compile(
    r"<s>(?:\[INST\] (?P<user>.*?) \[/INST\]|\[SYS\] (?P<system>.*?) \[/SYS\]"
    r"|\[ASSISTANT\] (?P<assistant>.*?) </s>|\[ROLE\](?P<role>.*?)\[/ROLE\] (?P<other>.*?) </s>)",
    re.DOTALL)
#: Characters of rendered text in one stored piece, more only where one message is longer.
PIECE = 1 << 20


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> str:
    if role in _FRAMES:
        before, after = _FRAMES[role]
    else:
        before, after = f"<s>[ROLE]{escape(role)}[/ROLE] ", " </s>"
    return before + escape(text) + after


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and the place of the escaped text, of each turn of rendered text."""
    at = 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError(f"no turn at character {at}")
        at = m.end()
        kind = m.lastgroup if m.lastgroup != "role" else "other"
        role = unescape(m["role"]) if kind == "other" else kind
        yield role, unescape(m[kind]), m.start(kind), m.end(kind)
    if at != len(text):
        raise ValueError(f"no turn at character {at}")


def events_of(conversations: DataFrame) -> DataFrame:
    """A log as a chat service would leave it: ``conv_id``, ``seq``, ``message``, ``kind``,
    ``role``, ``text``. Every message starts, streams in two deltas, and by turn some are drafted
    and generated again, others streamed short and then edited whole."""
    order = Window.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(),
        F.col("text").asc_nulls_first())
    text = F.coalesce(F.col("text"), F.lit(""))
    half = (F.length(text) / 2).cast("int")
    head, rest = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))

    def event(kind: str, body) -> F.Column:
        return F.struct(F.lit(kind).alias("kind"), body.alias("text"))

    none = F.lit(None).cast("string")
    streamed = [event("delta", head), event("delta", rest)]
    again = F.array(event("start", none), event("delta", rest), event("regenerate", none),
                    *streamed)
    edited = F.array(event("start", none), event("delta", head), event("edit", text))
    plain = F.array(event("start", none), *streamed)
    k = F.pmod(F.col("message"), F.lit(3))
    return (conversations.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), "turn",
                                 "text")
            .withColumn("message", F.row_number().over(order).cast("long"))
            .select("conv_id", "role", "message", F.posexplode(
                F.when(k == 0, again).when(k == 1, plain).otherwise(edited)).alias("step", "e"))
            .select("conv_id", (F.col("message") * 8 + F.col("step")).alias("seq"), "message",
                    "e.kind", "role", "e.text"))


def _rows(batches, *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Messages (conv_id, message, role, text) from sorted events, one held at a time."""
    key, role, parts = None, "", []
    for conv, message, kind, who, text in rows:
        if key != (conv, message):
            if key is not None:
                yield *key, role, "".join(parts)
            key, role, parts = (conv, message), who or "", []
        if kind == "delta":
            parts.append(text or "")
        elif kind in ("regenerate", "start"):
            parts = []
        elif kind == "edit":
            parts = [text or ""]
    if key is not None:
        yield *key, role, "".join(parts)


def format_log(events: DataFrame) -> DataFrame:
    """Rendered conversations: ``conv_id``, ``piece`` (from 0) and ``formatted``."""
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()),
                        ("formatted", pa.string())])

    def run(batches):
        out, size = [], 0
        for row in pieces(batches):
            out.append(row)
            size += len(row["formatted"])
            if size > PIECE or len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    def pieces(batches):
        conv, begun, piece, held, size = None, False, 0, [], 0
        for c, _message, role, text in fold(_rows(batches, "conv_id", "message", "kind", "role",
                                                  "text")):
            if not begun or c != conv or size >= PIECE:
                if begun:
                    yield {"conv_id": conv, "piece": piece, "formatted": "".join(held)}
                piece = piece + 1 if begun and c == conv else 0
                conv, begun, held, size = c, True, [], 0
            held.append(render(role, text))
            size += len(held[-1])
        if begun:
            yield {"conv_id": conv, "piece": piece, "formatted": "".join(held)}

    return (events.select(F.col("conv_id").cast("long"), "seq", "message", "kind", "role", "text")
            .repartition("conv_id").sortWithinPartitions("conv_id", "seq")
            .select("conv_id", "message", "kind", "role", "text")
            .mapInArrow(run, "conv_id long, piece long, formatted string"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation from its rendered text, piece by piece."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()),
                        ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        out = []
        for row in digests(batches):
            out.append(row)
            if len(out) == 2000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    def digests(batches):
        state = None
        for conv, text in _rows(batches, "conv_id", "formatted"):
            if state is None or state["conv_id"] != conv:
                if state is not None:
                    yield done(state)
                state = {"conv_id": conv, "n_turns": 0, "turns": hashlib.sha256(),
                         "loss_chars": 0, "loss": hashlib.sha256(), "formatted_chars": 0}
            state["formatted_chars"] += len(text)
            for role, body, a, b in parse(text):
                state["n_turns"] += 1
                state["turns"].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                if role == "assistant":
                    masked = unescape(text[a:b])
                    state["loss_chars"] += len(masked)
                    state["loss"].update(masked.encode("utf-8", "surrogatepass"))
        if state is not None:
            yield done(state)

    def done(state):
        return {**{k: v for k, v in state.items() if k not in ("turns", "loss")},
                "turns_sha256": state["turns"].hexdigest(),
                "loss_sha256": state["loss"].hexdigest()}

    return (formatted.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
            .select("conv_id", "formatted").mapInArrow(
                run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                     "loss_sha256 string, formatted_chars long"))
