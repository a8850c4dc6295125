"""Chat formatting from event logs: partition by conversation, sort by sequence, fold, render.

An event has a conversation, a sequence, a message, a kind, a role and a text:

* `start`       begins the message with its role, after all messages begun so far;
* `delta`       appends its text to the message;
* `edit`        puts its text in the place of the message's text;
* `regenerate`  empties the message and takes back every message begun after it.

Events of one conversation go to one task, sorted there (Spark's sort spills), and are folded
in a stream, so that a task holds no more than the messages of one conversation. The
messages that are left are rendered as turns:

    ### role
    text</turn>

with `\\` before each `\\`, `###` and `</turn>` inside a text, and before these and line
feeds inside a role. Reading from the left undoes this, so every text comes back as it was.
`loss` lists the places of the assistant's texts in the rendered string, in code points.

Defined results: a null text is empty; a null role is empty; a delta, edit or
regeneration of a message that was not begun (or was taken back) begins it with the
event's role; an unknown or null kind changes nothing; events with a null conversation
form one of their own; equal sequences are ordered by message, kind and text; a
conversation whose messages were all taken back, or that has no events but unknown ones,
is an empty string with no turns. An empty log gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "### ", "</turn>"
ASSISTANT = "assistant"
_TEXT = re.compile(r"\\|###|</turn>")
_ROLE = re.compile(r"\\|\n|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|\n|###|</turn>)")
#: One turn: a role up to its line feed, a text up to its end mark; escapes are taken as pairs.
_TURN = re.compile(
    r"### ((?:[^\\\n]|\\\\|\\\n|\\###|\\</turn>)*)\n((?:[^\\<]|<(?!/turn>)|\\\\|\\###|\\</turn>)*)</turn>\n"
)
#: Characters of rendered texts in one batch of results.
BATCH_CHARS = 1 << 24


def escape(text: str, control: re.Pattern = _TEXT) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


class Conversation:
    """The messages of one conversation while its events are folded."""

    def __init__(self) -> None:
        self.messages: dict = {}

    def apply(self, message, kind: str | None, role: str | None, text: str | None) -> None:
        if kind not in ("start", "delta", "edit", "regenerate"):
            return
        if kind == "start":
            self.messages.pop(message, None)
        if message not in self.messages:
            self.messages[message] = (role or "", [])
        pieces = self.messages[message][1]
        if kind == "regenerate":
            while next(reversed(self.messages)) != message:
                self.messages.popitem()
        if kind in ("edit", "regenerate"):
            pieces.clear()
        if kind != "regenerate" and text:
            pieces.append(text)

    def turns(self) -> list[tuple[str, str]]:
        return [(role, "".join(pieces)) for role, pieces in self.messages.values()]


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the places of the assistant's texts in it."""
    out, loss, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"{START}{escape(role, _ROLE)}\n", escape(text), f"{END}\n"
        if role == ASSISTANT:
            loss.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(out), loss


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered string."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _fold(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    ids, texts, losses, counts, chars = [], [], [], [], 0
    now = current = None

    def finish():
        nonlocal chars
        turns = current.turns()
        text, loss = render(turns)
        ids.append(now)
        texts.append(text)
        losses.append([{"start": s, "end": e} for s, e in loss])
        counts.append(len(turns))
        chars += len(text)

    def flush():
        nonlocal chars
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, texts, losses, counts), schema)], schema=schema)
        for c in (ids, texts, losses, counts):
            c.clear()
        chars = 0
        return made

    for batch in batches:
        for conv, message, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "message", "kind", "role", "text"))):
            if current is None or conv != now:
                if current is not None:
                    finish()
                    if chars >= BATCH_CHARS:
                        yield flush()
                now, current = conv, Conversation()
            current.apply(message, kind, role, text)
    if current is not None:
        finish()
    yield flush()


def format_log(events: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, formatted, loss, n_turns) of every conversation in a log of (conv_id, seq, message, kind, role, text)."""
    log = events.select(F.col(conv_id).alias("conv"), "seq", "message", "kind", "role", "text")
    id_type = log.schema["conv"].dataType
    made = T.StructType(
        [
            T.StructField(conv_id, id_type),
            T.StructField("formatted", T.StringType()),
            T.StructField("loss", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))),
            T.StructField("n_turns", T.LongType()),
        ]
    )
    id_arrow = pa.from_numpy_dtype("int64") if isinstance(id_type, (T.LongType, T.IntegerType)) else pa.string()
    if isinstance(id_type, T.IntegerType):
        id_arrow = pa.int32()
    schema = pa.schema(
        [
            (conv_id, id_arrow),
            ("formatted", pa.string()),
            ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ("n_turns", pa.int64()),
        ]
    )
    ordered = log.repartition("conv").sortWithinPartitions("conv", "seq", "message", "kind", "text")
    return ordered.drop("seq").mapInArrow(lambda batches: _fold(batches, schema), made)


def turn_log(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The log of finished conversations as a chat service would have written it.

    A user's message comes in part and is then edited to its whole text. Any other comes in
    part, is generated anew and comes whole, in two pieces. Rows are ordered by turn (null
    first), then by role and a hash of the text; repeated rows stay.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    half = F.floor(F.length(whole) / 2).cast("int")
    first, rest = F.substring(whole, F.lit(1), half), F.substring(whole, half + 1, F.length(whole))

    def event(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("text"))

    begun = [event("start", F.lit("")), event("delta", first)]
    user = F.array(*begun, event("edit", whole))
    other = F.array(*begun, event("regenerate", F.lit("")), event("delta", first), event("delta", rest))
    message = F.monotonically_increasing_id()
    named = rows.select(
        F.col(conv_id).alias("conv_id"),
        message.alias("message"),
        F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.xxhash64(whole).alias("hash")).alias("place"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.when(F.col(role) == "user", user).otherwise(other).alias("events"),
    )
    each = named.select("conv_id", "message", "place", "role", F.posexplode("events").alias("step", "event"))
    seq = F.struct("place", "message", "step").alias("seq")
    return each.select("conv_id", seq, "message", "event.kind", "role", "event.text")


@F.pandas_udf(
    T.StructType().add("n_turns", "long").add("turns_sha256", "string").add("loss_chars", "long").add("loss_sha256", "string").add("formatted_chars", "long")
)
def read_back(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Digests of the turns and of the text under the loss mask, from the rendered strings."""
    for texts, losses in batches:
        out = []
        for formatted, loss in zip(texts, losses):
            turns = parse(formatted)
            whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            under = [unescape(formatted[span["start"] : span["end"]]) for span in loss]
            digest = hashlib.sha256("".join(under).encode()).hexdigest()
            out.append((len(turns), whole, sum(map(len, under)), digest, len(formatted)))
        yield pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
