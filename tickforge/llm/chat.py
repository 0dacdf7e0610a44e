r"""Op 8: chat formatting by event-sourced reconstruction.

Events (conv_id, seq, part, msg, kind, role, text) are dealt by conversation and message, sorted by seq and part and folded:
`message` opens a message with a text; `delta` appends to the text of the message that is open under its msg; `edit` replaces
the text; `regenerate` empties it, so that later deltas build it anew. Any of these opens a message where none is open. A message
has the place and role of the event that opened it. Messages are then dealt by conversation, sorted, and rendered one by one:

    <turn ROLE>\nTEXT</turn>\n

with \e, \l and \g for a backslash, < and > inside roles and texts, so markers occur only as markers. The text of each
turn of the role `assistant` is under the loss mask: [loss_from, loss_to) in code points of the formatted conversation.
Both passes stream over sorted rows, so a conversation with a third of all rows needs no more memory than a short one;
escaping happens in the first pass, which splits that conversation by message.

Null roles and texts are empty; null conv_ids are one conversation; null seqs come first; a null part is 0, a null msg is the seq,
a null kind is `message`. Events of one message with equal seq and part are taken in the order message, regenerate, edit, delta;
messages of equal seq in the order of role and text as escaped. Repeated rows of kind `message` are turns of their own. Extra
columns are left out. An empty table gives no rows. Long texts are rows as any other. `from_rows` makes such a log of whole turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<turn ", ">\n", "</turn>\n"
#: Kinds of events, as they are taken at one place of a log.
KINDS = ["message", "regenerate", "edit", "delta"]
#: Characters of a streamed piece in `from_rows`.
PIECE = 256


def escape(text: str) -> str:
    return text.replace("\\", "\\e").replace("<", "\\l").replace(">", "\\g")


def unescape(text: str) -> str:
    return text.replace("\\l", "<").replace("\\g", ">").replace("\\e", "\\")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, seq, msg, role, text) of final messages, roles and texts escaped."""
    schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("msg", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, first, parts = None, None, []
        for conv, msg, seq, _, kind, role, text in _rows(batches):
            if kind == KINDS.index("message") or key != (conv, msg):
                if first:
                    yield (*first, escape("".join(parts)))
                key, first, parts = (conv, msg), (conv, seq, msg, escape(role)), []
            if kind != KINDS.index("delta"):
                parts = []
            if kind != KINDS.index("regenerate"):
                parts.append(text)
        if first:
            yield (*first, escape("".join(parts)))

    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    part = F.coalesce(F.col("part").cast("int"), F.lit(0)) if "part" in events.columns else F.lit(0)
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.coalesce("kind", F.lit("message"))).cast("int") - 1
    dealt = events.select(F.col("conv_id").cast("long"), F.coalesce("msg", "seq").cast("long").alias("msg"), F.col("seq").cast("long"), part.alias("part"), kind.alias("kind"), empty("role").alias("role"), empty("text").alias("text"))
    dealt = dealt.repartition("conv_id", "msg").sortWithinPartitions("conv_id", "msg", "seq", "part", "kind", "role", "text")
    return dealt.mapInArrow(lambda b: _batches(messages(b), schema), "conv_id long, seq long, msg long, role string, text string")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, turn_no, formatted, loss_from, loss_to): one row a turn, in order within each partition; no row is under the mask where loss_from = loss_to."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("formatted", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64())])

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, no, at, begun = None, 0, 0, False
        for conv, _, _, role, text in _rows(batches):
            if not begun or key != conv:
                key, no, at, begun = conv, 0, 0, True
            head = OPEN + role + MIDDLE
            start = at + len(head)
            yield conv, no, head + text + CLOSE, start, start + (len(text) if role == "assistant" else 0)
            no, at = no + 1, start + len(text) + len(CLOSE)

    dealt = messages.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "role", "text", "msg")
    return dealt.mapInArrow(lambda b: _batches(turns(b), schema), "conv_id long, turn_no long, formatted string, loss_from long, loss_to long")


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold(events))


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation, unescaped."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn at {at}")
        middle = formatted.index(MIDDLE, at)
        close = formatted.index(CLOSE, middle)
        yield unescape(formatted[at + len(OPEN) : middle]), unescape(formatted[middle + len(MIDDLE) : close])
        at = close + len(CLOSE)


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of `render`'s output finds in each conversation; streams over the rows in their order."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, state = None, None
        for conv, no, text, start, stop in _rows(batches):
            if state is None or no == 0:
                if state:
                    yield key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, turn in parse(text):
                state[0] += 1
                state[1].update(f"{role}\n{turn}\n".encode())
            loss = unescape(text[start - state[4] : stop - state[4]])
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += len(text)
        if state:
            yield key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    return formatted.mapInArrow(lambda b: _batches(read(b), schema), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def from_rows(conversations: DataFrame) -> DataFrame:
    """The log behind a table of whole turns (conv_id, turn, role, text), one message a row: an assistant's text was streamed in pieces after
    a first answer that was regenerated, others' were sent and then edited to what they are. Names of messages are of this run only."""
    text, n = F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit("")))
    event = lambda part, kind, t: F.struct(part.cast("int").alias("part"), F.lit(kind).alias("kind"), t.alias("text"))
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(n / PIECE).cast("int")), lambda i: event(i + 2, "delta", F.substring(text, i * PIECE + 1, F.lit(PIECE))))
    answered = F.concat(F.array(event(F.lit(0), "message", F.substring(text, F.lit(1), (n / 2).cast("int"))), event(F.lit(1), "regenerate", F.lit(""))), pieces)
    sent = F.array(event(F.lit(0), "message", F.reverse(F.substring(text, F.lit(1), F.lit(PIECE)))), event(F.lit(1), "edit", text))
    rows = conversations.select("conv_id", F.col("turn").alias("seq"), "role", "text").withColumn("msg", F.monotonically_increasing_id())
    rows = rows.select("conv_id", "seq", "msg", "role", F.explode(F.when(F.col("role") == "assistant", answered).otherwise(sent)).alias("e"))
    return rows.select("conv_id", "seq", "e.part", "msg", "e.kind", "role", "e.text")
