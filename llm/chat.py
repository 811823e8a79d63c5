"""Chat formatting from event logs.

A log has one event a row: ``conv_id``, ``seq`` (its order within the conversation), ``message`` (which message it
is about; messages stand in the order of this column), ``kind``, ``role`` and ``text``.

* ``delta`` appends to the message, and begins it if there is none yet;
* ``edit`` puts a new text in the place of the old one;
* ``regenerate`` empties the message and drops all that stand behind it: they answered what is gone.

A message has the last role that an event since its beginning gave it.  Events without a message and those of any
other kind change nothing.

The log is partitioned by ranges of conversation and sequence, sorted, and folded as a stream.  A conversation
that one partition holds is finished there.  One that goes over a border, however long, leaves what each partition
made of it: per message whether its text replaces or continues what came before, and the lowest message that
was regenerated.  Such parts are put together message by message, so no task ever holds a whole long conversation.

The template writes a turn as ``### role: text</turn>`` and a line feed.  A backslash goes before every control
string (backslash, ``###``, ``</turn>``) inside a text, and in a role also before colons; this is undone on reading.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.tables import cut
from llm.textops import pieces

OPEN, CLOSE = "### ", "</turn>\n"
CONTROL = re.compile(r"\\|###|</turn>")
ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
MARK = re.compile(r"\\(?:\\|###|</turn>|:)|</turn>\n|: ")
TRAINED = "assistant"
PART_CHARS = 1 << 20
DELTA_CHARS = 256


def escape(text: str, control: re.Pattern = CONTROL) -> str:
    return control.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends in it."""
    head, body = f"{OPEN}{escape(role, ROLE_CONTROL)}: ", escape(text)
    return f"{head}{body}{CLOSE}", len(head), len(head) + len(body)


def turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    begin, text = 0, None
    for m in MARK.finditer(formatted):
        if m[0] == CLOSE:
            yield unescape(formatted[begin + len(OPEN) : text - 2]), unescape(formatted[text : m.start()])
            begin, text = m.end(), None
        elif m[0] == ": " and text is None:
            text = m.end()


class Conversation:
    """What a stretch of one conversation's events makes of its messages."""

    def __init__(self):
        self.messages: dict = {}  # message: [replaces what came before, role, pieces of the text]
        self.floor = None  # all messages behind this one were dropped

    def add(self, kind: str | None, message: object, role: str | None, text: str | None) -> None:
        if message is None or kind not in ("delta", "edit", "regenerate"):
            return
        if kind == "regenerate":
            self.messages = {m: x for m, x in self.messages.items() if m < message}
            self.floor = message if self.floor is None else min(self.floor, message)
        mine = self.messages.get(message)
        if mine is None:
            new = self.floor is not None and message >= self.floor
            mine = self.messages[message] = [new, None, []]
        if kind == "edit":
            mine[0], mine[2] = True, []
        mine[1] = mine[1] if role is None else role
        if kind != "regenerate":
            mine[2].append(text or "")


def _sorted_rows(batches: Iterator[pa.RecordBatch], names: list[str], body: str) -> Iterator[tuple]:
    for b in pieces(batches, body):
        yield from zip(*(b.column(c).to_pylist() for c in names))


def fold(log: DataFrame) -> DataFrame:
    """``conv_id``, ``message``, ``role`` and ``text`` of the messages that a log's conversations end with.

    Rows without a conversation are one conversation.  Missing roles and texts are empty.  Events of the same
    ``seq`` are taken by message, kind, role and text.
    """
    names = ["conv_id", "seq", "message", "kind", "role", "text"]
    log = log.select(*names)
    conv, message = (log.schema[c].dataType for c in ("conv_id", "message"))
    schema = (
        f"conv_id {conv.simpleString()}, message {message.simpleString()}, replaces boolean, role string, text string, segment int, dropped boolean"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list = []

        def told(of: object, made: Conversation, segment: int | None) -> pa.RecordBatch:
            rows = [(of, m, x[0], x[1], "".join(x[2]), segment, False) for m, x in sorted(made.messages.items())]
            if segment is not None and made.floor is not None:
                rows.append((of, made.floor, None, None, None, segment, True))
            columns = list(zip(*rows)) or [[]] * 7
            types = [*kinds, pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.bool_()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["conv_id", "message", "replaces", "role", "text", "segment", "dropped"],
            )

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kinds[:] = [b.column(c).type for c in ("conv_id", "message")]
                yield b

        # the first and the last conversation of a partition may go over its border
        segment, first, of, made = TaskContext.get().partitionId(), True, None, None
        for conv_id, _, message, kind, role, text in _sorted_rows(seen(), names, "text"):
            if made is None or conv_id != of:
                if made is not None:
                    yield told(of, made, segment if first else None)
                    first = False
                of, made = conv_id, Conversation()
            made.add(kind, message, role, text)
        if made is not None:
            yield told(of, made, segment)

    order = ["conv_id", "seq", "message", "kind", "role"]
    tie = F.xxhash64("text")
    folded = log.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie, "text").mapInArrow(run, schema)
    folded = cut(folded)
    done = folded.where("segment is null").select("conv_id", "message", "role", "text")
    parts = folded.where("segment is not null")
    # at most two rows a partition, whatever the log holds
    floors = parts.where("dropped").select(
        F.col("conv_id").alias("of"), F.col("message").alias("floor"), F.col("segment").alias("later")
    )
    gone = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("later") > F.col("segment")) & (F.col("floor") <= F.col("message"))
    parts = parts.where("not dropped").join(F.broadcast(floors), gone, "left_anti")
    parts = parts.groupBy("conv_id", "message").agg(
        F.array_sort(F.collect_list(F.struct("segment", "replaces", "role", "text"))).alias("parts")
    )
    last = F.expr(
        "aggregate(parts, named_struct('role', cast(null as string), 'text', array('')), (a, x) -> named_struct("
        "'role', coalesce(x.role, a.role), 'text', if(x.replaces, array(x.text), concat(a.text, array(x.text)))))"
    )
    parts = parts.select("conv_id", "message", last.alias("last"))
    parts = parts.select("conv_id", "message", F.col("last.role").alias("role"), F.array_join("last.text", "").alias("text"))
    done = done.unionByName(parts)
    return done.select("conv_id", "message", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])


def render(messages: DataFrame, chars: int = PART_CHARS) -> DataFrame:
    """``conv_id``, ``part``, ``n_turns``, ``formatted`` and ``loss``, the spans of ``formatted`` that are learned.

    A conversation is one row, or several of about ``chars`` characters; ``part`` is the first message of a row, in
    whose order the rows follow one another.
    """
    messages = messages.select("conv_id", "message", "role", "text")
    kinds = [messages.schema[c].dataType.simpleString() for c in ("conv_id", "message")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list = []

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                types[:] = [b.column(c).type for c in ("conv_id", "message")]
                yield b

        def row(of: object, part: object, texts: list[str], loss: list[dict]) -> pa.RecordBatch:
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([of], types[0]),
                    pa.array([part], types[1]),
                    pa.array([len(texts)], pa.int64()),
                    pa.array(["".join(texts)], pa.string()),
                    pa.array([loss], span),
                ],
                names=["conv_id", "part", "n_turns", "formatted", "loss"],
            )

        of, part, texts, loss, at = None, None, [], [], 0
        for conv_id, message, role, text in _sorted_rows(seen(), ["conv_id", "message", "role", "text"], "text"):
            if texts and (conv_id != of or at >= chars):
                yield row(of, part, texts, loss)
                texts, loss, at = [], [], 0
            if not texts:
                of, part = conv_id, message
            body, lo, hi = turn(role, text)
            texts.append(body)
            if role == TRAINED:
                loss.append({"start": at + lo, "end": at + hi})
            at += len(body)
        if texts:
            yield row(of, part, texts, loss)

    ordered = messages.repartitionByRange("conv_id", "message").sortWithinPartitions("conv_id", "message")
    spans = "array<struct<start: bigint, end: bigint>>"
    return ordered.mapInArrow(run, f"conv_id {kinds[0]}, part {kinds[1]}, n_turns bigint, formatted string, loss {spans}")


def conversation_log(rows: DataFrame, chars: int = DELTA_CHARS) -> DataFrame:
    """Rows of ``conv_id``, ``turn``, ``role`` and ``text`` as the log of streaming each in deltas of ``chars`` characters.

    Every row is a message.  Those of the same turn follow in the order of role and a hash of the text, those
    without a turn come first, equal rows are as many messages.
    """
    hexed = F.lpad(F.hex(F.col("turn").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    tie = [F.hex(F.xxhash64("role")), F.hex(F.xxhash64("text")), F.hex(F.monotonically_increasing_id())]
    key = F.concat(F.coalesce(hexed, F.lit("")), *[x for t in tie for x in (F.lit("."), F.lpad(t, 16, "0"))])
    cuts = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))
    rows = rows.select("conv_id", key.alias("message"), "role", cuts.alias("cuts"))
    # an empty text is one empty delta
    rows = rows.withColumn("cuts", F.when(F.size("cuts") == 0, F.array(F.lit(""))).otherwise(F.col("cuts")))
    rows = rows.select("conv_id", "message", "role", F.posexplode("cuts").alias("n", "text"))
    seq = F.concat("message", F.lit("."), F.lpad(F.hex("n"), 8, "0"))
    return rows.select("conv_id", seq.alias("seq"), "message", F.lit("delta").alias("kind"), "role", "text")


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations, one row each; parts are streamed through, never gathered."""
    names = ["conv_id", "part", "formatted", "loss"]
    formatted = formatted.select(*names)
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list = []

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                types[:] = [b.column("conv_id").type]
                yield b

        def rows() -> Iterator[tuple]:
            of, state = None, None
            for conv_id, _, text, loss in _sorted_rows(seen(), names, "formatted"):
                if state is None or conv_id != of:
                    if state is not None:
                        yield of, *state[:1], state[3].hexdigest(), state[1], state[4].hexdigest(), state[2]
                    of, state = conv_id, [0, 0, 0, hashlib.sha256(), hashlib.sha256()]
                for role, said in turns(text):
                    state[0] += 1
                    state[3].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    state[1] += len(said)
                    state[4].update(said.encode())
                state[2] += len(text)
            if state is not None:
                yield of, *state[:1], state[3].hexdigest(), state[1], state[4].hexdigest(), state[2]

        some: list = []
        fields = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

        def table() -> pa.RecordBatch:
            columns = list(zip(*some))
            made = [pa.array(columns[0], types[0]), *(pa.array(c, t) for c, (_, t) in zip(columns[1:], fields))]
            return pa.RecordBatch.from_arrays(made, names=["conv_id", *(n for n, _ in fields)])

        for r in rows():
            some.append(r)
            if len(some) == 10_000:
                yield table()
                some.clear()
        if some:
            yield table()

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return ordered.mapInArrow(run, schema)
