"""Event-sourced chat reconstruction and rendering.

A log holds events (conv_id, seq, event, message, role, text); seq orders all events of a conversation, and every
event names the message that it is about. In order of seq, `start` opens a message with a role and text, `delta`
appends streamed text, `edit` replaces the text, however many messages have come since, and `regenerate` drops
the text, so that later deltas write it anew, and takes back all messages started since. Delivery may be out of
order and repeated.

The log is partitioned by conversation twice. Which messages stand is decided on starts and regenerations alone,
without texts, by a running minimum. Texts are folded by (conversation, message) in order of seq, so that a
conversation with very many messages spreads over tasks; then the rendered messages are sorted by conversation
and place, and stream through running digests, one message in memory. A conversation's digest is sequential by
its definition and is made in one task.

Template, one segment per message:  <|turn|>ROLE<|text|>TEXT<|end|>  and a line feed. Inside roles and
texts a backslash is doubled and every character that begins one of CONTROLS gets a backslash after it, so that
none of them can occur there; unescape() reverses this exactly. Only the text of assistant messages bears loss.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepared, trimmed

#: Strings that steer a model or a template; none of them has a backslash for its second character.
CONTROLS = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_FIRST = "".join(re.escape(c) for c in sorted({c[0] for c in CONTROLS} | {"\\"}))
_SEGMENT = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.DOTALL)
_ESCAPE = re.compile(f"[{_FIRST}]")
_UNESCAPE = re.compile(rf"([{_FIRST}])\\")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A segment and the start and end of its loss-bearing characters (equal: none)."""
    head = f"<|turn|>{escape(role)}<|text|>"
    body = escape(text)
    loss = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return f"{head}{body}<|end|>\n", *loss


MESSAGE = "conv_id long, message long, place long, segment string, loss_from long, loss_to long"


class _Message:
    """One message's events in order of seq; `place` comes first and says where the message stands, if it does."""

    def __init__(self, conv: int | None, message: int | None):
        self.key, self.place, self.role, self.parts, self.last = (conv, message), None, None, [], None

    def add(self, event: str, seq: int, role: str | None, text: str | None) -> None:
        if event == "place":
            self.place = seq
        elif seq == self.last or self.role is None and event != "start":
            return
        elif event == "start":
            if self.role is None:
                self.role, self.parts = role or "", [text or ""]
        elif event == "delta":
            self.parts.append(text or "")
        elif event == "edit":
            self.parts = [text or ""]
        elif event == "regenerate":
            self.parts = []
        if event != "place":
            self.last = seq

    def rows(self) -> list[tuple]:
        if self.place is None or self.role is None:
            return []
        return [(*self.key, self.place, *render(self.role, "".join(self.parts)))]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, message, placed, seq, event, role, text) sorted by message, `place` before events, and by seq."""
    names = [x.split()[0] for x in MESSAGE.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2
    now: _Message | None = None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names)

    for batch in batches:
        out: list[tuple] = []
        for conv, message, _, seq, event, role, text in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if now is None or now.key != (conv, message):
                out += now.rows() if now else []
                now = _Message(conv, message)
            now.add(event, seq, role, text)
        if out:
            yield batch_of(out)
    yield batch_of(now.rows() if now else [])


def standing(events: DataFrame) -> DataFrame:
    """(conv_id, message, seq) of the first start of each message that no regeneration takes back.

    A regeneration at r of a message started at s takes back every message whose start lies between s and r. So a
    message stands unless, among the regenerations after its start, the least s lies before it.
    """
    starts = events.where("event = 'start'").groupBy("conv_id", "message").agg(F.min("seq").alias("seq"))
    again = events.where("event = 'regenerate'").select(F.col("conv_id").alias("c"), F.col("message").alias("m"), F.col("seq").alias("r"))
    same = starts["conv_id"].eqNullSafe(again["c"]) & starts["message"].eqNullSafe(again["m"])
    cuts = starts.join(again, same).where("r > seq").select("conv_id", F.lit(None).cast("long").alias("message"), F.col("r").alias("at"), F.col("seq").alias("since"))
    rows = starts.select("conv_id", "message", F.col("seq").alias("at"), F.lit(None).cast("long").alias("since")).unionByName(cuts)
    later = Window.partitionBy("conv_id").orderBy(F.desc("at"), "since").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("least", F.min("since").over(later)).where("since is null and (least is null or least >= at)")
    return rows.select("conv_id", "message", F.col("at").alias("seq"))


def messages(events: DataFrame) -> DataFrame:
    """One row per standing message: conv_id, message, place, segment, loss_from, loss_to (code points of the segment).

    place is the seq of the message's start and orders a conversation. Events before a message's start, of
    unknown kinds, with a null seq, and further starts don't count; a message without a start is left out.
    Events of one message with one seq are one delivery, of which the first by event and text counts. A
    regeneration cuts whether or not its own message was taken back before. Null texts and roles are empty; null
    keys group together. An empty log gives no rows; other columns are not read.
    """
    key = ["conv_id", "message"]
    events = events.select(*(F.col(k).cast("long").alias(k) for k in [*key, "seq"]), "event", "role", "text").where("seq is not null")
    none = F.lit(None).cast("string")
    placed = standing(events).select(*key, F.lit(0).alias("placed"), "seq", F.lit("place").alias("event"), none.alias("role"), none.alias("text"))
    rows = placed.unionByName(events.select(*key, F.lit(1).alias("placed"), "seq", "event", "role", "text"))
    prepared(rows.sparkSession)
    rows = rows.repartition(*key).sortWithinPartitions(*key, "placed", "seq", "event", "text")
    return rows.mapInArrow(trimmed(_fold), MESSAGE)


class _Digest:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.n_loss = self.n_formatted = 0

    def add(self, segment: str, a: int, b: int) -> None:
        """Reads a segment back: role and text from the template, loss-bearing text from the mask."""
        found = _SEGMENT.fullmatch(segment)
        role, text, loss = unescape(found[1]), unescape(found[2]), unescape(segment[a:b])
        self.turns.update(f"{role}\n{text}\n".encode())
        self.loss.update(loss.encode())
        self.n += 1
        self.n_loss += len(loss)
        self.n_formatted += len(segment)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, place, message, segment, loss_from, loss_to) sorted by conversation and place."""
    now, state, rows = None, None, []

    def close() -> None:
        if state:
            rows.append((now, state.n, state.turns.hexdigest(), state.n_loss, state.loss.hexdigest(), state.n_formatted))

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], [x.split()[0] for x in DIGEST.split(", ")])
        rows.clear()
        return out

    for batch in batches:
        for conv, segment, a, b in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5)), strict=True):
            if state is None or conv != now:
                close()
                now, state = conv, _Digest()
            state.add(segment, a, b)
        if rows:
            yield flush()
    close()
    yield flush()


def report(rendered: DataFrame) -> DataFrame:
    """Reads rendered messages back: one row per conversation, with digests of its turns and of the text under the loss mask."""
    prepared(rendered.sparkSession)
    return rendered.select("conv_id", "place", "message", "segment", "loss_from", "loss_to").repartition("conv_id").sortWithinPartitions("conv_id", "place", "message").mapInArrow(trimmed(_digests), DIGEST)


#: Numbers of one message's events in a log that log_of writes: two for each.
_EVENTS = 1 << 22


def log_of(turns: DataFrame, chunk: int = 512) -> DataFrame:
    """The event log of finished turns (conv_id, turn, role, text), as a client would have written it.

    Messages are numbered by turn; rows of one turn of a conversation are messages of their own, ordered by role and
    text (null first). Assistant turns are streamed: a start, a first draft of at most 16 characters, another message
    that follows the draft, a regeneration, which takes that message back, and deltas of at most `chunk`
    characters. Other turns start empty and are edited to their text after the next message has begun. Every
    third message's start is delivered twice.
    """
    sizes = turns.groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("copy", copy)
    rows = rows.join(sizes, rows["conv_id"].eqNullSafe(sizes["c"]) & rows["turn"].eqNullSafe(sizes["t"])).withColumn("message", F.col("base") + F.col("copy"))
    own, at = F.col("message"), F.col("message") * _EVENTS
    # An even seq for what a message's own client writes and an odd one for late edits: no two events have one seq.
    event = lambda kind, text, seq, message=own, role=F.col("role"): F.struct(
        seq.cast("long").alias("seq"), F.lit(kind).alias("event"), message.alias("message"), role.alias("role"), text.alias("text")
    )
    empty = F.lit("")
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    streamed = F.concat(
        F.array(
            event("start", empty, at), event("delta", F.substring("text", 1, 16), at + 2),
            event("start", F.lit("taken back"), at + 4, -own, F.lit("user")), event("regenerate", empty, at + 6),
        ),
        F.transform(pieces, lambda x, i: event("delta", x, at + 8 + 2 * i)),
    )
    edited = F.array(event("start", empty, at), event("edit", F.col("text"), at + _EVENTS + 1))
    log = F.when(F.col("role") == "assistant", streamed).otherwise(edited)
    log = F.when(own % 3 == 0, F.concat(log, F.slice(log, 1, 1))).otherwise(log)
    return rows.select("conv_id", F.explode(log).alias("e")).select("conv_id", "e.*")
