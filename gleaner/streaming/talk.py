"""Conversations as a stream: the last messages of each are state, and every user message gets its prompt and token budget.

`prompts` keeps a conversation's state between micro-batches; `prompts_of` gives the same rows from a whole table, by windows. Both
count a message's tokens before, so the stateful part is only the sliding history.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.config import DEFAULT
from gleaner.functions import composing as K
from gleaner.functions import routing as G
from gleaner.functions import text as T
from gleaner.ship import ship

TURNS = "conv_id long, turn long, role string, text string"
#: Tokens of a prompt with its reply, of a message's frame, and of the system text's frame.
CONTEXT = 256
FRAME = 4
SYSTEM = "Answer briefly."
#: A conversation without a message for so long is forgotten.
FORGOTTEN_MS = 3_600_000

_PAST = "array<struct<role: string, text: string>>"
_ASKED = f"conv_id long, turn long, text string, n long, past long, history {_PAST}"


def counted(turns: DataFrame) -> DataFrame:
    """Turns with a role of two kinds and n, their tokens with the frame; rows without an id or turn number don't count."""
    role = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    rows = turns.where("conv_id is not null and turn is not null")
    text = F.coalesce("text", F.lit(""))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.size(T.tokens(text)) + FRAME).cast("long").alias("n"))


def told(asked: DataFrame, context: int = CONTEXT) -> DataFrame:
    """Of user messages (conv_id, turn, text, n, past, history) the prompt, whether the history was dropped, and the reply's tokens.

    A prompt that is longer than the context loses its whole history. The reply gets 160 tokens, or 260 if a list is asked for and
    they fit, or what is left; null if nothing is.
    """
    rows = asked.withColumn("dropped", F.col("n") + F.col("past") + FRAME >= context)
    used = F.col("n") + FRAME + F.when(F.col("dropped"), 0).otherwise(F.col("past"))
    history = F.when(F.col("dropped"), F.array().cast(_PAST)).otherwise(F.col("history"))
    none = F.array().cast("array<string>")
    most = F.when((K.token_budget(F.col("text")) == 260) & (used + 260 < context), 260).otherwise(F.least(F.lit(160), context - used - 1))
    prompt = K.prompt(SYSTEM, history, F.col("text"), none, G.mode(F.col("text")))
    return rows.select("conv_id", "turn", F.size(history).cast("long").alias("n_history"), "dropped", F.when(most > 0, most).cast("long").alias("budget"), prompt.alias("prompt"))


def _step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState, forget: bool = True) -> Iterator[pd.DataFrame]:
    """A conversation's new messages in order; a turn that isn't after the last one has been seen and is left out."""
    if state.hasTimedOut:
        state.remove()
        return
    last, held = (state.get[0], json.loads(state.get[1])) if state.exists else (None, [])
    out = []
    for row in pd.concat(parts).sort_values("turn").itertuples(index=False):
        if last is not None and row.turn <= last:
            continue
        if row.role == "user":
            out.append((row.conv_id, row.turn, row.text, row.n, sum(m[2] for m in held), [{"role": m[0], "text": m[1]} for m in held]))
        held = [*held, [row.role, row.text, int(row.n)]][-DEFAULT.history :]
        last = int(row.turn)
    if last is not None:
        state.update((last, json.dumps(held)))
        if forget:
            state.setTimeoutDuration(FORGOTTEN_MS)
    yield pd.DataFrame(out, columns=["conv_id", "turn", "text", "n", "past", "history"])


def _kept(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    return _step(key, parts, state, forget=False)


def prompts(stream: DataFrame, context: int = CONTEXT, forget: bool = True) -> DataFrame:
    """The stateful form over a stream of turns (conv_id, turn, role, text); state is at most six messages for each live conversation.

    Messages of one conversation must arrive in order of turn from batch to batch; inside a batch they may come in any. With forget, a
    conversation's state goes after FORGOTTEN_MS without a message; such a query has no end, as time-outs need further batches.
    """
    ship(stream.sparkSession)
    step, timeout = (_step, GroupStateTimeout.ProcessingTimeTimeout) if forget else (_kept, GroupStateTimeout.NoTimeout)
    asked = counted(stream).groupBy("conv_id").applyInPandasWithState(step, _ASKED, "last long, messages string", "append", timeout)
    return told(asked, context)


def prompts_of(turns: DataFrame, context: int = CONTEXT) -> DataFrame:
    """The same rows from a table of turns, of which no conversation has a turn number twice."""
    own = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-DEFAULT.history, -1)
    rows = counted(turns).withColumns({"past": F.coalesce(F.sum("n").over(own), F.lit(0)), "history": F.collect_list(F.struct("role", "text")).over(own)})
    return told(rows.where("role = 'user'"), context)


def serve(spark: SparkSession, inbox: str, outbox: str, checkpoint: str, files: int = 8, context: int = CONTEXT, every: str | None = None) -> StreamingQuery:
    """Reads JSON turns as files arrive, `files` a batch, and appends prompts as Parquet; a restart goes on from the checkpoint.

    With `every` (say "10 seconds") it goes on and forgets old conversations; without, it ends when all that is there is answered.
    """
    stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", files).json(inbox)
    out = prompts(stream, context, forget=every is not None).writeStream.format("parquet").option("path", outbox).option("checkpointLocation", checkpoint)
    return out.outputMode("append").trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
