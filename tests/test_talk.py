"""The conversation stream against the same turns as a table, over restarts, replays and time-outs."""

from __future__ import annotations

import numpy as np
import pandas as pd

from gleaner.streaming import talk as TK


def rows_of(frame):
    return sorted(map(tuple, frame.select("conv_id", "turn", "n_history", "dropped", "budget", "prompt").collect()))


def test_stream_equals_table(spark, tmp_path):
    """Turns in three deliveries, out of order inside each; a repeated delivery changes nothing; the query is stopped and restarted."""
    random = np.random.default_rng(0)
    turns = []
    for conv in range(20):
        for turn in range(int(random.integers(1, 14))):
            words = " ".join(f"w{int(x)}" for x in random.integers(0, 50, int(random.choice([0, 3, 40, 130, 300], p=[0.1, 0.5, 0.2, 0.15, 0.05]))))
            turns.append((conv, turn, ["user", "assistant", None, "system"][int(random.choice(4, p=[0.5, 0.4, 0.05, 0.05]))], words if random.random() > 0.05 else None))
    turns = [(c, t, r, (x or "") + " list all of them" if c % 5 == 0 else x) for c, t, r, x in turns]
    table = spark.createDataFrame(turns, TK.TURNS)
    root = f"file://{tmp_path}"
    for low, high in ((0, 3), (3, 4), (3, 4), (4, 99)):  # the second one twice
        part = table.where(f"turn >= {low} and turn < {high}").repartition(2)
        part.write.mode("append").json(f"{root}/in")
        TK.serve(spark, f"{root}/in", f"{root}/out", f"{root}/state", 2).awaitTermination()
    got, want = rows_of(spark.read.parquet(f"{root}/out")), rows_of(TK.prompts_of(table))
    assert got == want and any(r[3] for r in got) and any(r[2] == 6 for r in got) and any(r[4] is None for r in got)
    assert {160, 260} & {r[4] for r in got}


class State:
    def __init__(self, value=None, out=False):
        self.value, self.hasTimedOut, self.timeout = value, out, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_state_is_bounded_and_times_out():
    batch = pd.DataFrame([(1, t, "user" if t % 2 else "assistant", f"m{t}", 5) for t in (3, 1, 2, 9, 8, 7, 4)], columns=["conv_id", "turn", "role", "text", "n"])
    state = State()
    out = pd.concat(TK._step((1,), iter([batch[:4], batch[4:]]), state))
    assert out["turn"].tolist() == [1, 3, 7, 9] and [len(h) for h in out["history"]] == [0, 2, 4, 6] and out["past"].tolist() == [0, 10, 20, 30]
    assert state.value[0] == 9 and state.value[1].count("m") == 6 and state.timeout == TK.FORGOTTEN_MS
    assert pd.concat(TK._step((1,), iter([batch]), state)).empty  # seen before
    state.hasTimedOut = True
    assert list(TK._step((1,), iter([]), state)) == [] and not state.exists
