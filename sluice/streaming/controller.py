"""The rate controller and live connection counts as stateful streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluice.operators.control import RateState, rate_step

DECISION = "run string, seq long, rate double, smoothed double, workers int, pause double, decision string"
STATE = "smoothed double, cooldown double, pause double, workers int, last long"


def decide(target: float, workers: int = 1, ramp: float = 0.0, seconds: int = 10):
    """The function for applyInPandasWithState: folds each run's rates, in order of seq, into its state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, last = RateState(workers=workers), -1
        if state.exists:
            sm, cool, pause, n, last = state.get
            s = RateState(sm, cool, pause, n)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, rate in zip(rows["seq"], rows["rate"], strict=True):
            if seq <= last:
                continue
            s, what = rate_step(s, seq * seconds, float(rate), target, ramp)
            last = int(seq)
            out.append((key[0], last, float(rate), s.smoothed, s.workers, s.pause, what))
        state.update((s.smoothed, s.cooldown, s.pause, s.workers, last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DECISION.split(", ")])

    return run


def controller(rates: DataFrame, target: float, workers: int = 1, ramp: float = 0.0) -> DataFrame:
    """Decisions for a stream of (run, seq, rate); the state is five numbers a run."""
    return rates.groupBy("run").applyInPandasWithState(decide(target, workers, ramp), DECISION, STATE, "append", GroupStateTimeout.NoTimeout)


def connections(messages: DataFrame) -> DataFrame:
    """Active connections and finished tasks of each run from control messages (run, msg): init, got_killed, task_done."""
    delta = F.when(F.col("msg") == "init", 1).when(F.col("msg") == "got_killed", -1).otherwise(0)
    return messages.groupBy("run").agg(F.sum(delta).alias("active"), F.count_if(F.col("msg") == "task_done").alias("done"))


def adjustments(lines: DataFrame) -> DataFrame:
    """Worker changes from lines of a control stream: whole numbers; other lines give status 400."""
    n = F.expr("try_cast(trim(value) as int)")
    return lines.select("value", n.alias("adjust"), F.when(n.isNull(), 400).when(n == 0, 409).otherwise(200).alias("status"))
