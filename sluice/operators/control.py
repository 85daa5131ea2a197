"""Run control as data: connections over time, schedules, ramps, quotas, and the rate controller's decisions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.ordering import running_sum

#: Fixed values of the controller: smoothing, band, overshoot, cooldown seconds, longest pause.
ALPHA, LOW, HIGH, OVERSHOOT, COOLDOWN, MAX_PAUSE = 0.4, 0.9, 1.1, 2.0, 60.0, 1.0
MAX_RETRIES = 3


def connection_deltas(events: DataFrame) -> DataFrame:
    """Connections over time from init (+1) and killed (-1) messages. events: seq (order, unique), delta.

    Rows are range-partitioned by seq; sums run within a partition and start from the sum of those before, so no task sees all rows.
    """
    return running_sum(events, "seq", "delta", "active")


def cycle_rate(report: DataFrame) -> DataFrame:
    """(window_start, rate): the rate of whole cycles in each window, 0 where none ended."""
    return report.groupBy("window_start").agg(F.coalesce(F.max(F.when(F.col("id") == "__cycle__", F.col("period_ops_s"))), F.lit(0)).cast("long").alias("rate"))


def controller_run(rates: DataFrame, target: float, workers: int = 1, ramp_s: float = 0.0, seconds: int = 10) -> DataFrame:
    """The whole controller over the ordered rates of each run (grp, seq, rate): smoothed rate, workers, pause and decision after each step.

    A run has a row each ten seconds, so its rates fit into a task; one pass, with the state carried along.
    """
    import pandas as pd

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s, out = RateState(workers=workers), []
        for seq, rate in pdf.sort_values("seq")[["seq", "rate"]].itertuples(index=False):
            s, what = rate_step(s, float(seq) * seconds, float(rate), target, ramp_s)
            out.append((key[0], seq, rate, s.smoothed, s.workers, s.pause, what))
        return pd.DataFrame(out, columns=["grp", "seq", "rate", "smoothed", "workers", "pause", "decision"])

    return rates.groupBy("grp").applyInPandas(fold, "grp string, seq long, rate double, smoothed double, workers long, pause double, decision string")


def assign_schedule(events: DataFrame, schedule: DataFrame) -> DataFrame:
    """Events (elapsed seconds) with the schedule row that covers them: (step, connections, max_rate). A schedule is a few rows."""
    ends = F.sum("duration").over(Window.partitionBy(F.lit(0)).orderBy("step"))
    rows = schedule.withColumn("to_s", ends).withColumn("from_s", F.col("to_s") - F.col("duration"))
    spans = rows.agg(F.array_sort(F.collect_list(F.struct("from_s", "to_s", "step", "connections", "max_rate"))).alias("s")).first()["s"]
    lit = F.array(*[F.struct(*[F.lit(x[k]).cast("long").alias(k) for k in ("from_s", "to_s", "step", "connections", "max_rate")]) for x in spans])
    hit = F.filter(lit, lambda s: (F.col("elapsed") >= s["from_s"]) & (F.col("elapsed") < s["to_s"]))
    return events.withColumn("hit", F.try_element_at(hit, F.lit(1))).where("hit is not null").select(*events.columns, "hit.step", "hit.connections", "hit.max_rate")


def ramp(changes: DataFrame) -> DataFrame:
    """When each started or stopped worker of a change takes effect, spread evenly over its ramp.

    changes: step, change (workers, negative to stop), ramp (seconds).
    """
    n = F.abs("change")
    rows = changes.where("change <> 0").select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return rows.select("step", F.when(F.col("change") > 0, "start").otherwise("stop").alias("action"), F.col("k").cast("long").alias("k"), (F.col("k") * F.col("ramp") / n).alias("at_s"))


def quota(iterations: int, concurrency: int) -> tuple[int, int]:
    """(workers, iterations of each): no more workers than iterations, what doesn't divide is dropped."""
    workers = min(iterations, concurrency)
    return (workers, iterations // workers) if workers > 0 else (0, 0)


def threads_per_process(threads: int, processes: int) -> list[int]:
    """How many workers each process runs, ascending."""
    q, r = divmod(threads, processes)
    return sorted([q + 1] * r + [q] * (processes - r))


def split_rows(total: int, parts: int) -> list[int]:
    """Equal shards; the last takes the remainder."""
    q, r = divmod(total, parts)
    return [*[q] * (parts - 1), q + r]


@dataclass
class RateState:
    smoothed: float = 0.0
    cooldown: float = 0.0
    pause: float = 0.0
    workers: int = 1


def rate_step(s: RateState, now: float, rate: float, target: float, ramp_s: float = 0.0) -> tuple[RateState, str]:
    """One decision of the controller: the new state and what it did."""
    sm = s.smoothed
    if rate > 0:
        sm = rate if sm == 0 else ALPHA * rate + (1 - ALPHA) * sm
    c = sm or rate
    cc, pause, cool = s.workers, s.pause, s.cooldown
    ready = now >= cool
    want, what = cc, "hold"
    if rate <= 0:
        pause = 0.0
        if ready:
            want = max(1, cc + 1)
    elif LOW * target <= c <= HIGH * target:
        pause *= 0.5
        what = "steady"
    elif c < LOW * target:
        pause = 0.0
        if ready:
            want = max(cc + 1, math.ceil(target / (c / max(1, cc))))
    else:
        pause = max(0.0, cc / target - cc / c)
        what = "pause"
        if not (c < OVERSHOOT * target and pause <= MAX_PAUSE):
            pause = min(pause, MAX_PAUSE)
            if ready and cc > 1:
                less = max(1, math.floor(target / (c / cc)))
                want = less if less < cc else cc
    if want != cc:
        what, cool = ("grow" if want > cc else "shrink"), now + COOLDOWN + ramp_s
    return RateState(sm, cool, pause, want), what


def rate_decisions(rates: DataFrame, target: float) -> DataFrame:
    """The controller folded over the ordered rates of each group (grp, seq, rate), as one expression: smoothed rate and band of each step.

    One run has one row each ten seconds, so a group's rates fit into a task; one pass with the last value carried along.
    """
    import pandas as pd

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, last, smoothed = pdf.sort_values("seq"), 0.0, []
        for rate in pdf["rate"]:
            if rate > 0:
                last = rate * ALPHA + last * (1 - ALPHA) if last else rate
            smoothed.append(last)
        return pdf[["seq", "rate"]].assign(grp=key[0], smoothed=smoothed)[["grp", "seq", "rate", "smoothed"]]

    out = rates.groupBy("grp").applyInPandas(fold, "grp string, seq long, rate double, smoothed double")
    c = F.when(F.col("smoothed") > 0, F.col("smoothed")).otherwise(F.col("rate"))
    band = F.when(F.col("rate") <= 0, "idle").when(c.between(LOW * target, HIGH * target), "steady").when(c < LOW * target, "grow").when(c < OVERSHOOT * target, "pause").otherwise("shrink")
    return out.withColumn("decision", band)


def retries(rows: DataFrame) -> DataFrame:
    """Measurements of transactions that ended before the last retry, and the retries themselves as an id of latency 0."""
    kept = rows.where(F.col("retries") < MAX_RETRIES).select("ts", "worker", "id", "latency")
    again = rows.where("retries > 0").select("ts", "worker", F.explode(F.array_repeat(F.lit("__retries__"), F.col("retries").cast("int"))).alias("id"), F.lit(0.0).alias("latency"))
    return kept.unionByName(again)


def cycles(m: DataFrame) -> DataFrame:
    """Measurements with a __cycle__ row for each worker's cycle: the sum of its functions."""
    total = m.groupBy("worker", "cycle").agg(F.max("ts").alias("ts"), F.sum("latency").alias("latency")).withColumn("id", F.lit("__cycle__"))
    return m.select("ts", "worker", "cycle", "id", "latency").unionByName(total.select("ts", "worker", "cycle", "id", "latency"))


def overloaded(rows: DataFrame) -> DataFrame:
    """Hosts whose figures can't be trusted: busy CPU or memory, or workers that didn't report."""
    return rows.withColumn("overloaded", (F.col("cpu") > 70) | (F.col("mem") > 70) | (F.col("received") != F.col("active")))


def backoff(retry: Column, seed: int = 0) -> Column:
    """Seconds to wait before a retry."""
    return F.pow(F.lit(2.0), retry) * 0.1 * (F.rand(seed) + 0.5)


def jitter(seconds: Column, seed: int = 0) -> Column:
    """A duration 20 % shorter to 20 % longer."""
    return seconds * (F.rand(seed) * 0.4 + 0.8)
