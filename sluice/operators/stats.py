"""Latency statistics: windowed, cumulative and whole-run reports, merging of saved statistics, histograms, smoothing.

A measurement is (ts, worker, id, latency). Reports are one shuffle on (window, id): counts, averages and
sketches combine before it. Exact quantiles keep each group's values; where groups are large, quantiles="sketch"
takes the mergeable sketch instead, whose state is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.digest import digest_quantiles, merge_by
from sluice.functions.scalars import parse_centroids

#: Quantiles and layout of a report.
QUANTILES = (0.5, 0.9, 0.95, 0.99)
WINDOW_SECONDS = 10
STATS_SCHEMA = (
    "ts BIGINT, elapsed BIGINT, id STRING, threads BIGINT, tot_ops BIGINT, tot_ops_s BIGINT, period_ops BIGINT, period_ops_s BIGINT, "
    "mean_ms DOUBLE, p50_ms DOUBLE, p90_ms DOUBLE, p95_ms DOUBLE, p99_ms DOUBLE, max_ms DOUBLE, centroids STRING"
)
STATS_COLUMNS = [c.split()[0] for c in STATS_SCHEMA.split(", ")]


def quantile_columns(value: str, how: str = "exact") -> list[Column]:
    """p50 to p99 and max of a column; how: exact (percentile_disc), interpolated or sketch."""
    out = []
    for q in QUANTILES:
        name = f"p{round(q * 100)}"
        if how == "exact":
            out.append(F.expr(f"percentile_disc({q}) within group (order by {value})").alias(name))
        elif how == "interpolated":
            out.append(F.percentile(value, F.lit(q)).alias(name))
        else:
            out.append(F.percentile_approx(value, F.lit(q), F.lit(10_000)).alias(name))
    return [*out, F.max(value).alias("max")]


def window_report(m: DataFrame, seconds: int = WINDOW_SECONDS, offset: int = 0, quantiles: str = "exact") -> DataFrame:
    """A row for each tumbling window and id: period and cumulative operations, rate, mean and quantiles of latency."""
    w = F.window("ts", f"{seconds} seconds", f"{seconds} seconds", f"{offset} seconds")
    g = m.groupBy(w.alias("w"), "id").agg(F.count("*").alias("period_ops"), F.avg("latency").alias("mean"), *quantile_columns("latency", quantiles))
    running = Window.partitionBy("id").orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("window_start", F.col("w.start")).drop("w")
    return g.withColumn("tot_ops", F.sum("period_ops").over(running)).withColumn("period_ops_s", F.expr(f"period_ops div {seconds}"))


def report_times(report: DataFrame, seconds: int = WINDOW_SECONDS, buffer: int = 8, delay: int = 0) -> DataFrame:
    """The report with the time at which each window is told: its end, the buffer for late rows and the delay."""
    return report.withColumn("report_at", F.col("window_start") + F.make_interval(secs=F.lit(seconds + buffer + delay)))


def active_threads(m: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """How many workers reported in each window, and whether that is fewer than in the run so far (a completeness check)."""
    n = m.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count_distinct("worker").alias("threads"))
    n = n.select(F.col("w.start").alias("window_start"), "threads")
    # windows are few; the running peak goes over them only
    peak = F.max("threads").over(Window.partitionBy(F.lit(0)).orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0))
    return n.withColumn("complete", F.col("threads") == peak)


def final_report(m: DataFrame, quantiles: str = "exact", last_window_only: bool = False, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """One row for each id over the whole run; last_window_only keeps the ids that the last window has."""
    span = m.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    elapsed = max(1, int((span["hi"] - span["lo"]).total_seconds())) if span and span["hi"] else 1
    out = m.groupBy("id").agg(F.count("*").alias("tot_ops"), F.avg("latency").alias("mean"), *quantile_columns("latency", quantiles))
    out = out.withColumn("elapsed", F.lit(elapsed).cast("long")).withColumn("tot_ops_s", F.expr(f"tot_ops div {elapsed}"))
    if last_window_only:
        start = m.select(F.window("ts", f"{seconds} seconds").start.alias("s"), "id")
        last = start.agg(F.max("s")).first()[0]
        out = out.join(start.where(F.col("s") == F.lit(last)).select("id").distinct(), "id", "left_semi")
    return out


def elapsed_bucket(ts: Column, first: Column) -> Column:
    """Seconds since the first row rounded up to tens, and ten more."""
    d = ts - first
    return F.when(d % 10 == 0, d).otherwise(d + 10 - d % 10) + 10


def merge_stats(rows: DataFrame, with_quantiles: bool = False) -> DataFrame:
    """Saved statistics of several hosts as one: buckets of ten seconds, threads added up, operations counted again and summed up.

    rows: the statistics' columns. with_quantiles merges the centroids of a bucket and gives mean and quantiles from them.
    """
    first = rows.agg(F.min("ts")).first()[0]
    b = rows.withColumn("bucket", elapsed_bucket(F.col("ts"), F.lit(first)))
    g = b.groupBy("bucket", "id").agg(F.min("ts").alias("ts"), F.sum("threads").alias("threads"), F.sum("period_ops").alias("period_ops")).withColumnRenamed("bucket", "elapsed")
    running = Window.partitionBy("id").orderBy("elapsed").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("tot_ops", F.sum("period_ops").over(running))
    g = g.withColumn("period_ops_s", F.expr("period_ops div 10")).withColumn("tot_ops_s", F.expr("tot_ops div elapsed"))
    cols = ["ts", "elapsed", "id", "threads", "tot_ops", "tot_ops_s", "period_ops", "period_ops_s"]
    if not with_quantiles:
        return g.select(cols)
    merged = merge_by(b.select(F.col("bucket").alias("elapsed"), "id", parse_centroids(F.col("centroids")).alias("centroids")), ["elapsed", "id"])
    q = merged.select("elapsed", "id", digest_quantiles("centroids").alias("q"))
    names = ["mean_ms", "p50_ms", "p90_ms", "p95_ms", "p99_ms", "max_ms"]
    return g.join(q, ["elapsed", "id"], "left").select(*cols, *[F.bround(F.col("q")[i] * 1000, 2).alias(n) for i, n in enumerate(names)], F.lit(None).cast("string").alias("centroids"))


def latency_histogram(m: DataFrame, bounds: list[int]) -> DataFrame:
    """Cumulative bucket counts of each id (values under bound + 1), the +Inf bucket, and the sum."""
    counts = [F.count_if(F.col("latency") < b + 1).alias(f"b{b}") for b in bounds]
    g = m.groupBy("id").agg(*counts, F.count("*").alias("inf"), F.sum(F.col("latency").cast("decimal(18,2)")).cast("double").alias("total"))
    pairs = F.explode(F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{b}").alias("n")) for b in bounds], F.struct(F.lit("+Inf").alias("le"), F.col("inf").alias("n"))))
    return g.select("id", "total", pairs.alias("p")).select("id", "p.le", "p.n", "total")


def ewma(values: Column, alpha: float = 0.4) -> Column:
    """Exponential smoothing of an array in order, seeded by its first value above zero; zeros leave it alone."""
    step = lambda s, x: F.when(x <= 0, s).when(s.isNull() | (s == 0), x).otherwise(x * alpha + s * (1 - alpha))
    return F.aggregate(values, F.lit(None).cast("double"), step)


def gauges(report: DataFrame) -> DataFrame:
    """(metric, id, value) rows of a report, as a metrics endpoint would show them."""
    names = ["tot_ops", "tot_ops_s", "period_ops", "period_ops_s"]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]))
    return report.select("id", pairs.alias("p")).select("p.metric", "id", "p.value")


def chart_series(stats: DataFrame) -> DataFrame:
    """(elapsed, id, p99_ms, mean_ms, period_ops_s, threads), what charts of a run draw."""
    return stats.select("elapsed", "id", "p99_ms", "mean_ms", "period_ops_s", "threads")


#: What a run's page draws.
FIGURES = ("p99_ms", "mean_ms", "period_ops_s", "threads")


def thinned(stats: DataFrame, points: int) -> list:
    """(id, x, figures) of each id, the largest of each of at most so many stretches of time: points rows an id come to the driver."""
    span = stats.agg(F.max("elapsed")).first()[0] or 1
    step = max(1, span // points)
    return stats.groupBy("id", F.expr(f"elapsed div {step} * {step}").alias("x")).agg(*[F.max(c).alias(c) for c in FIGURES]).orderBy("id", "x").collect()


def html_chart(stats: DataFrame, points: int = 2000) -> str:
    """A self-contained page with a chart for each figure and a line in it for each id."""
    rows = thinned(stats, points)
    span = max((r["x"] for r in rows), default=1) or 1
    ids = sorted({r["id"] for r in rows})
    body = ""
    for c in FIGURES:
        top = max((r[c] or 0 for r in rows), default=1) or 1
        body += f'<h2>{c}</h2><svg viewBox="0 0 800 300">'
        for i, k in enumerate(ids):
            at = " ".join(f"{r['x'] / span * 800:.1f},{300 - (r[c] or 0) / top * 300:.1f}" for r in rows if r["id"] == k)
            body += f'<g><title>{k}</title><polyline fill="none" stroke="hsl({i * 67 % 360},70%,40%)" points="{at}"/></g>'
        body += "</svg>"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>run</title></head><body>{body}</body></html>'


def terminal_chart(stats: DataFrame, figure: str = "p99_ms", width: int = 80) -> str:
    """A line of text for each id: its figure over time in eight heights."""
    rows = thinned(stats, width)
    top = max((r[figure] or 0 for r in rows), default=1) or 1
    lines: dict[str, str] = {}
    for r in rows:
        lines[r["id"]] = lines.get(r["id"], "") + "▁▂▃▄▅▆▇█"[min(7, int(8 * (r[figure] or 0) / top))]
    pad = max(map(len, lines), default=0)
    return "\n".join(f"{k:<{pad}} {v}" for k, v in lines.items())
