"""Latency and control queries over events: event_type is the function's id, value its latency, user_id the worker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import digest
from sluice.operators import control, stats
from sluice.session import shared_dir, table
from sluice.streaming import reports

#: Windows of these queries: ten minutes, as the table has a row every few minutes.
SECONDS = 600
BOUNDS = [1, 5, 10, 25, 50, 100, 250, 500]


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("ts", F.col("user_id").alias("worker"), F.col("event_type").alias("id"), F.col("value").alias("latency"), F.col("event_id").alias("cycle"))


def saved_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics rows such as a run of two hosts leaves behind, from events."""
    e = table(spark, sf, "events")
    s = e.groupBy(F.expr("unix_timestamp(cast(ts as timestamp)) div 3600 * 3600 + event_id % 2 * 7").alias("ts"), F.col("event_type").alias("id"))
    return s.agg(F.count_distinct("user_id").alias("threads"), F.count("*").alias("period_ops"))


SAVED_SQL = "select floor(epoch(ts))::bigint // 3600 * 3600 + event_id % 2 * 7 as ts, event_type as id, count(distinct user_id) as threads, count(*) as period_ops from events group by 1, 2"


def window_report(spark: SparkSession, sf: str) -> DataFrame:
    return stats.window_report(measurements(spark, sf), SECONDS)


def window_offset_counts(spark: SparkSession, sf: str) -> DataFrame:
    r = stats.window_report(measurements(spark, sf), 10, offset=7)
    return r.select("window_start", "id", "period_ops")


def cumulative_ops(spark: SparkSession, sf: str) -> DataFrame:
    return stats.window_report(measurements(spark, sf), SECONDS).select("id", "window_start", "tot_ops", "period_ops_s")


def cumulative_quantile(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of all measurements so far, by day, exact: a day's counts of each value count for the days after it too, so that each day of an id is a group of its own."""
    m = measurements(spark, sf).withColumn("day", F.date_trunc("day", "ts"))
    counts = m.groupBy("id", "day", "latency").agg(F.count("*").alias("n"))
    # the days of a run are few; no measurement is looked at more than once before it is counted
    days = counts.groupBy("id").agg(F.array_sort(F.collect_set("day")).alias("days"))
    later = counts.join(days, "id").select("id", "latency", "n", F.explode(F.filter("days", lambda d: d >= F.col("day"))).alias("day"))
    sums = later.groupBy("id", "day", "latency").agg(F.sum("n").alias("n"))
    return sums.groupBy("id", "day").agg(F.round(F.percentile("latency", F.lit(0.9), F.col("n")), 4).alias("p90_so_far"))


def completeness(spark: SparkSession, sf: str) -> DataFrame:
    return stats.active_threads(measurements(spark, sf), 86_400)


def merge_stats_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return stats.merge_stats(saved_stats(spark, sf))


def final_report(spark: SparkSession, sf: str) -> DataFrame:
    return stats.final_report(measurements(spark, sf))


def final_report_last_window_ids(spark: SparkSession, sf: str) -> DataFrame:
    return stats.final_report(measurements(spark, sf), last_window_only=True, seconds=3600)


def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return stats.latency_histogram(measurements(spark, sf), BOUNDS)


def metric_gauges(spark: SparkSession, sf: str) -> DataFrame:
    r = stats.window_report(measurements(spark, sf), SECONDS)
    return stats.gauges(r.withColumn("tot_ops_s", F.expr(f"tot_ops div {SECONDS}"))).groupBy("metric", "id").agg(F.max("value").alias("value"))


def hourly_rates(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("grp"), F.expr("unix_timestamp(cast(ts as timestamp)) div 21600").alias("seq"))
    return e.agg(F.count("*").cast("double").alias("rate"))


RATES_SQL = "select event_type as grp, floor(epoch(ts))::bigint // 21600 as seq, count(*)::double as rate from events group by 1, 2"


def ewma_rate(spark: SparkSession, sf: str) -> DataFrame:
    g = hourly_rates(spark, sf).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("seq", "rate"))).alias("r"))  # a row a window of one run
    return g.select("grp", stats.ewma(F.transform("r", lambda x: x["rate"])).alias("smoothed"))


def max_rate_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return control.rate_decisions(hourly_rates(spark, sf), 17.0)


FOLD = f"""r as (select *, row_number() over (partition by grp order by seq) as k from ({RATES_SQL}) x),
f as (select grp, k, seq, rate, rate as smoothed from r where k = 1
  union all select r.grp, r.k, r.seq, r.rate, r.rate * 0.4 + f.smoothed * (1 - 0.4) from f join r on r.grp = f.grp and r.k = f.k + 1)"""


def active_connections(spark: SparkSession, sf: str) -> DataFrame:
    delta = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), delta.alias("delta"))
    return control.connection_deltas(e).select("seq", F.col("active").cast("long").alias("active"))


def controller_run(spark: SparkSession, sf: str) -> DataFrame:
    """The controller's workers, pause and decisions, with 12 seconds of ramp, over the rates of each function."""
    return control.controller_run(hourly_rates(spark, sf), 17.0, workers=2, ramp_s=12.0).select("grp", "seq", F.round("smoothed", 6).alias("smoothed"), "workers", F.round("pause", 6).alias("pause"), "decision")


def cycle_rate(spark: SparkSession, sf: str) -> DataFrame:
    m = control.cycles(measurements(spark, sf).withColumn("cycle", F.expr("cycle div 40")))
    return control.cycle_rate(stats.window_report(m, 3600).withColumn("period_ops_s", F.col("period_ops")))


def delayed_reports(spark: SparkSession, sf: str) -> DataFrame:
    r = stats.window_report(measurements(spark, sf), SECONDS).select("window_start", "id", "period_ops")
    return stats.report_times(r, SECONDS, delay=30)


def stream_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A live run in which every seventh row arrives an hour late and counts in the window of its arrival; the last, open window is in the result."""
    import uuid

    events = reports.event_stream(spark, sf, table(spark, sf, "events").schema.simpleString()[len("struct<") : -1].replace(":", " "), "events.parquet")
    late = F.when(F.col("event_id") % 7 == 0, F.col("ts") + F.expr("interval 1 hour")).otherwise(F.col("ts"))
    m = events.select("ts", late.alias("arrival"), F.col("event_type").alias("id"), F.col("value").alias("latency"))
    at = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    reports.run_updates(reports.windowed(reports.late_to_arrival(m, "arrival"), SECONDS).select("window_start", "id", "period_ops", "max"), at, f"{at}-checkpoint").awaitTermination()
    return reports.latest_windows(spark, at).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "id", "period_ops", "max")


def peak_connections(spark: SparkSession, sf: str) -> DataFrame:
    return active_connections(spark, sf).agg(F.max("active").alias("peak"), F.min("active").alias("low"))


def retry_counts(spark: SparkSession, sf: str) -> DataFrame:
    m = measurements(spark, sf).withColumn("retries", F.col("cycle") % 4)
    return control.retries(m).groupBy("id").agg(F.count("*").alias("n"), F.sum(F.col("latency").cast("decimal(18,2)")).cast("double").alias("total"))


def cycle_rollup(spark: SparkSession, sf: str) -> DataFrame:
    m = measurements(spark, sf).withColumn("cycle", F.expr("cycle div 10"))
    c = control.cycles(m)
    return c.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.col("latency").cast("decimal(18,2)")).cast("double").alias("total"))


def task_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("done"), F.count_if(F.col("event_type") == "signup").alias("started"))


SCHEDULE = [(0, 4, 100, 60, 600_000), (1, 16, 0, 0, 900_000), (2, 8, 50, 30, 3_000_000)]


def schedule_assign(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("elapsed", F.expr("unix_timestamp(cast(ts as timestamp)) - 1704067200"))
    s = spark.createDataFrame(SCHEDULE, "step long, connections long, max_rate long, ramp long, duration long")
    return control.assign_schedule(e.select("event_id", "elapsed"), s).groupBy("step", "connections", "max_rate").agg(F.count("*").alias("n"))


def ramp_expand(spark: SparkSession, sf: str) -> DataFrame:
    return control.ramp(spark.createDataFrame([(0, 4, 60), (1, 12, 30), (2, -8, 20), (3, 0, 5)], "step long, change long, ramp long"))


def overloaded_hosts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("user_id").agg(F.max("value").alias("top"), F.count("*").alias("n"))
    rows = e.select("user_id", (F.col("top") / 7).alias("cpu"), (F.col("top") / 8).alias("mem"), F.col("n").alias("received"), F.expr("n + cast(user_id % 2 as bigint)").alias("active"))
    return control.overloaded(rows).select("user_id", "overloaded")


def union_all_csvs(spark: SparkSession, sf: str) -> DataFrame:
    s = saved_stats(spark, sf)
    return s.where("id < 'm'").select("id", "ts", "threads", "period_ops").unionByName(s.where("id >= 'm'"))


def distinct_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("id")).distinct()


def chart_series(spark: SparkSession, sf: str) -> DataFrame:
    """What charts draw: hourly p99 in ms and rates of each id."""
    m = measurements(spark, sf)
    r = stats.window_report(m, 3600)
    return r.select("window_start", "id", (F.col("p99") * 1000).alias("p99_ms"), "period_ops_s")


def tdigest_report(spark: SparkSession, sf: str) -> DataFrame:
    d = digest.digest_by(measurements(spark, sf), ["id"], "latency")
    return d.select("id", digest.digest_quantiles("centroids").alias("q")).select("id", *[F.col("q")[i].alias(n) for i, n in enumerate(("mean", "p50", "p90", "p95", "p99", "max"))])


def kll_report(spark: SparkSession, sf: str) -> DataFrame:
    return digest.kll_report(measurements(spark, sf), ["id"], "latency")


def session_gap(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "events").select("user_id", "ts")
    return reports.sessions(m, "2 hours", ["user_id"]).select("user_id", "session_start", "n")


def stream_window_report(spark: SparkSession, sf: str) -> DataFrame:
    """The windowed report as a stream that reads what is there and stops; complete output."""
    import uuid

    name = f"windows_{uuid.uuid4().hex}"
    events = reports.event_stream(spark, sf, table(spark, sf, "events").schema.simpleString()[len("struct<") : -1].replace(":", " "), "events.parquet")
    m = events.select("ts", F.col("event_type").alias("id"), F.col("value").alias("latency"))
    out = reports.windowed(m, 86_400, quantiles="sketch").select("window_start", "id", "period_ops", "max")
    q = reports.run_to_table(out, name, f"{shared_dir(spark)}/{name}")
    q.awaitTermination()
    return spark.table(name).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "id", "period_ops", "max")


Q = "percentile_disc({}) within group (order by value)"
PCT = ", ".join(f"{Q.format(p)} as p{round(p * 100)}" for p in stats.QUANTILES) + ", max(value) as max"
GAP = "(select *, case when lag(ts) over (partition by user_id order by ts, event_id) is null or ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 2 hours then 1 else 0 end as fresh from events)"
WINDOW = f"select window_start, id, period_ops, mean, p50, p90, p95, p99, max, (sum(period_ops) over (partition by id order by window_start))::bigint as tot_ops, period_ops // {SECONDS} as period_ops_s from (select time_bucket(interval 10 minutes, ts) as window_start, event_type as id, count(*) as period_ops, avg(value) as mean, {PCT} from events group by 1, 2) x"
ELAPSED = "greatest(1, floor(epoch((select max(ts) - min(ts) from events)))::bigint)"
FINAL = f"select event_type as id, count(*) as tot_ops, avg(value) as mean, {PCT}, {ELAPSED} as elapsed, count(*) // {ELAPSED} as tot_ops_s from events"
BUCKET = "case when d % 10 = 0 then d else d + 10 - d % 10 end + 10"
CONN = "select event_id as seq, (sum(case event_type when 'signup' then 1 when 'error' then -1 else 0 end) over (order by event_id))::bigint as active from events"

STEP = """case when r.rate > 0 then case when f.smoothed = 0 then r.rate else r.rate * 0.4 + f.smoothed * (1 - 0.4) end else f.smoothed end"""
C = "coalesce(nullif(sm, 0), rate)"
#: The controller's rules as a recursive query: a row a step, with smoothed rate, workers, pause and the end of the cooldown.
CONTROLLER = f"""with recursive r as (select *, row_number() over (partition by grp order by seq) as k from ({RATES_SQL}) x),
s0 as (select distinct grp from r),
f as (
  select grp, 0::bigint as k, 0::bigint as seq, 0.0::double as smoothed, 2::bigint as workers, 0.0::double as pause, 0.0::double as cooldown, '' as decision from s0
  union all
  select grp, k, seq, sm, wanted, pause, case when wanted <> workers then now + 72 else cooldown end, case when wanted > workers then 'grow' when wanted < workers then 'shrink' else what end from (
    select *, case when rate <= 0 or c < 0.9 * 17 then case when ready then case when rate <= 0 then greatest(1, workers + 1) else greatest(workers + 1, ceil(17.0 / (c / greatest(1, workers)))::bigint) end else workers end
      when c > 1.1 * 17 and not (c < 2 * 17 and over <= 1) and ready and workers > 1 then least(workers, greatest(1, floor(17.0 / (c / workers))::bigint)) else workers end as wanted,
      case when rate <= 0 or c < 0.9 * 17 then 0.0 when c <= 1.1 * 17 then old * 0.5 when c < 2 * 17 and over <= 1 then over else least(over, 1.0) end as pause,
      case when rate <= 0 or c < 0.9 * 17 then 'hold' when c <= 1.1 * 17 then 'steady' else 'pause' end as what
    from (select *, {C} as c, greatest(0.0, workers / 17.0 - workers / {C}) as over, now >= cooldown as ready from (
      select r.grp, r.k, r.seq, r.rate, {STEP} as sm, f.workers, f.pause as old, f.cooldown, r.seq * 10.0 as now from f join r on r.grp = f.grp and r.k = f.k + 1) a) b) d)
select grp, seq, round(smoothed, 6) as smoothed, workers, round(pause, 6) as pause, decision from f where k > 0"""

QUERIES = {
    "controller_run": (controller_run, CONTROLLER),
    "cycle_rate": (cycle_rate, "select window_start, sum(cycles)::bigint as rate from (select time_bucket(interval 1 hour, ts) as window_start, 0 as cycles from events union all select time_bucket(interval 1 hour, max(ts)), 1 from events group by user_id, event_id // 40) x group by 1"),
    "delayed_reports": (delayed_reports, f"select time_bucket(interval 10 minutes, ts) as window_start, event_type as id, count(*) as period_ops, time_bucket(interval 10 minutes, ts) + interval {SECONDS + 8 + 30} seconds as report_at from events group by 1, 2"),
    "stream_late_rows": (stream_late_rows, "select time_bucket(interval 10 minutes, case when event_id % 7 = 0 then ts + interval 1 hour else ts end) as window_start, event_type as id, count(*) as period_ops, max(value) as max from events group by 1, 2"),
    "window_report": (window_report, WINDOW),
    "window_offset_counts": (window_offset_counts, "select time_bucket(interval 10 seconds, ts, interval 7 seconds) as window_start, event_type as id, count(*) as period_ops from events group by 1, 2"),
    "cumulative_ops": (cumulative_ops, f"select id, window_start, tot_ops, period_ops_s from ({WINDOW}) y"),
    "cumulative_quantile": (cumulative_quantile, "select distinct event_type as id, date_trunc('day', ts)::timestamp as day, round(quantile_cont(value, 0.9) over (partition by event_type order by date_trunc('day', ts) range between unbounded preceding and current row), 4) as p90_so_far from events"),
    "completeness": (completeness, "select window_start, threads, threads = max(threads) over (order by window_start) as complete from (select time_bucket(interval 1 day, ts) as window_start, count(distinct user_id) as threads from events group by 1) x"),
    "merge_stats_bucket": (merge_stats_bucket, f"select ts, elapsed, id, threads, tot_ops, tot_ops // elapsed as tot_ops_s, period_ops, period_ops // 10 as period_ops_s from (select *, (sum(period_ops) over (partition by id order by elapsed))::bigint as tot_ops from (select min(ts) as ts, {BUCKET} as elapsed, id, sum(threads)::bigint as threads, sum(period_ops)::bigint as period_ops from (select *, ts - min(ts) over () as d from ({SAVED_SQL}) s) b group by 2, 3) g) h"),
    "final_report": (final_report, f"{FINAL} group by event_type"),
    "final_report_last_window_ids": (final_report_last_window_ids, f"{FINAL} where event_type in (select event_type from events where time_bucket(interval 1 hour, ts) = (select max(time_bucket(interval 1 hour, ts)) from events)) group by event_type"),
    "latency_histogram": (latency_histogram, "select event_type as id, le, case le when '+Inf' then count(*) else count(*) filter (value < try_cast(le as int) + 1) end as n, sum(value::decimal(18,2))::double as total from events, (select unnest([" + ", ".join(f"'{b}'" for b in BOUNDS) + ", '+Inf']) as le) b group by 1, 2"),
    "metric_gauges": (metric_gauges, f"select metric, id, max(value) as value from (select id, unnest(['tot_ops', 'tot_ops_s', 'period_ops', 'period_ops_s']) as metric, unnest([tot_ops, tot_ops // {SECONDS}, period_ops, period_ops_s])::double as value from ({WINDOW}) y) z group by 1, 2"),
    "ewma_rate": (ewma_rate, f"with recursive {FOLD} select grp, arg_max(smoothed, k) as smoothed from f group by grp"),
    "max_rate_decisions": (max_rate_decisions, f"with recursive {FOLD} select grp, seq, rate, smoothed, case when smoothed between 0.9 * 17.0 and 1.1 * 17.0 then 'steady' when smoothed < 0.9 * 17.0 then 'grow' when smoothed < 2 * 17.0 then 'pause' else 'shrink' end as decision from f"),
    "active_connections": (active_connections, CONN),
    "peak_connections": (peak_connections, f"select max(active) as peak, min(active) as low from ({CONN}) x"),
    "retry_counts": (retry_counts, "select id, count(*) as n, sum(latency)::double as total from (select event_type as id, value::decimal(18,2) as latency from events where event_id % 4 < 3 union all select '__retries__', 0 from events, range(1, 4) r(i) where i <= event_id % 4) x group by id"),
    "cycle_rollup": (cycle_rollup, "select id, count(*) as n, sum(latency)::double as total from (select event_type as id, value::decimal(18,2) as latency from events union all select '__cycle__', sum(value)::decimal(18,2) from events group by user_id, event_id // 10) x group by id"),
    "task_counts": (task_counts, "select user_id, count(*) filter (event_type = 'purchase') as done, count(*) filter (event_type = 'signup') as started from events group by 1"),
    "schedule_assign": (schedule_assign, "select step::bigint as step, connections::bigint as connections, max_rate::bigint as max_rate, count(*) as n from (select floor(epoch(ts))::bigint - 1704067200 as elapsed from events) e join (values (0, 4, 100, 0, 600000), (1, 16, 0, 600000, 1500000), (2, 8, 50, 1500000, 4500000)) s(step, connections, max_rate, a, b) on elapsed >= a and elapsed < b group by 1, 2, 3"),
    "ramp_expand": (ramp_expand, "select step::bigint as step, case when change > 0 then 'start' else 'stop' end as action, k::bigint as k, k * ramp / abs(change) as at_s from (values (0, 4, 60), (1, 12, 30), (2, -8, 20), (3, 0, 5)) c(step, change, ramp), range(0, 100) r(k) where k < abs(change)"),
    "overloaded_hosts": (overloaded_hosts, "select user_id, max(value) / 7 > 70 or max(value) / 8 > 70 or user_id % 2 <> 0 as overloaded from events group by user_id"),
    "union_all_csvs": (union_all_csvs, f"select id, ts, threads, period_ops from ({SAVED_SQL}) s"),
    "distinct_ids": (distinct_ids, "select distinct event_type as id from events"),
    "chart_series": (chart_series, "select time_bucket(interval 1 hour, ts) as window_start, event_type as id, percentile_disc(0.99) within group (order by value) * 1000 as p99_ms, count(*) // 3600 as period_ops_s from events group by 1, 2"),
    "tdigest_report": (tdigest_report, None),
    "kll_report": (kll_report, None),
    "session_gap": (session_gap, f"select user_id, min(ts) as session_start, count(*) as n from (select *, sum(fresh) over (partition by user_id order by ts, event_id) as s from {GAP} g) x group by user_id, s"),
    "stream_window_report": (stream_window_report, "select time_bucket(interval 1 day, ts) as window_start, event_type as id, count(*) as period_ops, max(value) as max from events group by 1, 2"),
}
