"""Queries over readers, writers, run arithmetic and sketches, each against the figures that it must give."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import digest, scalars
from sluice.operators import control, stats
from sluice.plans.latency import measurements
from sluice.session import shared_dir, table
from sluice.sources import files, sinks


def stats_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics appended in two parts to CSV files, and read under their fixed names."""
    r = stats.window_report(measurements(spark, sf), 3600)
    rows = r.select(F.unix_timestamp(F.col("window_start").cast("timestamp")).alias("ts"), F.lit(0).cast("long").alias("elapsed"), "id", F.lit(1).cast("long").alias("threads"), "tot_ops", F.lit(0).cast("long").alias("tot_ops_s"), "period_ops", "period_ops_s", *[F.col(c).alias(f"{c}_ms") for c in ("mean", "p50", "p90", "p95", "p99", "max")], F.lit("1.5 2;").alias("centroids"))
    at = f"{shared_dir(spark)}/stats-{uuid.uuid4().hex}"
    sinks.write_stats(rows.where("id < 'm'"), at)
    sinks.write_stats(rows.where("id >= 'm'"), at)
    return files.read_stats(spark, at).groupBy("id").agg(F.count("*").alias("n"), F.sum("period_ops").alias("ops"), F.max("max_ms").alias("top"))


def insert_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """The sizes of the statements that load a table, ten rows each and the rest."""
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name").coalesce(1)
    return sinks.insert_batches(rows, "nation", 10).select(F.col("n_rows"), F.startswith("stmt", F.lit("INSERT INTO nation (n_nationkey, n_name) VALUES (")).alias("good"), F.regexp_count("stmt", F.lit(r"\), \(")).cast("long").alias("commas"))


def micros(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", scalars.from_micros(scalars.to_micros(F.col("ts"))).cast("timestamp_ntz").alias("back"))


def thread_split(spark: SparkSession, sf: str) -> DataFrame:
    """Workers of each process, ascending, for some numbers of both."""
    rows = [(t, p, k, n) for t in (1, 4, 7, 30) for p in (1, 3, 8) for k, n in enumerate(control.threads_per_process(t, p))]
    return spark.createDataFrame(rows, "threads long, processes long, k long, n long")


def quotas(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(i, c, *control.quota(i, c)) for i in (0, 1, 5, 100) for c in (1, 3, 8)]
    return spark.createDataFrame(rows, "iterations long, concurrency long, workers long, each long")


def half_even(spark: SparkSession, sf: str) -> DataFrame:
    """Milliseconds of saved statistics are rounded to the even neighbour."""
    v = (F.col("n_nationkey") * 10 + 5).cast("decimal(20,3)") / 1000
    return table(spark, sf, "nation").select("n_nationkey", F.bround(v, 2).cast("double").alias("ms"))


def within(spark: SparkSession, sf: str, sketch: DataFrame, bound: float) -> DataFrame:
    """Whether the shares of measurements up to a sketch's quantiles are those of the quantiles, within a bound."""
    m = measurements(spark, sf).join(sketch.select("id", "p50", "p90", "p99"), "id")
    share = lambda c: F.avg((F.col("latency") <= F.col(c)).cast("double"))
    g = m.groupBy("id").agg(*[share(c).alias(c) for c in ("p50", "p90", "p99")])
    ok = [F.abs(F.col(c) - q) <= bound for c, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))]
    return g.select("id", (ok[0] & ok[1] & ok[2]).alias("within"))


def tdigest_within(spark: SparkSession, sf: str) -> DataFrame:
    d = digest.digest_by(measurements(spark, sf), ["id"], "latency")
    q = d.select("id", digest.digest_quantiles("centroids").alias("q"))
    return within(spark, sf, q.select("id", F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"), F.col("q")[4].alias("p99")), 0.01)


def digest_mass(spark: SparkSession, sf: str) -> DataFrame:
    """Digests merged from parts keep the number and the sum of what went in."""
    m = measurements(spark, sf).withColumn("part", F.col("cycle") % 7)
    merged = digest.merge_by(digest.digest_by(m, ["id", "part"], "latency"), ["id"])
    total = lambda f: F.aggregate("centroids", F.lit(0.0), f)
    return merged.select("id", F.round(total(lambda s, x: s + x["weight"])).cast("long").alias("n"), F.round(total(lambda s, x: s + x["weight"] * x["mean"]), 1).alias("total"))


def kll_within(spark: SparkSession, sf: str) -> DataFrame:
    return within(spark, sf, digest.kll_report(measurements(spark, sf), ["id"], "latency"), 0.03)


def stats_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """Saved statistics in the order of time and id, with their place."""
    e = table(spark, sf, "events").groupBy(F.expr("unix_timestamp(cast(ts as timestamp)) div 86400").alias("day"), F.col("event_type").alias("id")).agg(F.count("*").alias("n"))
    from sluice.operators.ordering import ranked

    return ranked(e, ["day", "id"]).select("rn", "day", "id", "n")


def chart_page(spark: SparkSession, sf: str) -> DataFrame:
    """The lines that the page of a run draws: one of each id for each of four figures."""
    r = stats.window_report(measurements(spark, sf), 86_400)
    s = r.select((F.unix_timestamp(F.col("window_start").cast("timestamp")) - 1704067200).alias("elapsed"), "id", F.col("p99").alias("p99_ms"), F.col("mean").alias("mean_ms"), "period_ops_s", F.lit(1).alias("threads"))
    page, text = stats.html_chart(s), stats.terminal_chart(s)
    return spark.createDataFrame([(page.count("<polyline"), page.count("<h2>"), len(text.splitlines()))], "lines long, charts long, rows long")


Z = "(values (1), (4), (7), (30)) t(threads), (values (1), (3), (8)) p(processes)"
QUERIES = {
    "stats_csv": (stats_csv, "select id, count(*) as n, sum(ops)::bigint as ops, max(top) as top from (select event_type as id, count(*) as ops, max(value) as top from events group by event_type, time_bucket(interval 1 hour, ts)) x group by id"),
    "insert_sizes": (insert_sizes, "select n::bigint as n_rows, true as good, (n - 1)::bigint as commas from (values (10), (10), (5)) v(n)"),
    "micros": (micros, "select event_id, ts as back from events"),
    "thread_split": (thread_split, f"select threads::bigint as threads, processes::bigint as processes, k::bigint as k, (threads // processes + case when k >= processes - threads % processes then 1 else 0 end)::bigint as n from {Z}, range(0, 8) r(k) where k < processes"),
    "quotas": (quotas, "select i::bigint as iterations, c::bigint as concurrency, least(i, c)::bigint as workers, case when i = 0 then 0 else i // least(i, c) end::bigint as each from (values (0), (1), (5), (100)) a(i), (values (1), (3), (8)) b(c)"),
    "half_even": (half_even, "select n_nationkey, (case when n_nationkey % 2 = 0 then n_nationkey else n_nationkey + 1 end)::double / 100 as ms from nation"),
    "tdigest_within": (tdigest_within, "select distinct event_type as id, true as within from events"),
    "digest_mass": (digest_mass, "select event_type as id, count(*) as n, round(sum(value), 1) as total from events group by 1"),
    "kll_within": (kll_within, "select distinct event_type as id, true as within from events"),
    "stats_by_id": (stats_by_id, "select row_number() over (order by day, id) - 1 as rn, * from (select floor(epoch(ts))::bigint // 86400 as day, event_type as id, count(*) as n from events group by 1, 2) x"),
    "chart_page": (chart_page, "select 4 * count(distinct event_type) as lines, 4::bigint as charts, count(distinct event_type) as rows from events"),
}
