"""Goldens, properties and round trips of the modules under the queries."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.functions import digest, scalars
from sluice.operators import control, ordering, stats
from sluice.sources import blueprint, ddl, files, generators, sinks
from sluice.streaming import controller, reports


def test_derived_seeds():
    a, b = generators.shard_seeds(1, 2)
    x, y = random.Random(a), random.Random(b)
    assert [x.randint(0, 1000000), x.randint(0, 1000000)] == [948735, 614390]
    assert [y.randint(0, 1000000), y.randint(0, 1000000)] == [140545, 157597]


def test_seeded_rows_do_not_depend_on_spark(spark):
    item = {"count": 11, "columns": {"s": {"type": "string", "args": {"min": 3, "max": 3, "seed": 0}}, "n": {"type": "integer", "args": {"max": 1000, "seed": 0, "null_pct": 0.2}}}}
    got = [tuple(r) for r in blueprint.generate(spark, item, 2).collect()]
    want = []
    for shard, n in enumerate(control.split_rows(11, 2)):
        g = [generators.make(d["type"], d["args"], shard, 2, 11) for d in item["columns"].values()]
        want += [tuple(next(x) for x in g) for _ in range(n)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_fast_rows_do_not_depend_on_partitions(spark):
    item = {"count": 300, "columns": {c: {"type": c, "args": {"seed": 5}} for c in ("uuid", "integer", "string", "timestamp", "float")}}
    a, b = (sorted(map(tuple, blueprint.generate_fast(spark, item, n).collect())) for n in (1, 5))
    assert a == b


@given(st.integers(0, 10_000), st.integers(1, 50))
@settings(max_examples=50, deadline=None)
def test_split_rows(total, parts):
    got = control.split_rows(total, parts)
    assert sum(got) == total and len(got) == parts and len(set(got[:-1])) <= 1


def test_threads_and_quota():
    assert control.split_rows(10, 3) == [3, 3, 4]
    assert control.threads_per_process(10, 4) == [2, 2, 3, 3]
    assert control.quota(10, 3) == (3, 3) and control.quota(2, 5) == (2, 1) and control.quota(0, 3) == (0, 0)


def test_rate_controller():
    s, what = control.rate_step(control.RateState(workers=2), 0, 0, 100)
    assert (what, s.workers, s.cooldown) == ("grow", 3, 60)
    s, what = control.rate_step(control.RateState(workers=4), 0, 100, 100)
    assert what == "steady" and s.smoothed == 100
    s, what = control.rate_step(control.RateState(workers=4), 0, 50, 100)
    assert (what, s.workers) == ("grow", 8)
    s, what = control.rate_step(control.RateState(workers=4), 0, 150, 100)
    assert what == "pause" and s.pause == pytest.approx(4 / 100 - 4 / 150)
    s, what = control.rate_step(control.RateState(workers=4), 0, 400, 100)
    assert (what, s.workers) == ("shrink", 1)


def test_streamed_controller_equals_the_fold(spark, tmp_path):
    rates = [5.0, 0.0, 30.0, 80.0, 120.0, 300.0, 90.0]
    spark.createDataFrame([("a", i, r) for i, r in enumerate(rates)], "run string, seq long, rate double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run string, seq long, rate double").parquet(str(tmp_path / "in"))
    q = reports.run_to_table(controller.controller(stream, 100.0), "decisions", str(tmp_path / "cp"), "append")
    q.awaitTermination()
    got = [(r["workers"], r["decision"]) for r in spark.table("decisions").orderBy("seq").collect()]
    s, want = control.RateState(), []
    for i, r in enumerate(rates):
        s, what = control.rate_step(s, i * 10, r, 100.0)
        want.append((s.workers, what))
    assert got == want


def test_windowed_stream_appends_closed_windows(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema.simpleString()[7:-1].replace(":", " ")
    s = reports.event_stream(spark, sf, schema, "events.parquet").select("ts", F.col("event_type").alias("id"), F.col("value").alias("latency"))
    reports.run_to_csv(reports.windowed(s, 86_400).drop("window_start"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.option("header", True).csv(str(tmp_path / "out")).count()
    assert got == spark.read.parquet(f"{sf}/events.parquet").select(F.to_date("ts"), "event_type").distinct().where(f"to_date(ts) < '{spark.read.parquet(f'{sf}/events.parquet').agg(F.to_date(F.max('ts'))).first()[0]}'").count()


def test_elapsed_buckets(spark):
    r = spark.createDataFrame([(1000,), (1010,), (1023,)], "ts long").select(stats.elapsed_bucket(F.col("ts"), F.lit(1000)).alias("b"))
    assert [x[0] for x in r.collect()] == [10, 20, 40]


@given(st.lists(st.floats(0, 1e6), min_size=1, max_size=4000))
@settings(max_examples=30, deadline=None)
def test_digest_quantiles_are_near(values):
    v = np.array(values)
    m, w = digest.compress(v, np.ones(len(v)))
    assert w.sum() == pytest.approx(len(v))
    rank = (np.sort(v) <= digest.quantile(m, w, 0.9) + 1e-9).mean()
    assert len(m) <= digest.COMPRESSION + 3 and rank >= 0.9 - 0.01 - 1 / len(v)


def test_digest_merge_of_saved_statistics(spark):
    rng = np.random.default_rng(1)
    rows, all_values = [], {}
    for host in range(2):
        for t in range(3):
            v = rng.gamma(2.0, 0.01, 500)
            all_values.setdefault(t, []).extend(v)
            m, w = digest.compress(v, np.ones(500))
            text = "".join(f"{a} {b};" for a, b in zip(m, w, strict=True))
            rows.append((1000 + 10 * t, 10 * t, "f", 4, 0, 0, 500, 50, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, text))
    df = spark.createDataFrame(rows, stats.STATS_SCHEMA)
    got = stats.merge_stats(df, with_quantiles=True).orderBy("elapsed").toPandas()
    assert got["threads"].tolist() == [8, 8, 8] and got["tot_ops"].tolist() == [1000, 2000, 3000]
    for t in range(3):
        assert got["p90_ms"][t] == pytest.approx(1000 * np.quantile(all_values[t], 0.9), rel=0.02)
        assert got["mean_ms"][t] == pytest.approx(1000 * np.mean(all_values[t]), rel=1e-3)


def test_merge_sort_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1\n3\n5\nb\n")
    (tmp_path / "b.csv").write_text("2\n4\nB\na\n")
    assert [r[0] for r in ordering.merge_sorted(spark, str(tmp_path)).collect()] == ["1", "2", "3", "4", "5", "B", "a", "b"]


def test_stats_and_schedule_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("x,y\n" + "1,10,f,2,5,0,5,0,1.5,1,2,3,4,5,0.1 2;\n")
    (tmp_path / "x.txt").write_text("no\n")
    assert files.read_stats(spark, str(tmp_path)).collect()[0]["centroids"] == "0.1 2;"
    (tmp_path / "s").write_text("# c, r\n4, 100, 1, 10\n8,,,5\n")
    assert [tuple(r) for r in files.read_schedule(spark, str(tmp_path / "s")).collect()] == [(0, 4, 100, 60, 600), (1, 8, 0, 0, 300)]
    assert [tuple(r) for r in files.read_schedule(spark, "[[4, 1, 2, 3]]").collect()] == [(0, 4, 1, 2, 3)]


def test_named_files_in_every_codec(spark, tmp_path):
    df = spark.range(25).select("id", F.when(F.col("id") % 2 == 0, F.lit("x")).alias("v")).repartition(2)
    for codec in (None, "gzip", "bz2", "xz", "zip"):
        out = sinks.named_files(df, str(tmp_path / str(codec)), "t", compression=codec, max_rows=5).collect()
        assert sum(r["n_rows"] for r in out) == 25 and max(r["n_rows"] for r in out) <= 5
        back = pd.concat([pd.read_csv(p, sep="\t", header=None) for p in (tmp_path / str(codec)).iterdir()])
        assert sorted(back[0]) == list(range(25)) and back[1].isna().sum() == 12


def test_csv_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, 'q"x\ty')], "id long, v string")
    sinks.write_csv(df, str(tmp_path / "o"), compression="gzip", max_rows=1)
    back = spark.read.option("sep", "\t").schema("id long, v string").csv(str(tmp_path / "o"))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_insert_batches_and_stub(spark):
    out = sinks.insert_batches(spark.range(300).coalesce(1), "t").collect()
    assert [r["n_rows"] for r in out] == [128, 128, 44] and out[0]["stmt"].startswith("INSERT INTO t (id) VALUES (0), (1)")
    code = sinks.workload_stub("my_bank", "create table t (a int); select a from t where a = %s; insert into t values (%s, %s) returning a; update t set a = 1")
    compile(code, "stub", "exec")
    assert "class MyBank" in code and "def txn_1(self, spark, p0, p1)" in code and code.count("return spark.sql") == 2


def test_unknown_types_raise():
    with pytest.raises(ValueError, match="interval"):
        ddl.blueprint("create table t (a interval)")
    assert ddl.parse_table('create table "a.b" (k int, constraint x check (k > 0), v decimal(15, 2) not null)')[1] == [("k", ["int"]), ("v", ["decimal", "15:2", "not", "null"])]


def test_arguments_and_connections(tmp_path):
    (tmp_path / "a.yaml").write_text("x: 1\n")
    assert files.load_args(str(tmp_path / "a.yaml")) == {"x": 1} and files.load_args('{"y": 2}') == {"y": 2} and files.load_args(None) == {}
    assert files.connection("postgresql://u:p@h:5/db", application_name="z")["url"] == "jdbc:postgresql://h:5/db?application_name=z"
    with pytest.raises(ValueError):
        files.driver_of("nope")


def test_workload_runs(spark, tmp_path):
    from sluice import workload

    (tmp_path / "tiny_load.py").write_text("class TinyLoad:\n    def __init__(self, args):\n        self.n = args.get('n', 1)\n    def loop(self):\n        return [self.read] * self.n\n    def read(self, spark):\n        return spark.range(3)\n")
    m = workload.run(spark, workload.load(str(tmp_path / "tiny_load.py"), {"n": 2}), 3)
    assert {r["id"]: r["tot_ops"] for r in stats.final_report(m).collect()} == {"read": 6, "__cycle__": 3}


def test_cli_makes_blueprint_and_data(spark, tmp_path):
    from sluice import cli

    (tmp_path / "d.ddl").write_text("create table s.t (a int not null, b varchar(9));")
    assert cli.main(["yaml", "-i", str(tmp_path / "d.ddl"), "-o", str(tmp_path / "d.yaml")]) == 0
    assert cli.main(["csv", "-i", str(tmp_path / "d.yaml"), "-o", str(tmp_path / "out"), "-x", "2"]) == 0
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["s__t.0_0_0.tsv", "s__t.0_1_0.tsv"]


def test_fixed_scalars(spark):
    r = spark.range(1).select(scalars.class_name(F.lit("a_bc")), scalars.driver_of(F.lit("postgresql+psycopg://x")), scalars.format_centroids(scalars.parse_centroids(F.lit("1.5 2.0;")))).first()
    assert tuple(r) == ("ABc", "postgres", "1.5 2.0;")


def test_tables_of_all_kinds_are_named():
    for kind in ("temporary", "temp", "unlogged", "global temporary", "local temp"):
        assert ddl.parse_table(f"create {kind} table if not exists s.t (a int)")[0] == "s__t"


def test_skipped_lines_of_several_files(spark, tmp_path):
    import gzip

    for name, n in (("a", 3), ("b", 5)):
        with gzip.open(tmp_path / f"{name}.json.gz", "wt") as f:
            f.writelines(f'{{"k": "{name}{i}"}}\n\n' if i == 1 else f'{{"k": "{name}{i}"}}\n' for i in range(n))
    got = files.read_json_lines(spark, str(tmp_path), "k string", skip=5).collect()
    # six lines in a with its blank one come first: four, and one of b
    assert sorted(r["k"] for r in got) == ["b1", "b2", "b3", "b4"]


def test_batches_of_upserts_have_a_rest(spark):
    got = [r["n_rows"] for r in sinks.upsert_batches(spark.range(25).coalesce(1).withColumnRenamed("id", "k"), len, 10).collect()]
    assert got == [10, 10, 5]


def test_digests_of_a_hot_key(spark):
    df = spark.range(50_000).select(F.lit("hot").alias("id"), (F.col("id") % 1000).cast("double").alias("latency"))
    q = digest.digest_by(df, ["id"], "latency").select(digest.digest_quantiles("centroids").alias("q")).first()["q"]
    assert q[0] == pytest.approx(499.5, abs=1e-6) and q[1] == pytest.approx(500, abs=10) and q[4] == pytest.approx(990, abs=3) and q[5] == 999


def test_fast_dates_and_times_follow_their_arguments(spark):
    cols = {"d": {"type": "date", "args": {"format": "%d/%m/%Y"}}, "t": {"type": "time", "args": {"micros": True}}, "j": {"type": "json", "args": {"array": 3}}}
    for r in blueprint.generate_fast(spark, {"count": 50, "columns": cols}).collect():
        assert r["d"][2] == r["d"][5] == "/" and len(r["t"]) == 15 and r["j"].startswith('{"k":"')


def test_the_controller_is_the_same_as_a_table_and_step_by_step(spark):
    rng = random.Random(3)
    rates = [(g, k, rng.choice([0.0, 5.0, 90.0, 110.0, 250.0]) + rng.random()) for g in "ab" for k in range(60)]
    got = control.controller_run(spark.createDataFrame(rates, "grp string, seq long, rate double"), 100.0, workers=3, ramp_s=5.0).collect()
    for g in "ab":
        s = control.RateState(workers=3)
        for r, (_, k, rate) in zip(sorted((r for r in got if r["grp"] == g), key=lambda r: r["seq"]), (x for x in rates if x[0] == g), strict=True):
            s, what = control.rate_step(s, k * 10.0, rate, 100.0, 5.0)
            assert (r["workers"], r["decision"]) == (s.workers, what) and r["pause"] == pytest.approx(s.pause)


def test_commands(spark, tmp_path, capsys):
    from sluice import cli

    ddl_file, yaml_file, out = tmp_path / "t.sql", tmp_path / "t.yaml", tmp_path / "out"
    ddl_file.write_text("create table s.t (a int not null, b varchar(20), c bool);\nselect * from t where a = %s;\ninsert into t values (%s, %s, %s);\n")
    assert cli.main(["yaml", "-i", str(ddl_file), "-o", str(yaml_file)]) == 0 and "s__t" in yaml_file.read_text()
    assert cli.main(["csv", "-i", str(yaml_file), "-o", str(out), "-x", "3", "-m", "10"]) == 0
    lines = [line for f in sorted(out.iterdir()) for line in f.read_text().splitlines()]
    assert len(lines) == 100 and all(line.count("\t") == 2 for line in lines)
    assert cli.main(["gen-stub", "-i", str(ddl_file)]) == 0 and (tmp_path / "t.py").read_text().count("def txn_") == 2
    for name, part in (("a.txt", "b\nd\nf\n"), ("b.txt", "a\nc\ne\n")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(part)
    assert cli.main(["merge-sort", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "sorted"), "-m", "4"]) == 0
    merged = [f.read_text().split() for f in sorted((tmp_path / "sorted").glob("part-*"))]
    assert sum(merged, []) == list("abcdef") and all(len(m) <= 4 for m in merged)
    stats_dir = tmp_path / "stats"
    stats_dir.mkdir()
    head = "ts,elapsed,id,threads,tot_ops,tot_ops_s,period_ops,period_ops_s,mean_ms,p50_ms,p90_ms,p95_ms,p99_ms,max_ms,centroids\n"
    for host in "xy":
        (stats_dir / f"{host}.csv").write_text(head + "".join(f'{1000 + 10 * k},{10 + 10 * k},f,2,{5 * (k + 1)},0,5,0,1,1,1,1,{k + 1},1,"0.001 4;0.003 1;"\n' for k in range(4)))
    assert cli.main(["merge-csvs", "-i", str(stats_dir), "-o", str(tmp_path / "both")]) == 0
    rows = sorted(files.read_stats(spark, str(tmp_path / "both")).collect(), key=lambda r: r["elapsed"])
    assert [r["period_ops"] for r in rows] == [10] * 4 and [r["threads"] for r in rows] == [4] * 4 and rows[0]["max_ms"] == pytest.approx(3.0)
    assert cli.main(["html", "-i", str(stats_dir), "-o", str(tmp_path / "c.html")]) == 0 and (tmp_path / "c.html").read_text().count("<polyline") == 4
    capsys.readouterr()
    assert cli.main(["plot", "-i", str(stats_dir)]) == 0 and capsys.readouterr().out.startswith("f ")
