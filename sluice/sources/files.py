"""Readers of the files around a run: statistics, schedules, arguments, scripts, JSON lines, connections."""

from __future__ import annotations

import json
import os
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.scalars import DRIVERS, statements
from sluice.operators.ordering import ranked
from sluice.operators.stats import STATS_SCHEMA


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics of one file or a folder's .csv files under their fixed names, whatever the header says."""
    return spark.read.schema(STATS_SCHEMA).option("header", True).option("enforceSchema", True).option("pathGlobFilter", "*.csv").csv(path)


def read_schedule(spark: SparkSession, source: str) -> DataFrame:
    """(step, connections, max_rate, ramp, duration) in seconds: a CSV in minutes with # comments and blanks as 0, or inline JSON in seconds."""
    cols = ["connections", "max_rate", "ramp", "duration"]
    if source.lstrip().startswith("["):
        rows = [tuple(int(x or 0) for x in (r if isinstance(r, list) else [r.get(c) for c in cols])) for r in json.loads(source)]
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "step long, " + ", ".join(f"{c} long" for c in cols))
    df = spark.read.option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).schema(", ".join(f"{c} BIGINT" for c in cols)).csv(source)
    df = df.coalesce(1).withColumn("step", F.monotonically_increasing_id()).na.fill(0)  # a schedule is a few lines, in order
    return df.select("step", "connections", "max_rate", (F.col("ramp") * 60).alias("ramp"), (F.col("duration") * 60).alias("duration"))


def load_args(source: str | None) -> dict:
    """Arguments from inline JSON or YAML, or from a file of either."""
    if not source:
        return {}
    text = source
    if os.path.exists(source):
        with open(source, encoding="utf-8") as f:
            text = f.read()
    try:
        got = json.loads(text)
    except ValueError:
        import yaml

        got = yaml.safe_load(text)
    if not isinstance(got, dict):
        raise ValueError("arguments must be a mapping")
    return got


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """(pos, stmt) of each statement of each SQL script."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(statements(F.col("value"))).alias("pos", "stmt"))


def read_json_lines(spark: SparkSession, path: str, schema: str, skip: int = 0) -> DataFrame:
    """JSON lines (also compressed) without blank lines and the first ones to skip."""
    raw = spark.read.text(path)
    if skip:
        # the order is that of the files' names and of the lines in them
        raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
        raw = ranked(raw, ["file", "line"]).where(F.col("rn") >= skip)
    raw = raw.where(F.trim("value") != "")
    return raw.select(F.from_json("value", schema).alias("r")).select("r.*")


def driver_of(scheme: str) -> str:
    if scheme not in DRIVERS:
        raise ValueError(f"unknown scheme {scheme!r}")
    return DRIVERS[scheme]


def connection(uri: str, **query: str) -> dict:
    """The JDBC options of a connection string; query parameters are added to it."""
    p = urlsplit(uri)
    q = urlencode([*parse_qsl(p.query), *query.items()])
    kind = driver_of(p.scheme)
    host = p.hostname or "localhost"
    at = f"{host}:{p.port}" if p.port else host
    names = {"postgres": ("postgresql", "org.postgresql.Driver"), "mysql": ("mysql", "com.mysql.cj.jdbc.Driver"), "maria": ("mariadb", "org.mariadb.jdbc.Driver"), "oracle": ("oracle:thin", "oracle.jdbc.OracleDriver")}
    if kind not in names:
        return {"driver": kind, "uri": urlunsplit(p._replace(query=q))}
    sub, cls = names[kind]
    url = f"jdbc:{sub}:@{at}{p.path}" if kind == "oracle" else f"jdbc:{sub}://{at}{p.path}" + (f"?{q}" if q else "")
    return {"url": url, "driver": cls} | ({"user": p.username} if p.username else {}) | ({"password": p.password} if p.password else {})


def read_jdbc(spark: SparkSession, uri: str, query: str, key: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1) -> DataFrame:
    """A query's rows over JDBC, split by a numeric key so that executors read in parallel."""
    r = spark.read.format("jdbc").options(**connection(uri)).option("dbtable", f"({query}) q")
    if key:
        r = r.options(partitionColumn=key, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts))
    return r.load()


def read_blueprint(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def sibling_blueprint(workload_path: str, workload=None) -> dict:
    """The blueprint beside a workload's file, or the one in its class."""
    at = os.path.splitext(workload_path)[0] + ".yaml"
    if os.path.exists(at):
        return read_blueprint(at)
    load = getattr(workload, "load", None)
    if load is None:
        raise FileNotFoundError(at)
    return load if isinstance(load, dict) else __import__("yaml").safe_load(load)
