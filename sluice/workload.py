"""Workloads as classes: named functions over DataFrames, found by file and class name, with loop() giving a cycle."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sluice.sources.generators import load_custom


def load(path: str, args: dict | None = None) -> Any:
    """An instance of the class that a file is named after."""
    return load_custom(path)(args or {})


def run(spark: SparkSession, workload: Any, iterations: int, worker: int = 0) -> DataFrame:
    """Measurements of so many cycles: (ts, worker, cycle, id, latency), a row for each function and one __cycle__ each."""
    if hasattr(workload, "setup"):
        workload.setup(spark, worker, 1)
    rows = []
    for c in range(iterations):
        begin = time.time()
        for f in workload.loop():
            t = time.time()
            out = f(spark)
            if isinstance(out, DataFrame):
                out.write.format("noop").mode("overwrite").save()
            rows.append((t, worker, c, f.__name__, time.time() - t))
        rows.append((begin, worker, c, "__cycle__", time.time() - begin))
    df = spark.createDataFrame(rows, "ts double, worker long, cycle long, id string, latency double")
    return df.withColumn("ts", df["ts"].cast("timestamp"))
