"""Sorting and splitting: merge of sorted line files, row-limited outputs, sorting of some columns only, import statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.session import stored

#: Rows of an output file, files of an import statement.
MAX_ROWS, IMPORT_FILES = 100_000, 20


def merge_sorted(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of all files in code point order: a range-partitioned sort, so it needs no single merger."""
    return spark.read.text(paths if isinstance(paths, str) else list(paths)).orderBy("value")


def ranked(df: DataFrame, order: Sequence[str], name: str = "rn", parts: int | None = None) -> DataFrame:
    """df with a gapless row number in order from 0, without bringing all rows into one task.

    Rows are range-partitioned and sorted; numbers are local plus the sizes of the partitions before.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written before it is read twice: sampled bounds and adaptive partitions may differ between two runs
    cut = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "ranked")
    sizes = cut.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("lo"))
    w = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sizes = sizes.withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return cut.join(F.broadcast(sizes.select("_p", "lo", "base")), "_p").withColumn(name, F.col("_m") - F.col("lo") + F.col("base")).drop("_p", "_m", "lo", "base")


def running_sum(df: DataFrame, order: str, value: str, name: str, parts: int | None = None) -> DataFrame:
    """df with the sum of value up to each row in order (unique), without bringing all rows into one task."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(df.repartitionByRange(n, order).withColumn("_p", F.spark_partition_id()), "sums")
    own = Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    totals = cut.groupBy("_p").agg(F.sum(value).alias("_t")).select("_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    return cut.withColumn("_own", F.sum(value).over(own)).join(F.broadcast(totals), "_p").withColumn(name, F.col("_own") + F.col("_base")).drop("_p", "_own", "_base")


def sort_subset(df: DataFrame, sort_by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Only the sort-by columns sorted; the others keep the given order. The sorted part is joined back by row number."""
    rest = [c for c in df.columns if c not in sort_by]
    a = ranked(df.select(*sort_by), sort_by)
    b = ranked(df.select(*rest, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]), [f"_o{i}" for i in range(len(order))])
    return a.join(b, "rn").select("rn", *df.columns)


def write_sorted(spark: SparkSession, src: str | Sequence[str], dest: str, max_rows: int = MAX_ROWS, gzip: bool = False) -> None:
    """The merged lines as files of at most max_rows, in order of their names."""
    w = merge_sorted(spark, src).write.option("maxRecordsPerFile", max_rows)
    (w.option("compression", "gzip") if gzip else w).text(dest)


def import_statements(files: DataFrame, table: str, delimiter: str = "\t", n: int = IMPORT_FILES) -> DataFrame:
    """(chunk, stmt): bulk-load statements for n files each, of the files named after the table. files: a row a file."""
    own = files.where(F.col("name").startswith(table + "."))
    own = ranked(own, ["name"]).withColumn("chunk", F.floor(F.col("rn") / n).cast("long"))
    g = own.groupBy("chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("name")), lambda x: F.concat(F.lit("    'http://localhost:3000/"), x, F.lit("'"))), ",\n").alias("list"))
    tail = f"\n) WITH delimiter = e'{delimiter}', nullif = '';" if delimiter != "\t" else "\n) WITH delimiter = e'\\t', nullif = '';"
    return g.select("chunk", F.concat(F.lit(f"IMPORT INTO {table.replace('__', '.')} CSV DATA (\n"), "list", F.lit(tail)).alias("stmt"))
