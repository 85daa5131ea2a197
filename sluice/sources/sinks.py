"""Writers: delimited files with row limits and compression, statistics, blueprints, batches, class stubs."""

from __future__ import annotations

import os
import shutil
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODECS = {"gzip": "gzip", "bz2": "bzip2", None: "none"}
SUFFIX = {None: "", "gzip": ".gz", "bz2": ".bz2", "xz": ".xz", "zip": ".zip"}
MAX_ROWS, BATCH_INSERT, BATCH_VECTORS = 100_000, 128, 1000


def extension(delimiter: str) -> str:
    return "tsv" if delimiter == "\t" else "csv"


def write_csv(df: DataFrame, path: str, delimiter: str = "\t", compression: str | None = None, max_rows: int = MAX_ROWS, mode: str = "error") -> None:
    """Delimited files without header, each of at most max_rows, nulls as empty fields. Spark has no xz and zip; those go through named_files."""
    if compression not in CODECS:
        raise ValueError(f"{compression} is written by named_files")
    df.write.mode(mode).option("sep", delimiter).option("maxRecordsPerFile", max_rows).option("compression", CODECS[compression]).option("emptyValue", "").option("nullValue", "").csv(path)


def named_files(df: DataFrame, folder: str, table: str, item: int = 0, delimiter: str = "\t", compression: str | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """Files named table.item_partition_chunk.ext in a folder that all executors share; a row (name, n_rows) for each. Every codec is available.

    A task writes one file at a time, max_rows in memory at most; a repeated task writes the same names anew.
    """
    from pyspark import TaskContext

    cols = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        held, count, chunk, done = [], 0, 0, []

        def put(rows: pd.DataFrame) -> None:
            name = f"{table}.{item}_{part}_{chunk}.{extension(delimiter)}{SUFFIX[compression]}"
            rows.to_csv(os.path.join(folder, name), sep=delimiter, header=False, index=False, columns=cols, compression=compression)
            done.append((name, len(rows)))

        for pdf in batches:
            held.append(pdf)
            count += len(pdf)
            while count >= max_rows:
                pdf = pd.concat(held)
                put(pdf.iloc[:max_rows])
                chunk += 1
                held, count = [pdf.iloc[max_rows:]], count - max_rows
        if count:
            put(pd.concat(held))
        yield pd.DataFrame(done, columns=["name", "n_rows"])

    os.makedirs(folder, exist_ok=True)
    return df.mapInPandas(run, "name string, n_rows long")


def write_stats(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def insert_batches(df: DataFrame, table: str, size: int = BATCH_INSERT) -> DataFrame:
    """(n_rows, stmt) of multi-row INSERT statements, size rows each and the rest, made where the rows are."""
    cols = df.columns

    def lit(v) -> str:
        if v is None or v != v:
            return "NULL"
        return str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                held.append("(" + ", ".join(map(lit, row)) + ")")
                if len(held) == size:
                    out.append((size, f"INSERT INTO {table} ({', '.join(cols)}) VALUES {', '.join(held)}"))
                    held = []
            yield pd.DataFrame(out, columns=["n_rows", "stmt"])
        if held:
            yield pd.DataFrame([(len(held), f"INSERT INTO {table} ({', '.join(cols)}) VALUES {', '.join(held)}")], columns=["n_rows", "stmt"])

    return df.mapInPandas(run, "n_rows long, stmt string")


def upsert_batches(df: DataFrame, put, size: int = BATCH_VECTORS) -> DataFrame:
    """(n_rows) of each batch given to put, which runs where the rows are: size rows each, and the rest."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, done = [], []
        for pdf in batches:
            for row in pdf.to_dict("records"):
                held.append(row)
                if len(held) == size:
                    put(held)
                    done.append(len(held))
                    held = []
        if held:
            put(held)
            done.append(len(held))
        yield pd.DataFrame({"n_rows": done})

    return df.mapInPandas(run, "n_rows long")


def write_jdbc(df: DataFrame, uri: str, table: str, size: int = BATCH_INSERT) -> None:
    from sluice.sources.files import connection

    df.write.format("jdbc").options(**connection(uri)).option("dbtable", table).option("batchsize", size).mode("append").save()


def back_up(path: str) -> str | None:
    """Move what is at path aside under the time's name; the new name."""
    if not os.path.exists(path):
        return None
    to = f"{path}.{time.strftime('%Y%m%d_%H%M%S', time.gmtime())}"
    shutil.move(path, to)
    return to


def write_blueprint(bp: dict, path: str) -> None:
    import yaml

    back_up(path)
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(bp, f, sort_keys=False)


def format_sql(stmt: str) -> str:
    """A statement with its keywords in upper case and a line for each clause."""
    import re

    words = "select from where and or insert into values update set delete returning order by group limit join left on as upsert having union all".split()
    out = re.sub(r"\b(" + "|".join(words) + r")\b", lambda m: m[1].upper(), " ".join(stmt.split()), flags=re.I)
    return re.sub(r" (FROM|WHERE|VALUES|SET|RETURNING|ORDER BY|GROUP BY|LIMIT|HAVING|UNION)\b", r"\n\1", out)


def workload_stub(name: str, script: str) -> str:
    """A workload class with a function for each of a script's statements; queries get their rows as DataFrames."""
    camel = "".join(p.capitalize() for p in name.split("_"))
    import re

    text = re.sub(r"--[^\n]*", "", re.sub(r"/\*.*?\*/", "", script, flags=re.S))
    stmts = [s.strip() for s in text.split(";") if s.strip() and not s.strip().lower().startswith("create")]
    lines = [f"class {camel}:", "    def __init__(self, args: dict):", "        self.args = args", "", "    def loop(self):", f"        return [{', '.join(f'self.txn_{i}' for i in range(len(stmts)))}]"]
    for i, s in enumerate(stmts):
        low = s.lower()
        marks = s.count("%s")
        args = ", ".join(f"p{k}" for k in range(marks))
        keep = "return " if low.startswith("select") or "returning" in low else ""
        lines += ["", f"    def txn_{i}(self, spark{', ' + args if args else ''}):", f'        {keep}spark.sql("""', *["            " + x for x in format_sql(s.replace("%s", "?")).splitlines()], f'        """{", args=[" + args + "]" if args else ""})']
    return "\n".join(lines) + "\n"


def metrics_rows(report: DataFrame) -> DataFrame:
    from sluice.operators.stats import gauges

    return gauges(report).withColumn("line", F.concat("metric", F.lit('{id="'), "id", F.lit('"} '), F.col("value").cast("string")))
