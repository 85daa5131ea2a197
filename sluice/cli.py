"""python -m sluice.cli: csv, yaml, merge-sort, merge-csvs, html, plot, gen-stub, run."""

from __future__ import annotations

import argparse
from pathlib import Path

from sluice.session import session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sluice")
    sub = p.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("csv", help="generate a blueprint's tables")
    a.add_argument("-i", "--input", required=True)
    a.add_argument("-o", "--output", required=True)
    a.add_argument("-x", "--shards", type=int, default=8)
    a.add_argument("-d", "--delimiter", default="\t")
    a.add_argument("-c", "--compression", choices=["gzip", "bz2", "xz", "zip"])
    a.add_argument("-m", "--max-rows", type=int, default=100_000)
    a.add_argument("--fast", action="store_true", help="by expressions, not exact to the seeds")
    a = sub.add_parser("yaml", help="a blueprint from table definitions")
    a.add_argument("-i", "--input", required=True)
    a.add_argument("-o", "--output", required=True)
    a = sub.add_parser("merge-sort", help="merge sorted line files")
    a.add_argument("-i", "--input", required=True)
    a.add_argument("-o", "--output", required=True)
    a.add_argument("-m", "--max-rows", type=int, default=100_000)
    a.add_argument("--gzip", action="store_true")
    a = sub.add_parser("merge-csvs", help="statistics of several hosts as one")
    a.add_argument("-i", "--input", required=True)
    a.add_argument("-o", "--output", required=True)
    a = sub.add_parser("html", help="a chart of statistics")
    a.add_argument("-i", "--input", required=True)
    a.add_argument("-o", "--output", required=True)
    a = sub.add_parser("plot", help="a figure of statistics as text")
    a.add_argument("-i", "--input", required=True)
    a.add_argument("-f", "--figure", default="p99_ms", choices=["p99_ms", "mean_ms", "period_ops_s", "threads"])
    a = sub.add_parser("gen-stub", help="a workload class from a script")
    a.add_argument("-i", "--input", required=True)
    a = sub.add_parser("run", help="cycles of a workload, and their report")
    a.add_argument("-w", "--workload", required=True)
    a.add_argument("-n", "--iterations", type=int, default=1)
    a.add_argument("--args", default="")
    o = p.parse_args(argv)

    from sluice.sources import sinks

    if o.cmd == "yaml":
        from sluice.sources.ddl import blueprint

        sinks.write_blueprint(blueprint(Path(o.input).read_text()), o.output)
        return 0
    if o.cmd == "gen-stub":
        at = Path(o.input)
        at.with_suffix(".py").write_text(sinks.workload_stub(at.stem, at.read_text()))
        return 0
    spark = session()
    if o.cmd == "csv":
        from sluice.sources.blueprint import generate, generate_fast
        from sluice.sources.files import read_blueprint

        sinks.back_up(o.output)
        for table, items in read_blueprint(o.input).items():
            for k, item in enumerate(items):
                df = generate_fast(spark, item, o.shards) if o.fast else generate(spark, item, o.shards)
                sinks.named_files(df, o.output, table, k, o.delimiter, o.compression, o.max_rows).show(truncate=False)
    elif o.cmd == "merge-sort":
        from sluice.operators.ordering import write_sorted

        write_sorted(spark, o.input, o.output, o.max_rows, o.gzip)
    elif o.cmd == "merge-csvs":
        from sluice.operators.stats import merge_stats
        from sluice.sources.files import read_stats

        sinks.write_stats(merge_stats(read_stats(spark, o.input), with_quantiles=True).orderBy("elapsed", "id"), o.output, mode="error")
    elif o.cmd == "plot":
        from sluice.operators.stats import terminal_chart
        from sluice.sources.files import read_stats

        print(terminal_chart(read_stats(spark, o.input), o.figure))
    elif o.cmd == "html":
        from sluice.operators.stats import html_chart
        from sluice.sources.files import read_stats

        Path(o.output).write_text(html_chart(read_stats(spark, o.input)))
    else:
        from sluice import workload
        from sluice.operators.stats import final_report
        from sluice.sources.files import load_args

        final_report(workload.run(spark, workload.load(o.workload, load_args(o.args)), o.iterations)).orderBy("id").show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
