"""Generated tables and blueprints: every generator in the seeded and in the fast form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources import blueprint as bp
from sluice.sources.ddl import blueprint, type_and_args

DDL = """
/* accounts */
CREATE TABLE IF NOT EXISTS bank.orders (
    acc_no BIGINT NOT NULL, id UUID NOT NULL, status VARCHAR(30) NOT NULL, amount DECIMAL(15, 2), -- money
    ts TIMESTAMPTZ, flag BOOL, d DATE, t TIME, b BYTES, j JSONB, bits BIT(10), tags STRING[], small INT2,
    PRIMARY KEY (acc_no, id), INDEX (ts)
);
INSERT INTO x VALUES (1);
"""
TYPES = ["bool", "int2", "int4", "int", "bigint", "varchar(30)", "string", "decimal(15,2)", "decimal(5)", "float", "time", "json", "date", "timestamp", "uuid", "bit(10)", "bytes", "int[]"]
#: (type, arguments, what a value looks like) of each generator.
GENERATORS = {
    "constant": ({"value": "x"}, "^x$"),
    "sequence": ({"start": 5}, "^[0-9]+$"),
    "uuid": ({}, "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"),
    "timestamp": ({}, r"^20[0-2][0-9]-[01][0-9]-[0-3][0-9] [0-2][0-9]:[0-5][0-9]:[0-5][0-9]\.[0-9]{6}$"),
    "date": ({}, "^20[0-2][0-9]-[01][0-9]-[0-3][0-9]$"),
    "time": ({}, "^(0[7-9]|1[0-9]|2[0-2]):[0-5][0-9]:[0-5][0-9]$"),
    "string": ({"min": 3, "max": 9}, "^[a-zA-Z0-9]{3,9}$"),
    "json": ({}, '^\\{"k":"[a-zA-Z0-9]+"\\}$'),
    "integer": ({"min": 1, "max": 1000}, "^([1-9][0-9]{0,2}|1000)$"),
    "bit": ({"size": 7}, "^[01]{7}$"),
    "bool": ({}, "^[01]$"),
    "float": ({"min": 0, "max": 100, "round": 2}, r"^[0-9]{1,2}(\.[0-9]{1,2})?$"),
    "bytes": ({"size": 20}, r"^\\x[0-9a-f]{20}$"),
    "choice": ({"population": ["a", "b", "c"], "weights": [5, 3, 2]}, "^[abc]$"),
}
ROWS = 2000


def _kind(kind: str, fast: bool):
    args, pattern = GENERATORS[kind]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        item = {"count": ROWS, "sort-by": [], "columns": {"v": {"type": kind, "args": {**args, "seed": 3, **({} if kind == "sequence" else {"null_pct": 0.0})}}}}
        df = bp.generate_fast(spark, item, 4) if fast else bp.generate(spark, item, 4)
        v = F.col("v").cast("string")
        return df.agg(F.count("*").alias("n"), F.count_if(v.rlike(pattern)).alias("good"), F.count_if(v.isNull()).alias("nulls"))

    return run


def gen_nulls(spark: SparkSession, sf: str) -> DataFrame:
    item = {"count": 10_000, "columns": {"v": {"type": "integer", "args": {"seed": 1, "null_pct": 0.3}}}}
    return bp.generate(spark, item, 4).agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).between(2700, 3300).alias("as_asked"))


def gen_array(spark: SparkSession, sf: str) -> DataFrame:
    item = {"count": 500, "columns": {"v": {"type": "integer", "args": {"seed": 1, "array": 3, "min": 1, "max": 9}}}}
    return bp.generate(spark, item, 2).agg(F.count_if(F.col("v").rlike(r"^\{[1-9],[1-9],[1-9]\}$")).alias("good"))


def gen_seeder_golden(spark: SparkSession, sf: str) -> DataFrame:
    item = {"count": 6, "columns": {"v": {"type": "uuid", "args": {"seed": 1}}}}
    return bp.generate(spark, item, 1).select(F.substring("v", 1, 8).alias("v")).limit(3)


#: The published rows of a table with one string and one integer column, both seeded with 0, made in two shards.
SEEDER = "3Ml 455 9EV 349 B9O 266 EuR 730 Got 902 H1a 64 IVi 75 IkS 305 NcM 750 Nn2 150 RXg 995 ULm 409 VOO 128 WTc 427 gBm 972 hXE 730 lqC 550 o6H 364 sD8 867 yiq 556".split()


def gen_seeder_rows(spark: SparkSession, sf: str) -> DataFrame:
    item = {"count": 20, "columns": {"mystr": {"type": "string", "args": {"seed": 0, "min": 3, "max": 3}}, "myint": {"type": "integer", "args": {"seed": 0, "max": 1000}}}}
    return bp.generate(spark, item, 2)


def gen_fast_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Values of an array differ; bounds of 0 are bounds."""
    args = {"string": {"min": 0, "max": 2}, "integer": {"min": 0, "max": 9}, "float": {"min": 0, "max": 1}}
    item = {"count": 3000, "columns": {k: {"type": k, "args": a | {"seed": 1}} for k, a in args.items()} | {"several": {"type": "integer", "args": {"min": 0, "max": 9, "seed": 2, "array": 3}}}}
    df = bp.generate_fast(spark, item, 4)
    parts = F.split(F.regexp_replace("several", "[{}]", ""), ",")
    return df.agg(F.min(F.length("string")).alias("shortest"), F.max(F.length("string")).alias("longest"), F.min("integer").alias("low"), F.max("integer").alias("high"), F.max("float").alias("top"), F.count_if(F.size(F.array_distinct(parts)) > 1).between(2900, 3000).alias("differ"), F.min(F.size(parts)).alias("size"))


def gen_payloads(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.range(2000).select(bp.kv_payload("bytes", 16).alias("b"), bp.kv_payload("uuid", 0).alias("u"), bp.kv_payload("int", 0).alias("i"), bp.kv_payload("string", 12).alias("s"), bp.kv_payload("fixed", 0, value="x").alias("f"), bp.amount().alias("a"))
    return rows.agg(F.min(F.length("b")).alias("n_bytes"), F.count_distinct("u").alias("uuids"), F.count_if(F.col("i") >= 0).alias("ints"), F.min(F.length("s")).alias("n_chars"), F.max("f").alias("fixed"), (F.avg("a").between(480_000, 520_000) & (F.max("a") < 1_000_000) & (F.min("a") >= 0)).alias("amounts"))


def gen_unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = spark.range(200).select(bp.unit_vector(384).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return v.agg(F.count_if(F.abs(length - 1) < 1e-9).alias("units"), F.count_distinct(F.col("v")[0]).alias("different"), F.max(F.size("v")).alias("size"))


def gen_table_fk(spark: SparkSession, sf: str) -> DataFrame:
    """Child rows whose key column has its parent's seed: the first rows of both agree."""
    key = {"type": "uuid", "args": {"seed": 7}}
    p = bp.generate(spark, {"count": 1000, "columns": {"id": key}}, 1)
    c = bp.generate_table(spark, [{"count": 200, "columns": {"p_id": key}}, {"count": 800, "columns": {"p_id": key}}], 1)
    return c.join(p, c["p_id"] == p["id"], "left_anti").agg(F.count("*").alias("orphans"))


def gen_bank_orders(spark: SparkSession, sf: str) -> DataFrame:
    item = blueprint(DDL, seed=1, count=500)["bank__orders"][0] | {"sort-by": ["acc_no"]}
    df = bp.generate(spark, item, 2)
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("acc_no").isNull()).alias("null_keys"), F.lit(len(df.columns)).alias("n_cols"))


def gen_bank_fast(spark: SparkSession, sf: str) -> DataFrame:
    item = blueprint(DDL, seed=1, count=50_000)["bank__orders"][0]
    df = bp.generate_fast(spark, item)
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("acc_no").isNull()).alias("null_keys"), F.lit(len(df.columns)).alias("n_cols"))


def ddl_types(spark: SparkSession, sf: str) -> DataFrame:
    from sluice.sources.ddl import parse_table

    rows = []
    for i, t in enumerate(TYPES):
        _, cols = parse_table(f"create table t (c {t})")
        rows.append((i, t, type_and_args(cols[0][1])["type"]))
    return spark.createDataFrame(rows, "i int, ddl string, kind string")


def blueprint_bounds(spark: SparkSession, sf: str) -> DataFrame:
    cols = blueprint(DDL, seed=1)["bank__orders"][0]["columns"]
    rows = [(c, d["type"], float(d["args"].get("max", -1)) if "max" in d["args"] else None, d["args"]["array"]) for c, d in cols.items()]
    return spark.createDataFrame(rows, "col string, kind string, high double, arr int")


KINDS = ["bool", "integer", "integer", "integer", "integer", "string", "string", "float", "float", "float", "time", "json", "date", "timestamp", "uuid", "bit", "bytes", "integer"]
BOUNDS = [("acc_no", "integer", float(2**63 - 1), 0), ("id", "uuid", None, 0), ("status", "string", 30.0, 0), ("amount", "float", 1e13, 0), ("ts", "timestamp", None, 0), ("flag", "bool", None, 0), ("d", "date", None, 0), ("t", "time", None, 0), ("b", "bytes", None, 0), ("j", "json", 50.0, 0), ("bits", "bit", None, 0), ("tags", "string", 30.0, 3), ("small", "integer", 32767.0, 0)]


def _values(rows: list[tuple], names: str, casts: str) -> str:
    lit = lambda v: "null" if v is None else repr(v) if isinstance(v, (int, float)) else "'" + v + "'"
    return f"select {casts} from (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names})"


QUERIES = {f"gen_{k}": (_kind(k, False), f"select {ROWS}::bigint as n, {ROWS}::bigint as good, 0::bigint as nulls") for k in GENERATORS}
QUERIES |= {f"gen_fast_{k}": (_kind(k, True), f"select {ROWS}::bigint as n, {ROWS}::bigint as good, 0::bigint as nulls") for k in GENERATORS}
QUERIES |= {
    "gen_nulls": (gen_nulls, "select 10000::bigint as n, true as as_asked"),
    "gen_array": (gen_array, "select 500::bigint as good"),
    "gen_seeder_golden": (gen_seeder_golden, "select unnest(['19578af7', '877c814b', 'ceff7bf0']) as v"),
    "gen_seeder_rows": (gen_seeder_rows, _values([(a, int(b)) for a, b in zip(SEEDER[::2], SEEDER[1::2], strict=True)], "mystr, myint", "mystr, myint::bigint as myint")),
    "gen_fast_arrays": (gen_fast_arrays, "select 0 as shortest, 2 as longest, 0::bigint as low, 9::bigint as high, 0.0::double as top, true as differ, 3 as size"),
    "gen_payloads": (gen_payloads, "select 16 as n_bytes, 2000::bigint as uuids, 2000::bigint as ints, 12 as n_chars, 'x' as fixed, true as amounts"),
    "gen_unit_vectors": (gen_unit_vectors, "select 200::bigint as units, 200::bigint as different, 384 as size"),
    "gen_table_fk": (gen_table_fk, "select 0::bigint as orphans"),
    "gen_bank_orders": (gen_bank_orders, "select 500::bigint as n, 0::bigint as null_keys, 13 as n_cols"),
    "gen_bank_fast": (gen_bank_fast, "select 50000::bigint as n, 0::bigint as null_keys, 13 as n_cols"),
    "ddl_types": (ddl_types, _values([(i, t, k) for i, (t, k) in enumerate(zip(TYPES, KINDS, strict=True))], "i, ddl, kind", "i, ddl, kind")),
    "blueprint_bounds": (blueprint_bounds, _values(BOUNDS, "col, kind, high, arr", "col, kind, high::double as high, arr")),
}
