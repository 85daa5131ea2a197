"""Tables from blueprints: a seeded data source, exact to the draw, and a fast form in column expressions.

The seeded form has one input partition for each shard; a shard is made in batches, so its size doesn't
matter to memory. The fast form is a projection over spark.range, values depending on row id and seed only, not on partitions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sluice.functions.scalars import strftime
from sluice.operators.control import split_rows
from sluice.sources.ddl import struct_of
from sluice.sources.generators import make

BATCH = 8192


class Shard(InputPartition):
    def __init__(self, index: int, rows: int):
        super().__init__(index)
        self.index, self.rows = index, rows


class BlueprintReader(DataSourceReader):
    def __init__(self, columns: dict, count: int, shards: int, schema: StructType):
        self.columns, self.count, self.shards, self.schema = columns, count, shards, schema

    def partitions(self) -> list[InputPartition]:
        return [Shard(i, n) for i, n in enumerate(split_rows(self.count, self.shards))]

    def read(self, partition: Shard) -> Iterator:
        import pyarrow as pa

        gens = {c: make(d["type"], d.get("args", {}), partition.index, self.shards, self.count) for c, d in self.columns.items()}
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
        left = partition.rows
        while left > 0:
            n = min(BATCH, left)
            cols = []
            for f in self.schema:
                kind = kinds[f.dataType.simpleString()]
                vals = [next(gens[f.name]) for _ in range(n)]
                cols.append(pa.array([None if v is None else str(v) for v in vals] if kind == pa.string() else vals, kind))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in self.schema])
            left -= n


class BlueprintSource(DataSource):
    """spark.read.format("blueprint") with the options columns (JSON), count and shards."""

    @classmethod
    def name(cls) -> str:
        return "blueprint"

    def schema(self) -> StructType:
        return struct_of(json.loads(self.options["columns"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return BlueprintReader(json.loads(self.options["columns"]), int(self.options.get("count", 100)), int(self.options.get("shards", 1)), schema)


def generate(spark: SparkSession, item: dict, shards: int = 1) -> DataFrame:
    """One dataset of a blueprint, exact to the seeds; sort-by sorts whole rows within shards."""
    spark.dataSource.register(BlueprintSource)
    df = spark.read.format("blueprint").options(columns=json.dumps(item["columns"]), count=item["count"], shards=shards).load()
    return df.sortWithinPartitions(*item["sort-by"]) if item.get("sort-by") else df


def generate_table(spark: SparkSession, items: list[dict], shards: int = 1) -> DataFrame:
    """All datasets of a table, one after the other."""
    out = None
    for item in items:
        df = generate(spark, item, shards)
        out = df if out is None else out.unionByName(df)
    return out


def _u(seed: int, salt: int) -> Column:
    """A number from 0 to 1 of the row's id, the column's seed and a salt."""
    return F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(salt)), 11).cast("double") / F.lit(float(1 << 53))


def _int(u: Column, lo: int, hi: int) -> Column:
    return (F.floor(u * F.lit(float(hi - lo + 1))) + F.lit(lo)).cast("long")


def _chars(seed: int, size: Column | int, alphabet: str) -> Column:
    n = size if isinstance(size, Column) else F.lit(size)
    pick = lambda i: F.substring(F.lit(alphabet), F.pmod(F.xxhash64("id", F.lit(seed), i), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), pick), "")


LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def _fast_value(kind: str, args: dict, seed: int) -> Column:
    """One value of a column; another seed gives another draw."""
    u = _u(seed, 0)
    given = lambda name, default: default if args.get(name) is None else args[name]
    if kind == "constant":
        return F.lit(args.get("value", "constant"))
    if kind == "integer":
        return _int(u, given("min", 1), given("max", 10**9))
    if kind == "float":
        low = given("min", 0)
        return F.round(u * float(given("max", 10**6) - 1 - low) + F.lit(float(low)), int(given("round", 2)))
    if kind == "bool":
        return (u > 0.5).cast("int")
    if kind == "bit":
        return _chars(seed, int(given("size", 1)), "01")
    if kind == "bytes":
        return F.concat(F.lit("\\x"), _chars(seed, int(given("size", 20)), "0123456789abcdef"))
    if kind in ("string", "json"):
        lo, hi = given("min", 10), given("max", 50)
        if kind == "json":
            # nine characters are the object around the text
            lo, hi = lo - 9 if lo > 10 else 1, hi - 9 if hi > 11 else 2
        size = _int(u, lo, hi).cast("int")
        text = F.when(size > 0, _chars(seed, F.greatest(size, F.lit(1)), LETTERS)).otherwise("")
        return F.to_json(F.struct(text.alias("k"))) if kind == "json" else F.concat(F.lit(given("prefix", "")), text)
    if kind == "uuid":
        h = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))).cast("binary"))
        return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.substring(F.lit("89ab"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(4)).cast("int") + 1, F.lit(1)), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    if kind in ("timestamp", "date"):
        a, b = (F.unix_micros(F.lit(given(k, d)).cast("timestamp")) for k, d in (("start", "2000-01-01"), ("end", "2024-12-31")))
        t = F.timestamp_micros((a + F.floor(u * (b - a + 1))).cast("long"))
        return strftime(t, given("format", "%Y-%m-%d %H:%M:%S.%f" if kind == "timestamp" else "%Y-%m-%d"))
    if kind == "time":
        a, b = (sum(int(x) * m for x, m in zip(given(k, d).split(":"), (3600, 60, 1), strict=True)) * 10**6 for k, d in (("start", "07:30:00"), ("end", "22:30:00")))
        return strftime(F.timestamp_micros(_int(u, a, b)), "%H:%M:%S.%f" if args.get("micros") else "%H:%M:%S")
    if kind == "choice":
        pop = [str(x) for x in args["population"]]
        cum = args.get("cum_weights") or [sum((args.get("weights") or [1] * len(pop))[: i + 1]) for i in range(len(pop))]
        v = F.lit(pop[-1])
        for x, c in reversed([*zip(pop, cum, strict=True)][:-1]):
            v = F.when(u < c / cum[-1], x).otherwise(v)
        return v
    raise ValueError(f"no fast form of {kind!r}")


def fast_column(kind: str, args: dict) -> Column:
    """A column expression with the type's distribution, for tables of any size; an array's values are drawn each for itself."""
    seed = int(args.get("seed") or 0)
    if kind == "sequence":
        return (F.col("id") + int(args.get("start", 0))).cast("long")
    n = 0 if kind == "json" else int(args.get("array") or 0)
    v = F.concat(F.lit("{"), F.concat_ws(",", *[_fast_value(kind, args, seed + (k << 32)).cast("string") for k in range(n)]), F.lit("}")) if n else _fast_value(kind, args, seed)
    p = args.get("null_pct") or 0.0
    return F.when(_u(seed, 1) >= p, v) if p else v


def kv_payload(kind: str, size: int, seed: int = 0, value: str = "") -> Column:
    """A key or value of a key-value load over rows with an id: bytes, uuid, int (0 to 2^63 - 1), string or fixed."""
    if kind == "bytes":
        return F.unhex(_chars(seed, 2 * size, "0123456789ABCDEF"))
    if kind == "int":
        return F.xxhash64("id", F.lit(seed)).bitwiseAND(F.lit((1 << 63) - 1))
    if kind == "fixed":
        return F.lit(value)
    if kind in ("uuid", "string"):
        return _fast_value(kind, {"min": size, "max": size}, seed)
    raise ValueError(f"no payload of {kind!r}")


def unit_vector(size: int, seed: int = 0) -> Column:
    """A direction drawn evenly: normal components over their length."""
    u = lambda i, k: (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), i, F.lit(k)), 11) + 1).cast("double") / F.lit(float(1 << 53))
    normal = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.sqrt(-2 * F.log(u(i, 0))) * F.cos(2 * F.pi() * u(i, 1)))
    with_length = F.struct(normal.alias("v"), F.sqrt(F.aggregate(normal, F.lit(0.0), lambda s, x: s + x * x)).alias("n"))
    return F.transform(with_length["v"], lambda x: x / with_length["n"])


def amount(seed: int = 0) -> Column:
    """An order's amount: 0 to a million, two digits."""
    return F.round(_u(seed, 0) * 1e6, 2)


def generate_fast(spark: SparkSession, item: dict, partitions: int | None = None) -> DataFrame:
    """One dataset of a blueprint by expressions over spark.range."""
    rows = spark.range(0, item["count"], 1, partitions) if partitions else spark.range(item["count"])
    df = rows.select(*[fast_column(d["type"], d.get("args", {})).alias(c) for c, d in item["columns"].items()])
    return df.sortWithinPartitions(*item["sort-by"]) if item.get("sort-by") else df
