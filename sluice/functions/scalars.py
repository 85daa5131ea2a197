"""Column functions: text, JSON, dates, numbers, parsing. All are built-in expressions, so plans stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Date patterns of strftime in Spark's letters.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%p": "a", "%I": "hh"}
#: URI schemes and the drivers they stand for.
DRIVERS = {
    "postgres": "postgres", "postgresql": "postgres", "mysql": "mysql", "mariadb": "maria", "maria": "maria", "oracle": "oracle", "mongodb": "mongo",
    "mongodb+srv": "mongo", "mongo": "mongo", "pinecone": "pinecone", "spanner": "spanner", "foundationdb": "foundationdb", "cockroachdb": "postgres", "crdb": "postgres",
}
FATAL_STATUS = (400, 401, 403, 404)


def strftime(ts: Column, pattern: str) -> Column:
    for k, v in STRFTIME.items():
        pattern = pattern.replace(k, v)
    return F.date_format(ts, pattern)


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)


def to_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def jsonable(df: DataFrame) -> DataFrame:
    """df with columns that JSON has no form for (decimals, dates, times, bytes) as text."""
    plain = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double")
    return df.select(*[F.col(f"`{c}`") if kind in plain else F.col(f"`{c}`").cast("string").alias(c) for c, kind in df.dtypes])


def array_literal(a: Column) -> Column:
    """{a,b,c}"""
    return F.concat(F.lit("{"), F.array_join(a.cast("array<string>"), ","), F.lit("}"))


def json_pair(v: Column) -> Column:
    """{"k":"v"}"""
    return F.to_json(F.struct(v.alias("k")))


def zero_pad(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def class_name(name: Column) -> Column:
    """snake_case as CamelCase."""
    return F.array_join(F.transform(F.split(name, "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1000)))), "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r"(?<=.)(\.[^.]*)$", 1)


def driver_of(uri: Column) -> Column:
    """The driver of a connection string's scheme, null if unknown."""
    names = F.create_map(*[F.lit(x) for kv in DRIVERS.items() for x in kv])
    return F.try_element_at(names, F.split(F.regexp_extract(uri, r"^([^:]+):", 1), r"\+(?!srv)")[0])


def with_query_param(uri: Column, key: str, value: str) -> Column:
    """The URI with a query parameter added."""
    return F.concat(uri, F.when(F.contains(uri, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit(f"{key}="), F.url_encode(F.lit(value)))


def with_database(uri: Column, db: str) -> Column:
    return F.regexp_replace(uri, r"^([a-z+]+://[^/?]+)(/[^?]*)?", f"$1/{db}")


def config_map(s: Column) -> Column:
    """k=v,k=v as a map."""
    return F.str_to_map(s, F.lit(","), F.lit("="))


def sql_block(text: Column) -> Column:
    """The first fenced block of SQL in a text."""
    return F.regexp_extract(text, r"(?is)```sql\s*(.*?)\s*```", 1)


def flat_type_args(s: Column) -> Column:
    """(15, 2) as ' 15:2 ': type arguments as one token."""
    return F.regexp_replace(F.regexp_replace(s, r"\(\s*(\d+)\s*,\s*(\d+)\s*\)", " $1:$2 "), r"\(\s*(\d+)\s*\)", " $1 ")


def is_query(stmt: Column) -> Column:
    """A statement that returns rows."""
    s = F.lower(F.trim(stmt))
    return F.startswith(s, F.lit("select")) | (F.instr(s, "returning") > 0)


def placeholders(stmt: Column) -> Column:
    return F.regexp_count(stmt, F.lit("%s"))


def repeat_count(weight: Column, total: Column, n: int) -> Column:
    """How often an entry of this weight stands in a list of about n."""
    return F.greatest(F.lit(1), F.round(weight / total * n).cast("int"))


def uuid_base64(u: Column) -> Column:
    return F.base64(F.unhex(F.replace(u, F.lit("-"), F.lit(""))))


def parse_centroids(s: Column) -> Column:
    """'mean weight;mean weight;' as an array of structs."""
    pairs = F.filter(F.split(s, ";"), lambda x: F.trim(x) != "")
    return F.transform(pairs, lambda x: F.struct(F.split(F.trim(x), " ")[0].cast("double").alias("mean"), F.split(F.trim(x), " ")[1].cast("double").alias("weight")))


def format_centroids(c: Column) -> Column:
    return F.concat(F.array_join(F.transform(c, lambda x: F.concat(x["mean"].cast("string"), F.lit(" "), x["weight"].cast("string"))), ";"), F.lit(";"))


def chunk_sizes(total: Column, parts: Column) -> Column:
    """Equal chunks, the last with the remainder."""
    q = F.floor(total / parts)
    return F.transform(F.sequence(F.lit(1), parts), lambda i: F.when(i < parts, q).otherwise(total - q * (parts - 1)).cast("long"))


def is_fatal(status: Column) -> Column:
    return status.isin(*FATAL_STATUS)


def strip_comments(ddl: Column) -> Column:
    """Without /* */ and -- comments."""
    return F.regexp_replace(F.regexp_replace(ddl, r"(?s)/\*.*?\*/", ""), r"--[^\n]*", "")


def statements(script: Column) -> Column:
    """The script's statements, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(strip_comments(script), ";"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda s: s != "")
