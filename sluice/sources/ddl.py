"""Table definitions as generator blueprints: statements, columns, types and their bounds."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

#: Words that begin a constraint or option instead of a column.
RESERVED = frozenset(
    "unique primary constraint foreign index key check family inverted partition partitioned by range list hash with "
    "references create table if not exists like exclude enum interleave cluster null global local temporary temp unlogged visible using bucket_count".split()
)
COUNT, ARRAY = 100, 3
NULL_LOW, NULL_HIGH = 0.2, 0.4
INT_BITS = {"int2": 15, "smallint": 15, "int4": 31} | dict.fromkeys("int integer int8 int64 bigint".split(), 63)
STRINGS = frozenset("string char character varchar text clob".split())
NUMBERS = frozenset("decimal dec numeric float float4 float8 real double".split())


def create_statements(ddl: str) -> list[str]:
    """The script's CREATE TABLE statements, without comments."""
    text = re.sub(r"--[^\n]*", "", re.sub(r"/\*.*?\*/", "", ddl, flags=re.S))
    parts = [" ".join(s.split()) for s in text.split(";")]
    return [s for s in parts if s.lower().startswith("create") and "table" in s.split("(", 1)[0].lower()]


def _top_level(body: str) -> list[str]:
    """The column definitions, split at commas outside parentheses."""
    out, depth, cur = [], 0, ""
    for ch in body:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [x for x in [*out, cur.strip()] if x]


def parse_table(stmt: str) -> tuple[str, list[tuple[str, list[str]]]]:
    """(table, [(column, tokens of its definition)]); type arguments are one token such as 15:2."""
    head, _, rest = stmt.partition("(")
    name = next((w for w in head.split() if w.lower() not in RESERVED), "")
    depth, end = 1, len(rest)
    for i, ch in enumerate(rest):
        depth += (ch == "(") - (ch == ")")
        if depth == 0:
            end = i
            break
    cols = []
    for part in _top_level(rest[:end]):
        flat = re.sub(r"\(([^()]*)\)", lambda m: " " + ":".join(re.findall(r"\d+", m[1])) + " ", part)
        flat = flat.replace("[", " [")
        words = [w for w in flat.split() if w.strip("\"`")]
        if words and words[0].lower() not in RESERVED:
            cols.append((words[0].strip("\"`"), [w.lower() for w in words[1:]]))
    return name.strip("\"`").replace(".", "__"), cols


def type_and_args(words: list[str], rng: random.Random | None = None) -> dict:
    """{type, args} of a column's tokens; raises ValueError for types without a generator."""
    rng = rng or random.Random()
    kind = words[0]
    not_null = any(a == "not" and b == "null" for a, b in zip(words, words[1:], strict=False))
    args: dict = {"seed": rng.randint(0, 100), "null_pct": 0.0 if not_null else round(rng.uniform(NULL_LOW, NULL_HIGH), 2), "array": ARRAY if any(w.startswith("[") or w == "array" for w in words[1:3]) or kind.endswith("[]") else 0}
    kind = kind.removesuffix("[]")
    rest = words[2:] if kind == "character" and words[1:2] == ["varying"] else words[1:]
    size = next((w for w in rest[:1] if re.fullmatch(r"\d+(:\d+)*", w)), None)
    if kind in ("bool", "boolean"):
        return {"type": "bool", "args": args}
    if kind in INT_BITS:
        top = 2 ** INT_BITS[kind] - 1
        return {"type": "integer", "args": {"min": -top, "max": top, **args}}
    if kind in STRINGS:
        n = int(size.split(":")[0]) if size else None
        return {"type": "string", "args": {"min": n // 3 + 1 if n else 10, "max": n or 30, "prefix": "", **args}}
    if kind in NUMBERS:
        if not size:
            top, digits = 10**7, 2
        else:
            p, *s = map(int, size.split(":"))
            top, digits = (10 ** (p - s[0]), s[0]) if s else (10**p, 0)
        return {"type": "float", "args": {"min": 0, "max": top, "round": digits, **args}}
    if kind in ("time", "timetz"):
        return {"type": "time", "args": {"start": "07:30:00", "end": "15:30:00", "micros": False, **args}}
    if kind in ("json", "jsonb"):
        return {"type": "json", "args": {"min": 10, "max": 50, **args}}
    if kind == "date":
        return {"type": "date", "args": {"start": "2000-01-01", "end": "2024-12-31", "format": "%Y-%m-%d", **args}}
    if kind in ("timestamp", "timestamptz"):
        return {"type": "timestamp", "args": {"start": "2000-01-01", "end": "2024-12-31", "format": "%Y-%m-%d %H:%M:%S.%f", **args}}
    if kind == "uuid":
        return {"type": "uuid", "args": args}
    if kind in ("bit", "varbit"):
        return {"type": "bit", "args": {"size": int(size.split(":")[0]) if size else 1, **args}}
    if kind in ("bytes", "blob", "bytea"):
        return {"type": "bytes", "args": {"size": 20, **args}}
    raise ValueError(f"no generator for the type {words[0]!r}")


def blueprint(ddl: str, seed: int | None = None, count: int = COUNT) -> dict:
    """table -> [{count, sort-by, columns: {name: {type, args}}}] of a script's tables."""
    rng = random.Random(seed)
    out = {}
    for stmt in create_statements(ddl):
        name, cols = parse_table(stmt)
        out[name] = [{"count": count, "sort-by": [], "columns": {c: type_and_args(w, rng) for c, w in cols if w}}]
    return out


#: Spark types of generated columns.
SPARK_TYPES = {
    "bool": T.IntegerType(), "integer": T.LongType(), "sequence": T.LongType(), "float": T.DoubleType(), "constant": T.StringType(), "uuid": T.StringType(), "timestamp": T.StringType(),
    "date": T.StringType(), "time": T.StringType(), "string": T.StringType(), "json": T.StringType(), "bit": T.StringType(), "bytes": T.StringType(), "choice": T.StringType(), "custom": T.StringType(),
}


def struct_of(columns: dict) -> T.StructType:
    """The schema of a blueprint's columns; arrays are rendered as text."""
    return T.StructType([T.StructField(c, T.StringType() if d.get("args", {}).get("array") else SPARK_TYPES[d["type"]]) for c, d in columns.items()])
