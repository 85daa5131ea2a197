"""Scalar functions over documents, events and orders, and the functions that migrations map to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import scalars as s
from sluice.session import table


def one(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").where("r_regionkey = 0")


def json_extract_counts(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


def json_build(spark, sf):
    return table(spark, sf, "events").select("event_id", s.json_pair(F.col("event_type")).alias("j"))


def json_decode(spark, sf):
    r = F.from_json("props", "k int")
    return table(spark, sf, "events").select("event_id", r["k"].alias("k"))


def scalar_strings(spark, sf):
    n = F.col("n_name")
    return table(spark, sf, "nation").select("n_nationkey", F.lower(n).alias("low"), F.upper(n).alias("up"), F.translate(F.lower(n), "aeiou", "12345").alias("tr"), F.lpad(F.col("n_nationkey").cast("string"), 6, "0").alias("padded"), F.concat(F.lit("p_"), n).alias("prefixed"), F.replace(n, F.lit("A"), F.lit("_")).alias("replaced"), F.instr(n, "A").alias("at"), F.element_at(F.split(n, "A"), 1).alias("part"))


def scalar_dates(spark, sf):
    d = F.col("o_orderdate")
    return orders(spark, sf).select("o_orderkey", s.strftime(d, "%Y-%m-%d %H:%M:%S").alias("text"), s.strftime(d, "%Y%m%d_%H%M%S").alias("stamp"), F.to_timestamp_ntz(s.strftime(d, "%Y-%m-%d"), F.lit("yyyy-MM-dd")).alias("day"), F.unix_micros(d.cast("timestamp")).alias("us"))


def orders(spark, sf):
    return table(spark, sf, "orders")


def scalar_math(spark, sf):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return orders(spark, sf).select("o_orderkey", F.expr("o_orderkey div 10").alias("q"), (k % 10).alias("r"), F.ceil(p).cast("long").alias("up"), F.floor(p).cast("long").alias("down"), F.greatest(F.lit(100.0), F.least(F.lit(2000.0), p)).alias("clamped"), F.pow(F.lit(10.0), k % 5).alias("bound"), F.round(p, 1).cast("decimal(18,1)").cast("double").alias("r1"))


def decode_nvl(spark, sf):
    st = F.col("o_orderstatus")
    return orders(spark, sf).select("o_orderkey", F.coalesce(F.nullif(st, F.lit("P")), F.lit("pending")).alias("nvl"), F.when(st == "O", "open").when(st == "F", "final").otherwise("other").alias("decoded"), F.substring("o_orderpriority", 3, 4).alias("sub"), F.length("o_orderpriority").cast("long").alias("len"), F.date_trunc("month", "o_orderdate").alias("month"), F.expr("cast(substring(o_orderpriority, 1, 1) as decimal(4,0))").cast("int").alias("num"))


def md5_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def crc32_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("digest"))


def regex_extract(spark, sf):
    t = table(spark, sf, "documents")
    block = F.concat(F.lit("x\n```sql\nselect "), F.col("doc_id").cast("string"), F.lit(";\n```"))
    return t.select("doc_id", s.sql_block(block).alias("block"), F.regexp_extract("text", "([A-Z][a-z]+)", 1).alias("first_name"))


def array_render(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", s.array_literal(F.array("n_nationkey", "n_regionkey")).alias("a"))


def paths(spark, sf):
    p = F.concat(F.lit("/data/x.y/"), F.lower("n_name"), F.lit(".csv"))
    return table(spark, sf, "nation").select("n_nationkey", s.base_name(p).alias("base"), s.stem(p).alias("stem"), s.extension(p).alias("ext"), F.endswith(p, F.lit(".csv")).alias("is_csv"), F.startswith(s.base_name(p), F.lit("a")).alias("is_a"))


def class_names(spark, sf):
    n = F.concat(F.lit("my_"), F.lower("n_name"))
    return table(spark, sf, "nation").select("n_nationkey", s.class_name(n).alias("camel"), F.upper(n).alias("up"))


def uris(spark, sf):
    schemes = F.array(*[F.lit(k) for k in ("postgresql", "mysql", "mongodb+srv", "oracle", "spanner", "nope")])
    u = F.concat(F.element_at(schemes, F.pmod("n_nationkey", F.lit(6)) + 1), F.lit("://u@h:1/db?x=1"))
    return table(spark, sf, "nation").select("n_nationkey", s.driver_of(u).alias("driver"), s.with_query_param(u, "app", "a b").alias("added"), s.with_database(u, "other").alias("moved"))


def config_strings(spark, sf):
    m = s.config_map(F.concat(F.lit("a=1,b="), "r_name"))
    return table(spark, sf, "region").select("r_regionkey", F.element_at(m, "a").cast("int").alias("a"), F.element_at(m, "b").alias("b"))


def statement_kinds(spark, sf):
    stmt = F.element_at(F.array(F.lit("SELECT * FROM t WHERE a = %s AND b = %s"), F.lit("insert into t values (%s) returning id"), F.lit("update t set a = %s")), F.pmod("n_nationkey", F.lit(3)) + 1)
    return table(spark, sf, "nation").select("n_nationkey", s.is_query(stmt).alias("is_query"), s.placeholders(stmt).cast("long").alias("marks"))


def error_classes(spark, sf):
    code = F.element_at(F.array(*map(F.lit, (200, 400, 401, 404, 500))), F.pmod("n_nationkey", F.lit(5)) + 1)
    msg = F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.lit(" doesn't exist")).otherwise(F.lit("")))
    return table(spark, sf, "nation").select("n_nationkey", s.is_fatal(code).alias("fatal"), F.endswith(msg, F.lit("doesn't exist")).alias("missing"))


def centroid_codec(spark, sf):
    t = F.concat(F.col("n_nationkey").cast("string"), F.lit(".5 2;7.25 1;"))
    c = s.parse_centroids(t)
    return table(spark, sf, "nation").select("n_nationkey", F.aggregate(c, F.lit(0.0), lambda a, x: a + x["mean"] * x["weight"]).alias("total"), F.size(c).cast("long").alias("n"))


def weighted_repeat(spark, sf):
    n = table(spark, sf, "nation")
    total = n.agg(F.sum("n_regionkey")).first()[0]
    return n.select("n_nationkey", F.explode(F.array_repeat(F.lit(1), s.repeat_count(F.col("n_regionkey"), F.lit(total), 100))).alias("one")).groupBy("n_nationkey").agg(F.count("*").alias("n"))


def chunk_sizes(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(s.chunk_sizes(F.col("n_nationkey") + 10, F.lit(3)).cast("array<string>"), ",").alias("sizes"))


def backoff_bounds(spark, sf):
    from sluice.operators.control import backoff, jitter

    n = table(spark, sf, "nation").withColumn("r", F.pmod("n_nationkey", F.lit(4)))
    b, j = backoff(F.col("r"), 3), jitter(F.lit(100.0), 3)
    return n.select("n_nationkey", b.between(F.pow(F.lit(2.0), "r") * 0.05, F.pow(F.lit(2.0), "r") * 0.15).alias("backoff_ok"), j.between(80, 120).alias("jitter_ok"))


def ddl_scan(spark, sf):
    script = F.concat(F.lit("/* c */ create table t_"), F.lower("n_name"), F.lit(" (a int); -- x\ninsert into t values (1);;"))
    st = s.statements(script)
    rows = table(spark, sf, "nation").select("n_nationkey", F.posexplode(st).alias("pos", "stmt"))
    create = F.startswith(F.lower("stmt"), F.lit("create")) & (F.instr(F.substring_index("stmt", "(", 1), "table") > 0)
    return rows.select("n_nationkey", "pos", "stmt", create.alias("is_table"))


def type_tokens(spark, sf):
    t = F.concat(F.lit("x decimal("), F.col("n_nationkey").cast("string"), F.lit(", 2), y varchar(30)"))
    return table(spark, sf, "nation").select("n_nationkey", s.flat_type_args(t).alias("flat"))


def text_stats(spark, sf):
    """Turns by role, with the clean-up that passage loading does: strip, drop blanks, skip the first rows."""
    c = table(spark, sf, "conversations").where((F.trim("text") != "") & (F.col("turn") >= 1))
    return c.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length(F.trim("text"))).alias("chars"))


def page_hosts(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1).alias("host"))


def uuid_codes(spark, sf):
    u = F.lit("19578af7-0000-4000-8000-0123456789ab")
    return one(spark, sf).select(s.uuid_base64(u).alias("b64"))


def pick(i: str, vals: tuple) -> str:
    return "[" + ", ".join(repr(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in vals) + f"][{i}]"


STMTS = pick("n_nationkey % 3 + 1", ("SELECT * FROM t WHERE a = %s AND b = %s", "insert into t values (%s) returning id", "update t set a = %s"))
U = pick("n_nationkey % 6 + 1", ("postgresql", "mysql", "mongodb+srv", "oracle", "spanner", "nope"))

QUERIES = {
    "json_extract_counts": (json_extract_counts, "select json_extract_string(props, '$.k') as k, count(*) as n from events group by 1"),
    "json_build": (json_build, """select event_id, '{"k":"' || event_type || '"}' as j from events"""),
    "json_decode": (json_decode, "select event_id, json_extract_string(props, '$.k')::int as k from events"),
    "scalar_strings": (scalar_strings, "select n_nationkey, lower(n_name) as low, upper(n_name) as up, translate(lower(n_name), 'aeiou', '12345') as tr, lpad(n_nationkey::varchar, 6, '0') as padded, 'p_' || n_name as prefixed, replace(n_name, 'A', '_') as replaced, instr(n_name, 'A')::int as at, split_part(n_name, 'A', 1) as part from nation"),
    "scalar_dates": (scalar_dates, "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as text, strftime(o_orderdate, '%Y%m%d_%H%M%S') as stamp, date_trunc('day', o_orderdate)::timestamp as day, epoch_us(o_orderdate) as us from orders"),
    "scalar_math": (scalar_math, "select o_orderkey, o_orderkey // 10 as q, o_orderkey % 10 as r, ceil(o_totalprice)::bigint as up, floor(o_totalprice)::bigint as down, greatest(100.0, least(2000.0, o_totalprice)) as clamped, pow(10.0, o_orderkey % 5)::double as bound, round(o_totalprice, 1)::decimal(18,1)::double as r1 from orders"),
    "decode_nvl": (decode_nvl, "select o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'pending') as nvl, case o_orderstatus when 'O' then 'open' when 'F' then 'final' else 'other' end as decoded, substr(o_orderpriority, 3, 4) as sub, length(o_orderpriority) as len, date_trunc('month', o_orderdate)::timestamp as month, substr(o_orderpriority, 1, 1)::int as num from orders"),
    "md5_docs": (md5_docs, "select doc_id, md5(text) as digest from documents"),
    "crc32_docs": (crc32_docs, None),
    "regex_extract": (regex_extract, "select doc_id, 'select ' || doc_id || ';' as block, regexp_extract(text, '([A-Z][a-z]+)', 1) as first_name from documents"),
    "array_render": (array_render, "select n_nationkey, '{' || n_nationkey || ',' || n_regionkey || '}' as a from nation"),
    "paths": (paths, "select n_nationkey, lower(n_name) || '.csv' as base, lower(n_name) as stem, '.csv' as ext, true as is_csv, lower(n_name) like 'a%' as is_a from nation"),
    "class_names": (class_names, "select n_nationkey, 'My' || array_to_string([upper(x[1]) || x[2:] for x in string_split(lower(n_name), '_')], '') as camel, upper('my_' || n_name) as up from nation"),
    "uris": (uris, f"select n_nationkey, case u when 'postgresql' then 'postgres' when 'mongodb+srv' then 'mongo' when 'nope' then null else u end as driver, u || '://u@h:1/db?x=1&app=a+b' as added, u || '://u@h:1/other?x=1' as moved from (select n_nationkey, {U} as u from nation) x"),
    "config_strings": (config_strings, "select r_regionkey, 1 as a, r_name as b from region"),
    "statement_kinds": (statement_kinds, f"select n_nationkey, lower(s) like 'select%' or lower(s) like '%returning%' as is_query, ((length(s) - length(replace(s, '%s', ''))) // 2)::bigint as marks from (select n_nationkey, {STMTS} as s from nation) x"),
    "error_classes": (error_classes, "select n_nationkey, n_nationkey % 5 in (1, 2, 3) as fatal, n_nationkey % 2 = 0 as missing from nation"),
    "centroid_codec": (centroid_codec, "select n_nationkey, (n_nationkey + 0.5)::double * 2 + 7.25 as total, 2::bigint as n from nation"),
    "weighted_repeat": (weighted_repeat, "select n_nationkey, greatest(1, round(n_regionkey / (select sum(n_regionkey) from nation) * 100))::bigint as n from nation"),
    "chunk_sizes": (chunk_sizes, "select n_nationkey, concat_ws(',', t // 3, t // 3, t - 2 * (t // 3)) as sizes from (select n_nationkey, n_nationkey + 10 as t from nation) x"),
    "backoff_bounds": (backoff_bounds, "select n_nationkey, true as backoff_ok, true as jitter_ok from nation"),
    "ddl_scan": (ddl_scan, "select n_nationkey, pos::int as pos, case pos when 0 then 'create table t_' || lower(n_name) || ' (a int)' else 'insert into t values (1)' end as stmt, pos = 0 as is_table from nation, range(0, 2) r(pos)"),
    "type_tokens": (type_tokens, "select n_nationkey, 'x decimal ' || n_nationkey || ':2 , y varchar 30 ' as flat from nation"),
    "text_stats": (text_stats, "select role, count(*) as n, sum(length(trim(text)))::bigint as chars from conversations where trim(text) <> '' and turn >= 1 group by role"),
    "page_hosts": (page_hosts, "select page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) as host from pages"),
    "uuid_codes": (uuid_codes, "select to_base64(from_hex('19578af70000400080000123456789ab')) as b64"),
}
