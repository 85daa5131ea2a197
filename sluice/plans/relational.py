"""Transactional and relational queries over orders, customer, lineitem, part and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions.scalars import jsonable
from sluice.operators import ordering, relational as rel
from sluice.session import stored, table


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders")


def point_read(spark, sf):
    return rel.point_read(orders(spark, sf), o_orderkey=7).select("o_orderkey", "o_custkey", "o_totalprice")


def composite_read(spark, sf):
    li = table(spark, sf, "lineitem")
    return rel.row_value_read(li, ["l_orderkey", "l_linenumber"], [5, 1]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def bernoulli_mix(spark, sf):
    m = rel.mix(orders(spark, sf), F.pmod("o_orderkey", F.lit(100)), 60, 20, 10)
    return m.groupBy("op").agg(F.count("*").alias("n"))


def historical_read(spark, sf):
    v = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    return rel.latest(v.where(F.col("ts") <= F.expr("timestamp_ntz '2024-01-15 00:00:00'")), ["user_id"], ["ts", "event_id"])


def find_one(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return c.orderBy("c_custkey").limit(1).select("c_custkey", "c_name")


def named_params(spark, sf):
    orders(spark, sf).createOrReplaceTempView("sluice_orders")
    return spark.sql("select o_custkey, count(*) as n from sluice_orders where o_totalprice > :low and o_orderstatus = :status group by o_custkey", args={"low": 1000.0, "status": "F"})


def upsert_latest(spark, sf):
    o = orders(spark, sf).select("o_orderkey", "o_totalprice", F.lit(0).alias("version"))
    new = o.where("o_orderkey % 3 = 0").select((F.col("o_orderkey") + 3).alias("o_orderkey"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(1).alias("version"))
    return rel.upsert(o, new, ["o_orderkey"], "version")


def do_nothing_insert(spark, sf):
    o = orders(spark, sf).select("o_orderkey", "o_totalprice")
    new = o.select((F.col("o_orderkey") * 2).alias("o_orderkey"), F.lit(0.0).alias("o_totalprice"))
    return rel.insert_absent(o, new, ["o_orderkey"])


def update_by_key(spark, sf):
    o = orders(spark, sf).select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit(1.5).alias("o_totalprice"))
    return rel.update(o, new, ["o_orderkey"], ["o_totalprice"])


def delete_by_key(spark, sf):
    o = orders(spark, sf).select("o_orderkey", "o_custkey")
    return rel.delete(o, o.where("o_custkey % 4 = 0"), ["o_orderkey"])


def status_flip(spark, sf):
    o = orders(spark, sf).select("o_orderkey", "o_orderstatus")
    return rel.set_where(o, (F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 2 == 0), o_orderstatus=F.lit("F"))


def insert_returning(spark, sf):
    o = orders(spark, sf).select("o_orderkey", "o_custkey")
    new = o.select((F.col("o_orderkey") + 10_000_000).alias("o_orderkey"), "o_custkey")
    return new.select(F.col("o_orderkey").alias("id"))


def key_pool_recent(spark, sf):
    return rel.key_pool(orders(spark, sf).select("o_orderkey", "o_custkey"), "o_orderkey", 1000)


def pool_guard(spark, sf):
    """Keys that a delete may take: pools of one key are left alone."""
    o = orders(spark, sf)
    sizes = o.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 1")
    return o.join(sizes, "o_custkey").groupBy("o_custkey").agg(F.max("o_orderkey").alias("taken"))


def event_state(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("event"), "ts")
    return rel.current_state(e, ["user_id"], "event", "ts")


def ledger_balance(spark, sf):
    o = orders(spark, sf).select("o_custkey", "o_orderkey", "o_totalprice")
    b = rel.running_balance(o, "o_custkey", ["o_orderkey"], "o_totalprice")
    return b.select("o_custkey", "o_orderkey", F.col("balance").cast("double").alias("balance"))


def partitioned_read(spark, sf):
    """Two list partitions of a table that is written with a folder for each; the filter prunes the others."""
    return stored(orders(spark, sf), "by-priority", "o_orderpriority").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def order_exec_join(spark, sf):
    o, c = orders(spark, sf), table(spark, sf, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    return j.select("o_orderkey", "c_name", F.when(F.col("c_acctbal") > 0, "processed").otherwise("held").alias("status"))


def enrich_left(spark, sf):
    o, c = orders(spark, sf), table(spark, sf, "customer").where("c_acctbal > 5000").select("c_custkey", "c_name")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").select("o_orderkey", F.coalesce("c_name", F.lit("none")).alias("seen"))


def fk_semi(spark, sf):
    o, c = orders(spark, sf), table(spark, sf, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey")


def fk_anti(spark, sf):
    o, c = orders(spark, sf), table(spark, sf, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


def expected_actual(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    actual = c.where("c_custkey % 7 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 11 == 0, F.lit(0.0)).otherwise(F.col("c_acctbal")))
    return rel.compare(c, actual, "c_custkey")


def zip_streams(spark, sf):
    """Two columns made row by row beside each other, paired by row number."""
    n = table(spark, sf, "nation")
    a = ordering.ranked(n.select("n_name"), ["n_name"])
    b = ordering.ranked(n.select("n_nationkey"), ["n_nationkey"])
    return a.join(b, "rn").select("rn", "n_name", "n_nationkey")


def arrays_paired(spark, sf):
    r = table(spark, sf, "region").groupBy().agg(F.array_sort(F.collect_list("r_name")).alias("a"), F.array_sort(F.collect_list("r_regionkey")).alias("b"))
    return r.select(F.explode(F.arrays_zip("a", "b")).alias("z")).select(F.col("z.a").alias("r_name"), F.col("z.b").alias("r_regionkey"))


def first_vector(spark, sf) -> list[float]:
    return table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def knn_l2_top3(spark, sf):
    return rel.nearest(table(spark, sf, "embeddings"), first_vector(spark, sf), 3).withColumn("distance", F.round("distance", 4))


def knn_cosine_top100(spark, sf):
    return rel.nearest(table(spark, sf, "embeddings"), first_vector(spark, sf), 100, "cosine").select("vec_id")


def farthest_of_topk(spark, sf):
    near = rel.nearest(table(spark, sf, "embeddings"), first_vector(spark, sf), 10)
    return near.groupBy().agg(F.max_by("vec_id", F.struct("distance", "vec_id")).alias("vec_id"))


def knn_batch(spark, sf):
    e = table(spark, sf, "embeddings")
    return rel.nearest_in_blocks(e, e.where("vec_id % 50 = 0"), 3).select("query_id", "vec_id", F.col("rank").cast("int").alias("rank"))


def vector_norm(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(rel.norm(F.col("embedding")), 4).alias("norm"))


def vector_fetch(spark, sf):
    return rel.fetch(table(spark, sf, "embeddings"), "vec_id", [1, 5, 9]).select("vec_id", "label")


def merge_sort_lines(spark, sf):
    o = orders(spark, sf).select(F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("value"))
    return ordering.ranked(o, ["value"]).select("rn", "value")


def chunk_files(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit("part."), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("name"))
    return ordering.import_statements(p, "part").select("chunk", F.length("stmt").cast("long").alias("n_chars"), F.regexp_count("stmt", F.lit("'http")).cast("long").alias("n_files"))


def row_chunks(spark, sf):
    o = orders(spark, sf).select("o_custkey", "o_orderkey")
    return rel.with_chunk(o, ["o_orderkey"], 4, ["o_custkey"])


def round_robin(spark, sf):
    o = ordering.ranked(orders(spark, sf).select("o_orderkey"), ["o_orderkey"])
    return o.select("o_orderkey", F.pmod("rn", F.lit(3)).alias("process"))


def sortby_subset(spark, sf):
    return ordering.sort_subset(table(spark, sf, "part").select("p_partkey", "p_size", "p_brand"), ["p_brand"], ["p_partkey"]).select("rn", "p_partkey", "p_size", "p_brand")


def tail_slice(spark, sf):
    o = orders(spark, sf).groupBy("o_orderpriority").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("a"))
    return o.select("o_orderpriority", F.array_join(F.slice("a", -2, 2), ",").alias("last_two"))


def top_orders(spark, sf):
    return orders(spark, sf).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


def column_difference(spark, sf):
    o = orders(spark, sf)
    cols = F.array(*map(F.lit, o.columns))
    return spark.range(1).select(F.explode(F.array_except(cols, F.array(F.lit("o_orderkey"), F.lit("o_custkey")))).alias("col"))


def table_counts(spark, sf):
    out = None
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        n = table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def set_operations(spark, sf):
    o, c = orders(spark, sf).select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    parts = {"both": o.intersect(c), "only_customers": c.subtract(o), "more_orders": o.exceptAll(c), "either": o.union(c).distinct()}
    out = None
    for name, df in parts.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def cube_totals(spark, sf):
    o = orders(spark, sf)
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def ranks(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = orders(spark, sf).select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn"), F.dense_rank().over(w).alias("dr"), F.coalesce(F.lag("o_orderkey").over(w), F.lit(0)).alias("before"))
    return o.where("rn <= 3")


def as_of_prices(spark, sf):
    e = table(spark, sf, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("seen"))
    return rel.as_of_join(left, right, "user_id", "ts", "seen").select("event_id", "seen")


L2 = "list_distance(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0))"
COS = "1 - list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0))"
RN = "row_number() over (order by {}) - 1"

def vector_upsert(spark, sf):
    """Vectors replaced or added by key, the last of a key's rows winning."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", F.lit(0).alias("version"))
    new = e.where("vec_id % 3 = 0").select((F.col("vec_id") + 90).alias("vec_id"), F.transform("embedding", lambda x: -x).alias("embedding"), F.lit(1).alias("version"))
    return rel.upsert(e, new, ["vec_id"], "version").select("vec_id", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


def kv_set(spark, sf):
    """Keys set to JSON values: the last value of a key stays."""
    o = orders(spark, sf).select(F.concat(F.lit("orders/"), "o_custkey").alias("k"), F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))).alias("v"), F.col("o_orderkey").alias("version"))
    return rel.latest(o, ["k"], ["version"]).select("k", "v")


def document_insert(spark, sf):
    """A document more in a collection."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    one = spark.createDataFrame([(10_000_000, "Customer#new")], "c_custkey long, c_name string")
    return c.unionByName(one)


def jsonable_values(spark, sf):
    o = orders(spark, sf).select("o_orderkey", F.col("o_totalprice").cast("decimal(15,2)").alias("price"), F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus")
    return jsonable(o)


QUERIES = {
    "vector_upsert": (vector_upsert, "select vec_id, round(first::double, 5) as first from (select vec_id, first, row_number() over (partition by vec_id order by v desc) as k from (select vec_id, embedding[1] as first, 0 as v from embeddings union all select vec_id + 90, -embedding[1], 1 from embeddings where vec_id % 3 = 0) x) y where k = 1"),
    "kv_set": (kv_set, "select 'orders/' || o_custkey as k, '{\"id\":' || max(o_orderkey) || ',\"status\":\"' || arg_max(o_orderstatus, o_orderkey) || '\"}' as v from orders group by o_custkey"),
    "document_insert": (document_insert, "select c_custkey, c_name from customer union all select 10000000, 'Customer#new'"),
    "jsonable_values": (jsonable_values, "select o_orderkey, (o_totalprice::decimal(15,2))::varchar as price, strftime(o_orderdate, '%Y-%m-%d') as day, o_orderstatus from orders"),
    "point_read": (point_read, "select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey = 7"),
    "composite_read": (composite_read, "select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where (l_orderkey, l_linenumber) = (5, 1)"),
    "bernoulli_mix": (bernoulli_mix, "select case when o_orderkey % 100 < 60 then 'read' when o_orderkey % 100 < 80 then 'update' when o_orderkey % 100 < 90 then 'delete' else 'write' end as op, count(*) as n from orders group by 1"),
    "historical_read": (historical_read, "select user_id, ts, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events where ts <= '2024-01-15') x where r = 1"),
    "find_one": (find_one, "select c_custkey, c_name from customer where c_mktsegment = 'BUILDING' order by c_custkey limit 1"),
    "named_params": (named_params, "select o_custkey, count(*) as n from orders where o_totalprice > 1000 and o_orderstatus = 'F' group by o_custkey"),
    "upsert_latest": (upsert_latest, "select o_orderkey, o_totalprice, version from (select *, row_number() over (partition by o_orderkey order by version desc) as r from (select o_orderkey, o_totalprice, 0 as version from orders union all select o_orderkey + 3, o_totalprice + 1, 1 from orders where o_orderkey % 3 = 0) u) x where r = 1"),
    "do_nothing_insert": (do_nothing_insert, "select o_orderkey, o_totalprice from orders union all select o_orderkey * 2, 0.0 from orders n where not exists (select 1 from orders o where o.o_orderkey = n.o_orderkey * 2)"),
    "update_by_key": (update_by_key, "select o_orderkey, o_orderstatus, case when o_orderkey % 5 = 0 then 1.5 else o_totalprice end as o_totalprice from orders"),
    "delete_by_key": (delete_by_key, "select o_orderkey, o_custkey from orders where o_custkey % 4 <> 0"),
    "status_flip": (status_flip, "select o_orderkey, case when o_orderstatus = 'O' and o_orderkey % 2 = 0 then 'F' else o_orderstatus end as o_orderstatus from orders"),
    "insert_returning": (insert_returning, "select o_orderkey + 10000000 as id  from orders"),
    "key_pool_recent": (key_pool_recent, "select o_orderkey, o_custkey from orders order by o_orderkey desc limit 1000"),
    "pool_guard": (pool_guard, "select o_custkey, max(o_orderkey) as taken from orders group by o_custkey having count(*) > 1"),
    "event_state": (event_state, "select user_id, arg_max(event_id, (ts, event_id)) as event, max(ts) as ts from events group by user_id"),
    "ledger_balance": (ledger_balance, "select o_custkey, o_orderkey, (sum(o_totalprice::decimal(18,2)) over (partition by o_custkey order by o_orderkey))::double as balance from orders"),
    "partitioned_read": (partitioned_read, "select o_orderpriority, count(*) as n from orders where o_orderpriority in ('1-URGENT', '2-HIGH') group by 1"),
    "order_exec_join": (order_exec_join, "select o_orderkey, c_name, case when c_acctbal > 0 then 'processed' else 'held' end as status from orders join customer on o_custkey = c_custkey"),
    "enrich_left": (enrich_left, "select o_orderkey, coalesce(c_name, 'none') as seen from orders left join (select * from customer where c_acctbal > 5000) c on o_custkey = c_custkey"),
    "fk_semi": (fk_semi, "select c_custkey from customer where c_custkey in (select o_custkey from orders)"),
    "fk_anti": (fk_anti, "select c_custkey from customer where c_custkey not in (select o_custkey from orders)"),
    "expected_actual": (expected_actual, "select c_custkey, case when c_custkey % 7 = 0 then 'missing' when c_custkey % 11 = 0 and c_acctbal <> 0 then 'differs' else 'same' end as verdict from customer"),
    "zip_streams": (zip_streams, f"select a.rn, n_name, n_nationkey from (select n_name, {RN.format('n_name')} as rn from nation) a join (select n_nationkey, {RN.format('n_nationkey')} as rn from nation) b using (rn)"),
    "arrays_paired": (arrays_paired, f"select r_name, r_regionkey from (select r_name, {RN.format('r_name')} as rn from region) a join (select r_regionkey, {RN.format('r_regionkey')} as rn from region) b using (rn)"),
    "knn_l2_top3": (knn_l2_top3, f"select vec_id, round({L2}, 4) as distance from embeddings order by {L2}, vec_id limit 3"),
    "knn_cosine_top100": (knn_cosine_top100, f"select vec_id from embeddings order by {COS}, vec_id limit 100"),
    "farthest_of_topk": (farthest_of_topk, f"select arg_max(vec_id, d) as vec_id from (select vec_id, {L2} as d from embeddings order by d, vec_id limit 10) x"),
    "knn_batch": (knn_batch, "select query_id, vec_id, rank::int as rank from (select q.vec_id as query_id, e.vec_id, row_number() over (partition by q.vec_id order by list_distance(e.embedding::double[], q.embedding::double[]), e.vec_id) as rank from embeddings e, (select * from embeddings where vec_id % 50 = 0) q) x where rank <= 3"),
    "vector_norm": (vector_norm, "select vec_id, round(sqrt(list_sum([v::double * v::double for v in embedding])), 4) as norm from embeddings"),
    "vector_fetch": (vector_fetch, "select vec_id, label from embeddings where vec_id in (1, 5, 9)"),
    "merge_sort_lines": (merge_sort_lines, f"select {RN.format('value')} as rn, value from (select concat_ws(chr(9), o_orderkey::varchar, o_orderstatus, o_orderpriority) as value from orders) x"),
    "chunk_files": (chunk_files, "select chunk, (length('IMPORT INTO part CSV DATA (') + 1 + sum(length(name) + length('    ''http://localhost:3000/''')) + 2 * (count(*) - 1) + 1 + length(') WITH delimiter = e''\\t'', nullif = '''';'))::bigint as n_chars, count(*) as n_files from (select 'part.' || lpad(p_partkey::varchar, 7, '0') as name, (row_number() over (order by 'part.' || lpad(p_partkey::varchar, 7, '0')) - 1) // 20 as chunk from part) x group by chunk"),
    "row_chunks": (row_chunks, "select o_custkey, o_orderkey, (row_number() over (partition by o_custkey order by o_orderkey) - 1) // 4 as chunk from orders"),
    "round_robin": (round_robin, f"select o_orderkey, ({RN.format('o_orderkey')}) % 3 as process from orders"),
    "sortby_subset": (sortby_subset, f"select a.rn, p_partkey, p_size, p_brand from (select p_partkey, p_size, {RN.format('p_partkey')} as rn from part) a join (select p_brand, {RN.format('p_brand')} as rn from part) b using (rn)"),
    "tail_slice": (tail_slice, "select o_orderpriority, array_to_string(list_sort(list(distinct o_orderstatus))[-2:], ',') as last_two from orders group by 1"),
    "top_orders": (top_orders, "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10"),
    "column_difference": (column_difference, "select unnest(['o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) as col"),
    "table_counts": (table_counts, " union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"))),
    "set_operations": (set_operations, "select 'both' as part, count(*) as n from (select o_custkey from orders intersect select c_custkey from customer) a union all select 'only_customers', count(*) from (select c_custkey from customer except select o_custkey from orders) b union all select 'more_orders', count(*) from (select o_custkey from orders except all select c_custkey from customer) c union all select 'either', count(*) from (select o_custkey from orders union select c_custkey from customer) d"),
    "cube_totals": (cube_totals, "select o_orderstatus, o_orderpriority, count(*) as n, grouping(o_orderstatus, o_orderpriority)::bigint as level from orders group by cube (o_orderstatus, o_orderpriority)"),
    "ranks": (ranks, "select * from (select o_custkey, o_orderkey, (row_number() over w)::int as rn, (dense_rank() over w)::int as dr, coalesce(lag(o_orderkey) over w, 0) as before from orders window w as (partition by o_custkey order by o_totalprice desc, o_orderkey)) x where rn <= 3"),
    "as_of_prices": (as_of_prices, "select l.event_id, r.seen from (select * from events where event_type = 'purchase') l asof left join (select user_id, ts, max(value) as seen from events where event_type = 'view' group by 1, 2) r on l.user_id = r.user_id and l.ts >= r.ts"),
}
