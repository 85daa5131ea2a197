"""Transactional shapes as DataFrame transforms: reads, inserts, upserts, updates, deletes, nearest neighbours, set operations.

Tables stay tables: each write shape returns the new table. Joins leave their strategy to the optimizer; nothing is
broadcast by hand but rows given as a bounded list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: how many recent keys a pool holds.
POOL = 10_000


def point_read(df: DataFrame, **keys) -> DataFrame:
    """Rows whose columns equal these values; reaches the scan as pushed filters."""
    for k, v in keys.items():
        df = df.where(F.col(k) == F.lit(v))
    return df


def row_value_read(df: DataFrame, cols: Sequence[str], values: Sequence) -> DataFrame:
    """The row-value predicate (a, b) = (x, y), written as a conjunction so that it's pushed down."""
    return point_read(df, **dict(zip(cols, values, strict=True)))


def fetch(df: DataFrame, col: str, ids: Sequence) -> DataFrame:
    return df.where(F.col(col).isin(list(ids)))


def as_of(versions: DataFrame, keys: Sequence[str], at: Column, ts: str = "ts") -> DataFrame:
    """Each key's latest version not after a moment."""
    return latest(versions.where(F.col(ts) <= at), keys, [ts])


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each key's last row by order, by an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    g = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r"))
    return g.select(*keys, *[F.col("r")[c].alias(c) for c in (*order, *rest)]).select(df.columns)


def insert_absent(df: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert where the key isn't there yet; of new rows with one key the first by all columns goes in."""
    first = new.groupBy(*keys).agg(F.min(F.struct(*[c for c in new.columns if c not in keys])).alias("r"))
    first = first.select(*keys, "r.*").select(new.columns)
    return df.unionByName(first.join(df, list(keys), "left_anti"))


def upsert(df: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Old and new rows, each key's highest version; new rows win ties."""
    both = df.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, [version, "_new"]).drop("_new")


def update(df: DataFrame, new: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Columns replaced where new has the key."""
    n = new.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in cols])
    out = df.join(n, list(keys), "left")
    return out.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def set_where(df: DataFrame, cond: Column, **values: Column) -> DataFrame:
    return df.withColumns({c: F.when(cond, v).otherwise(F.col(c)) for c, v in values.items()})


def delete(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def key_pool(df: DataFrame, seq: str, n: int = POOL) -> DataFrame:
    """The n most recent rows, newest first: a top-n, not a global sort."""
    return df.orderBy(F.desc(seq)).limit(n)


def current_state(events: DataFrame, keys: Sequence[str], event: str, ts: str) -> DataFrame:
    """Event-sourced rows folded to each key's last event."""
    return events.groupBy(*keys).agg(F.max_by(event, F.struct(ts, event)).alias(event), F.max(ts).alias(ts))


def running_balance(ledger: DataFrame, account: str, order: Sequence[str], amount: str) -> DataFrame:
    w = Window.partitionBy(account).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ledger.withColumn("balance", F.sum(F.col(amount).cast("decimal(18,2)")).over(w))


def mix(df: DataFrame, bucket: Column, read_pct: int, update_pct: int, delete_pct: int) -> DataFrame:
    """Rows with the operation that a bucket from 0 to 99 chooses: thresholds in turn, the rest writes."""
    a, b, c = read_pct, read_pct + update_pct, read_pct + update_pct + delete_pct
    return df.withColumn("op", F.when(bucket < a, "read").when(bucket < b, "update").when(bucket < c, "delete").otherwise("write"))


def compare(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Full outer comparison by a key: same, missing, extra or differs."""
    cols = [c for c in expected.columns if c != key]
    e = expected.select(key, F.struct(*cols).alias("e"))
    a = actual.select(key, F.struct(*cols).alias("a"))
    j = e.join(a, key, "full")
    return j.select(key, F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("e").eqNullSafe(F.col("a")), "same").otherwise("differs").alias("verdict"))


def with_chunk(df: DataFrame, order: Sequence[str], n: int, within: Sequence[str]) -> DataFrame:
    """The chunk of n rows that each row falls in, in order, within its group."""
    w = Window.partitionBy(*within).orderBy(*order)
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / n).cast("long"))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def nearest(vectors: DataFrame, query: Sequence[float], k: int, metric: str = "l2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows to one query vector, ties by id: one scan and a top-k, no shuffle of the table."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(vector_col)
    d = l2(v, q) if metric == "l2" else 1 - cosine(v, q)
    return vectors.select(id_col, d.alias("distance")).orderBy("distance", id_col).limit(k)


def nearest_for(vectors: DataFrame, queries: list[tuple[int, Sequence[float]]], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows to each of a bounded list of queries; each partition keeps k a query before the shuffle."""
    import heapq

    import numpy as np
    import pandas as pd

    ids = np.array([i for i, _ in queries])
    q = np.array([x for _, x in queries], float)

    def local(batches):
        best: dict[int, list] = {int(i): [] for i in ids}
        for pdf in batches:
            x = np.stack(pdf[vector_col].to_numpy()).astype(float)
            d = np.sqrt(np.maximum(((x[:, None, :] - q[None]) ** 2).sum(-1), 0)) if len(q) <= 8 else np.stack([np.sqrt(((x - one) ** 2).sum(1)) for one in q], 1)
            for j, i in enumerate(ids):
                at = np.argsort(d[:, j], kind="stable")[:k]
                best[int(i)] = heapq.nsmallest(k, [*best[int(i)], *zip(d[at, j].tolist(), pdf[id_col].to_numpy()[at].tolist(), strict=True)])
        rows = [(i, v, s) for i, b in best.items() for s, v in b]
        yield pd.DataFrame(rows, columns=["query_id", id_col, "distance"])

    near = vectors.select(id_col, vector_col).mapInPandas(local, f"query_id long, {id_col} long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", id_col)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_in_blocks(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 2_000, shard: int = 100_000) -> DataFrame:
    """(query_id, id, rank): the k nearest rows to each of any number of queries. Each task holds a block of queries against a shard of rows and keeps k a query."""
    import numpy as np
    import pandas as pd

    blocks = max(1, -(-queries.count() // block))
    shards = max(1, -(-vectors.count() // shard))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    rows = vectors.select(id_col, vector_col, own(shards).alias("shard"), every(blocks).alias("block"), F.lit(False).alias("query"))
    asks = queries.select(id_col, vector_col, every(shards).alias("shard"), own(blocks).alias("block"), F.lit(True).alias("query"))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        q, v = pdf[pdf["query"]], pdf[~pdf["query"]].sort_values(id_col)
        out = []
        if len(v):
            x, ids = np.stack(v[vector_col].to_numpy()).astype(float), v[id_col].to_numpy()
            for i, one in zip(q[id_col], q[vector_col], strict=True):
                d = np.sqrt(((x - np.asarray(one, float)) ** 2).sum(1))
                # all that are as near as the k-th, so that ties go by id
                at = np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1])
                at = at[np.argsort(d[at], kind="stable")][:k]
                out.append(pd.DataFrame({"query_id": i, id_col: ids[at], "distance": d[at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], id_col: [], "distance": []})

    near = rows.unionByName(asks).groupBy("shard", "block").applyInPandas(local, f"query_id long, {id_col} long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", id_col)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def as_of_join(left: DataFrame, right: DataFrame, on: str, ts: str, value: str) -> DataFrame:
    """Each left row with the right's last value at or before it, by one union and one window for each key."""
    both = left.select(on, ts, *[c for c in left.columns if c not in (on, ts)], F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_left"))
    r = right.select(on, ts, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (on, ts)], F.col(value).alias("_v"), F.lit(0).alias("_left"))
    w = Window.partitionBy(on).orderBy(ts, "_left").rowsBetween(Window.unboundedPreceding, 0)
    return both.unionByName(r).withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_left = 1").drop("_v", "_left")
