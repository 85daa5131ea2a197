"""Near duplicates of vectors with navigable small-world graphs, one hierarchy a shard.

Equal vectors are one row with a count. Rows are dealt over shards; each shard builds its own graph, and every vector
queries its own shard and, of each two shards, the vectors of one query the other; a link found counts for both ends. A shard's beam doubles until an audit, vectors that query it (of other shards first) held against all of its rows, finds
at least AUDIT_RECALL of the true links of a query on average, without links to itself and without queries that are answered from all rows. A query whose beam is full of links takes a wider one, and if that is full as well, is answered from all rows of the shard,
so no number of partners is cut off. Cosines are verified in double precision. Each task gives link
counts and only links that span the components it saw, so a group of near copies makes no list of all its pairs.

A task holds one shard (about SHARD_FLOATS components) and a batch of queries; each shard is a task of its own. The graph is built and searched in
lockstep for many rows, as numpy operations.

Input cases: null vectors, zero vectors and those with null or non-finite components have no links and are their own component; vectors
of different lengths are not compared; rows with one vec_id are one vector (the least sound value) and one row of the result; rows without an id stay, each with a null component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import components, forest, ship, stored

THRESHOLD = 0.9
SHARDS, SHARD_FLOATS = 8, 12_800_000
DEGREE = 12
#: Beams of a graph's building and, at first, of a query; a query whose beam is full of links takes one FULLER times as wide.
BUILD_BEAM, BEAM, FULLER = 32, 16, 4
AUDIT_RECALL, AUDIT_ROWS = 0.99, 128
#: Queries of a shard among which the audit looks for linked ones.
AUDIT_POOL = 8192
STEP = 4


class Graph:
    """A hierarchy of proximity graphs over unit vectors."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 7):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        self.beam = beam
        level = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(degree)).astype(int)
        self.top = min(int(level.max(initial=0)), 6)
        self.level = np.minimum(level, self.top)
        self.nb = [np.full((n, 2 * degree if k == 0 else degree), -1, np.int32) for k in range(self.top + 1)]
        # the highest rows come first, so that every layer has an entry
        order = np.argsort(-self.level, kind="stable")
        self.entry = int(order[0]) if n else 0
        at = 0
        while at < n:
            size = min(512, max(64, at))
            self._insert(order[at : at + size], order[:at])
            at += size

    def _pick(self, q: np.ndarray, cand: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
        """Of each row's candidates (sorted by similarity, -1 for none) up to m: those nearer to the row than to one taken before, then the nearest of the rest."""
        b, c = cand.shape
        vec = self.x[np.maximum(cand, 0)]
        between = vec @ vec.transpose(0, 2, 1)
        taken = np.zeros((b, c), bool)
        near = np.full((b, c), -np.inf, np.float32)
        count = np.zeros(b, int)
        for j in range(c):
            ok = (cand[:, j] >= 0) & (count < m) & (sim[:, j] > near[:, j])
            taken[ok, j] = True
            count += ok
            near = np.where(ok[:, None], np.maximum(near, between[:, j]), near)
        rank = np.where(cand < 0, 3 * c, np.where(taken, 0, c) + np.arange(c))
        best = np.argsort(rank, axis=1, kind="stable")[:, :m]
        out = np.take_along_axis(cand, best, 1)
        if out.shape[1] < m:
            out = np.concatenate([out, np.full((b, m - out.shape[1]), -1, out.dtype)], 1)
        return out

    def _insert(self, new: np.ndarray, old: np.ndarray) -> None:
        q = self.x[new]
        gram = q @ q.T
        np.fill_diagonal(gram, -np.inf)
        entry = np.full(len(new), self.entry, np.int64)
        for lev in range(self.top, -1, -1):
            here = self.level[new] >= lev
            if len(old):
                ids, sims = self.search(q, lev, self.beam if here.any() else 1, entry)
                entry = ids[:, 0]
            else:
                ids, sims = np.full((len(new), 0), -1, np.int64), np.empty((len(new), 0), np.float32)
            if not here.any():
                continue
            rows = np.flatnonzero(here)
            mine = gram[np.ix_(rows, rows)]
            k = min(self.beam, len(rows))
            near = np.argpartition(-mine, k - 1, axis=1)[:, :k]
            cand = np.concatenate([ids[rows], new[rows][near]], 1)
            sim = np.concatenate([sims[rows], np.take_along_axis(mine, near, 1)], 1)
            cand = np.where(np.isfinite(sim), cand, -1)
            order = np.argsort(-sim, axis=1, kind="stable")[:, : self.beam]
            cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
            m = self.nb[lev].shape[1]
            own = self._pick(q[rows], cand, sim, max(2, m // 2) if lev == 0 else m)
            self.nb[lev][new[rows], : own.shape[1]] = own
            self._back(lev, np.repeat(new[rows], own.shape[1]), own.ravel())

    def _back(self, lev: int, src: np.ndarray, dst: np.ndarray) -> None:
        """Add the links dst -> src; full lists keep the best of old and new."""
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, begin, count = np.unique(dst, return_index=True, return_counts=True)
        nb = self.nb[lev]
        m = nb.shape[1]
        for a in range(0, len(nodes), 2048):
            v, lo, c = nodes[a : a + 2048], begin[a : a + 2048], np.minimum(count[a : a + 2048], 3 * m)
            width = int(c.max())
            grid = lo[:, None] + np.arange(width)
            add = np.where(np.arange(width) < c[:, None], src[np.minimum(grid, len(src) - 1)], -1)
            cand = np.concatenate([nb[v], add], 1).astype(np.int64)
            cand.sort(axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            sim = np.einsum("bcd,bd->bc", self.x[np.maximum(cand, 0)], self.x[v])
            sim[cand < 0] = -np.inf
            order = np.argsort(-sim, axis=1, kind="stable")
            cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
            nb[v] = self._pick(self.x[v], cand[:, : 4 * m], sim[:, : 4 * m], m)

    def search(self, q: np.ndarray, lev: int, beam: int, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the beam of each query on one layer, best first; -1 and -inf where there are fewer."""
        b, n = len(q), len(self.x)
        nb = self.nb[lev]
        rows = np.arange(b)[:, None]
        ids = np.full((b, beam), -1, np.int64)
        sims = np.full((b, beam), -np.inf, np.float32)
        fresh = np.zeros((b, beam), bool)
        seen = np.zeros((b, n), bool)
        ids[:, 0] = entry
        sims[:, 0] = np.einsum("bd,bd->b", self.x[entry], q)
        fresh[:, 0] = True
        seen[np.arange(b), entry] = True
        live = np.arange(b)
        step = min(STEP, beam)
        while len(live):
            score = np.where(fresh[live], sims[live], -np.inf)
            pick = np.argpartition(-score, step - 1, axis=1)[:, :step] if step < beam else np.tile(np.arange(beam), (len(live), 1))
            good = np.isfinite(np.take_along_axis(score, pick, 1))
            node = np.take_along_axis(ids[live], pick, 1)
            r = live[:, None]
            fresh[r, pick] = False
            near = np.where(good[:, :, None], nb[np.maximum(node, 0)], -1).reshape(len(live), -1).astype(np.int64)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[r, np.maximum(near, 0)]] = -1
            hit = near >= 0
            rr, cc = np.nonzero(hit)
            seen[live[rr], near[rr, cc]] = True
            s = np.full(near.shape, -np.inf, np.float32)
            s[rr, cc] = np.einsum("id,id->i", self.x[near[rr, cc]], q[live[rr]])
            all_ids = np.concatenate([ids[live], near], 1)
            all_s = np.concatenate([sims[live], s], 1)
            all_f = np.concatenate([fresh[live], hit], 1)
            best = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], fresh[live] = (np.take_along_axis(v, best, 1) for v in (all_ids, all_s, all_f))
            live = live[good.any(1) & (fresh[live] & np.isfinite(sims[live])).any(1)]
        order = np.argsort(-sims, axis=1, kind="stable")
        del rows
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def descend(self, q: np.ndarray, lev: int, entry: np.ndarray) -> np.ndarray:
        """The row at which each query's walk to ever nearer neighbours on one layer ends."""
        at = entry.copy()
        sim = np.einsum("bd,bd->b", self.x[at], q)
        live = np.arange(len(q))
        while len(live):
            near = self.nb[lev][at[live]]
            s = np.einsum("bcd,bd->bc", self.x[np.maximum(near, 0)], q[live])
            s[near < 0] = -np.inf
            best = s.argmax(1)
            row = np.arange(len(live))
            up = s[row, best] > sim[live]
            at[live[up]], sim[live[up]] = near[row[up], best[up]], s[row[up], best[up]]
            live = live[up]
        return at

    def query(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query on the lowest layer, entered through the higher ones."""
        out = []
        size = max(16, min(512, 48_000_000 // max(1, len(self.x))))
        for a in range(0, len(q), size):
            part = np.ascontiguousarray(q[a : a + size], np.float32)
            entry = np.full(len(part), self.entry, np.int64)
            for lev in range(self.top, 0, -1):
                entry = self.descend(part, lev, entry)
            out.append(self.search(part, 0, min(beam, len(self.x)), entry))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def unit(rows: list) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in rows])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Shard:
    """One shard's rows and graph; the beam is set by the audit."""

    def __init__(self, ids: np.ndarray, count: np.ndarray, vectors: list, threshold: float):
        self.ids, self.count, self.threshold = ids, count, threshold
        self.x = unit(vectors)
        self.graph = Graph(self.x)
        self.beam, self.recall = BEAM, 0.0
        self.back = np.zeros(len(ids), np.int64)

    def audit(self, ids: np.ndarray, q: np.ndarray) -> None:
        """Widen the beam until it finds what a full search does, for up to AUDIT_ROWS of the queries that are linked with other rows."""
        order = np.random.default_rng(7).permutation(len(ids))
        order = order[np.argsort(np.isin(ids[order], self.ids), kind="stable")]
        at, truth = [], []
        for a in range(0, len(order), 256):
            part = order[a : a + 256]
            hit = (self.graph.x @ q[part].T.astype(np.float32) >= self.threshold - 1e-3) & (self.ids[:, None] != ids[part])
            for k in np.flatnonzero(hit.any(0)):
                j = np.flatnonzero(hit[:, k])
                j = j[self.x[j] @ q[part[k]] >= self.threshold]
                if len(j):
                    at.append(part[k])
                    truth.append(j)
            if len(at) >= AUDIT_ROWS:
                break
        at, truth = at[:AUDIT_ROWS], truth[:AUDIT_ROWS]
        if not at:
            return
        while True:
            got, full = self.find(q[at])
            parts = [np.isin(t, g).mean() for t, g, exact in zip(truth, got, full, strict=True) if not exact]
            self.recall = float(np.mean(parts)) if parts else 1.0
            if self.recall >= AUDIT_RECALL or self.beam >= len(self.ids):
                break
            self.beam *= 2

    def links(self, q: np.ndarray) -> list[np.ndarray]:
        """Places of the rows linked with each query."""
        return self.find(q)[0]

    def find(self, q: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Places of the rows linked with each query, and whether they come from all rows."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(q)
        full = np.arange(len(q))
        for beam in (self.beam, self.beam * FULLER):
            ids, sims = self.graph.query(q[full], beam) if len(full) else (np.empty((0, 1), np.int64), np.empty((0, 1)))
            maybe = (sims >= self.threshold - 1e-3) & (ids >= 0)
            more = 2 * maybe.sum(1) > beam
            for k in np.flatnonzero(maybe.any(1) & ~more):
                j, i = ids[k, maybe[k]], full[k]
                out[i] = j[self.x[j] @ q[i] >= self.threshold]
            full = full[more]
        exact = np.zeros(len(q), bool)
        exact[full] = True
        for a in range(0, len(full), 256):
            part = full[a : a + 256]
            hit = self.x @ q[part].T >= self.threshold
            for k, i in enumerate(part):
                out[i] = np.flatnonzero(hit[:, k])
        return out, exact


def _search(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, built, held, waiting = None, None, [], []

        def flush() -> Iterator[pd.DataFrame]:
            """The answers to the waiting queries, of which the first ones audit the shard."""
            nonlocal built
            if waiting and (held or built is not None):
                ask = pd.concat(waiting)
                if built is None:
                    own = pd.concat(held)
                    built = Shard(own["vec_id"].to_numpy(np.int64), own["n"].to_numpy(np.int64), own["embedding"].tolist(), threshold)
                    built.audit(ask["vec_id"].to_numpy(np.int64), unit(ask["embedding"].tolist()))
                    held.clear()
                for lo in range(0, len(ask), 4096):
                    yield answer(ask.iloc[lo : lo + 4096])
            waiting.clear()

        def answer(pdf: pd.DataFrame) -> pd.DataFrame:
            ids = pdf["vec_id"].to_numpy(np.int64)
            got = built.links(unit(pdf["embedding"].tolist()))
            a = np.repeat(ids, [len(g) for g in got])
            j = np.concatenate(got)
            b, c = built.ids[j], built.count[j]
            other = a != b
            at = np.repeat(np.arange(len(ids)), [len(g) for g in got])
            links = np.bincount(at[other], weights=c[other], minlength=len(ids)).astype(np.int64)
            x, y = forest(a[other], b[other])
            some = links > 0
            # a query of another shard isn't asked the other way round
            far = other & ~np.isin(a, built.ids)
            built.back += np.bincount(j[far], weights=pdf["n"].to_numpy(np.int64)[at[far]], minlength=len(built.ids)).astype(np.int64)
            return pd.DataFrame({"a": np.concatenate([ids[some], x]), "b": np.concatenate([np.full(some.sum(), -1), y]), "n": np.concatenate([links[some], np.zeros(len(x), np.int64)]), "link": np.repeat([False, True], [some.sum(), len(x)])})

        def ended() -> Iterator[pd.DataFrame]:
            """The last answers, and the links that queries of other shards found to the shard's rows."""
            yield from flush()
            if built is not None and built.back.any():
                at = np.flatnonzero(built.back)
                yield pd.DataFrame({"a": built.ids[at], "b": -1, "n": built.back[at], "link": False})

        for pdf in batches:
            for (*key, query), part in pdf.groupby(["shard", "dim", "query"], sort=True):
                if key != shard:
                    yield from ended()
                    shard, built, held = key, None, []
                if not query:
                    held.append(part)
                    continue
                waiting.append(part)
                if built is not None or sum(map(len, waiting)) >= AUDIT_POOL:
                    yield from flush()
        yield from ended()

    return run


def own_partitions(spark: SparkSession, parts: int) -> DataFrame:
    """(part, shard): for each of so many hash partitions a number that falls into it, so that no two shards meet in one task."""
    tries = spark.range(parts * 40).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("at"))
    keys = tries.groupBy("at").agg(F.min("id").alias("shard"))
    # a partition that none of the numbers hits has one behind them
    every = spark.range(parts).select(F.col("id").cast("int").alias("part")).join(keys, F.col("part") == F.col("at"), "left")
    return every.select("part", F.coalesce("shard", F.col("part") + parts * 40).alias("shard"))


def home_part(parts: int) -> Column:
    return F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")


def asked_parts(reps: DataFrame, parts: int) -> DataFrame:
    """reps with home and each part that a row queries: its own, and half of the circle behind it, so that of two parts one queries the other."""
    last = F.when(F.col("home") < parts // 2, F.lit(parts // 2)).otherwise(F.lit((parts - 1) // 2))
    asked = F.transform(F.sequence(F.lit(0), last), lambda d: F.pmod(F.col("home") + d, F.lit(parts)).cast("int"))
    return reps.withColumn("home", home_part(parts)).withColumn("part", F.explode(asked))


def vector_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shards: int = SHARDS, shard_floats: int = SHARD_FLOATS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector (vec_id, embedding)."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    sound = F.coalesce(finite & F.col("vec_id").isNotNull(), F.lit(False))
    good = stored(rows.where(sound).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "ann-sound")
    reps = stored(good.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")), "ann-vectors")
    floats = reps.agg(F.sum(F.size("embedding"))).first()[0] or 0
    parts = max(shards, -(-floats // shard_floats))
    keys = stored(own_partitions(spark, parts), "ann-shards")
    # vectors of another length have shards of their own
    columns = ["shard", F.size("embedding").alias("dim"), "query", "vec_id", "embedding", "n"]
    own = reps.withColumns({"part": home_part(parts), "query": F.lit(False)}).join(keys, "part").select(columns)
    ask = asked_parts(reps, parts).withColumn("query", F.lit(True)).join(keys, "part").select(columns)
    dealt = own.unionByName(ask).repartition(parts, "shard").sortWithinPartitions("shard", "dim", "query")
    found = stored(dealt.mapInPandas(_search(threshold), "a long, b long, n long, link boolean"), "ann-found")
    counts = found.where(~F.col("link")).groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    comp = components(found.where("link").select("a", "b"), "ann").withColumnRenamed("id", "rep")
    same = reps.select("embedding", F.col("vec_id").alias("rep"), "n").join(counts, "rep", "left").join(comp, "rep", "left")
    same = same.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = good.join(same, "embedding").select("vec_id", "n_links", "component_id")
    rest = rows.where(~sound)
    nameless = rest.where("vec_id is null").select("vec_id")
    alone = rest.where("vec_id is not null").select("vec_id").distinct().join(good.select("vec_id"), "vec_id", "left_anti").unionByName(nameless)
    return out.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
