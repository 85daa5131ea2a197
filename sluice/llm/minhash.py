"""MinHash near duplicates by an inverted join on signature coordinates.

Equal shingle sets are one class; its smallest id stands for it. A signature has COORDS coordinates. Every (coordinate,
value) pair is a posting list. Two sets with at least MATCHES equal coordinates must meet in one of the COORDS - MATCHES + 1
rarest lists of each, so only that prefix is posted; the longest lists are skipped. Where two sets meet, their
collisions are counted over the whole signatures, and pairs under MATCHES are dropped. The pairs that are left
join sets into clusters; within a cluster every pair that is not yet connected is confirmed on the full sets.

No group has to fit into a task: lists and clusters over BLOCK members, or BLOCK_SHINGLES shingles, are cut into blocks. Each block is solved by itself,
then the components found so far are linked through a few members of each block, and at last only members outside their group's largest component are
held against all blocks, some at a time. So every pair is either connected already or compared, and no list of all pairs is made. The texts of clusters' members are read once;
what is held against each other are their stored sets of shingle hashes.

At Jaccard 0.8 a pair has fewer than MATCHES of COORDS equal coordinates with a probability of about 3e-5.

Input cases: null texts and texts without a word have an empty set, are linked with nothing and are their own component;
with fewer words than a shingle the whole sequence is one shingle; rows with the same id are one document (any of its texts links it); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import components, forest, lean, mix64, packed, ship, slabs, stored, unpacked, word_bytes

COORDS, MATCHES = 32, 16
BLOCK = 768
#: A single set may be larger; it is then alone in its block.
BLOCK_SHINGLES = 1_500_000
LEADERS = 24
#: Words whose hashes a worker keeps.
KNOWN = 100_000
SEEDS = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Shingler:
    """Sets of 64-bit shingle hashes; a worker keeps the hashes of the words it has seen."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        found, known = word_bytes(text), self.known
        if not found:
            return np.empty(0, np.uint64)
        if len(known) > KNOWN:
            known.clear()
        new = set(found).difference(known)
        known.update(zip(new, map(xxhash.xxh3_64_intdigest, new), strict=True))
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        k = min(self.size, len(h))
        out = np.full(len(h) - k + 1, np.uint64(k))
        for i in range(k):
            out = mix64(out) + h[i : len(h) - k + 1 + i]
        return np.unique(mix64(out))


def signature(s: np.ndarray) -> np.ndarray:
    """The smallest value under each hash function, as 32 bits."""
    return np.array([(mix64(s ^ seed).min() >> np.uint64(32)) for seed in SEEDS[:COORDS]], np.uint64).astype(np.uint32)


def _sketches(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(size)
        for pdf in slabs(batches):
            n, k1, k2, sig = [], [], [], []
            for t in pdf["text"]:
                s = shingle(t)
                n.append(len(s))
                k1.append(int(s.sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                k2.append(int(np.bitwise_xor.reduce(mix64(s + np.uint64(len(s)))).astype(np.int64)) if len(s) else 0)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": n, "k1": k1, "k2": k2, "sig": sig})

    return run


def _sets(size: int):
    """id, weight (shingles) and payload (the sorted set, as packed differences) of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(size)
        for pdf in slabs(batches):
            sets = [shingle(t) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "weight": [len(s) for s in sets], "payload": [packed(np.diff(s, prepend=np.uint64(0))) for s in sets]})

    return run


def _by_signature(sigs: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.uint32) for x in sigs])


def same_signature(a: list, b: list) -> np.ndarray:
    """Which of a and b have enough equal coordinates: a matrix."""
    x, y = _by_signature(a), _by_signature(b)
    hits = np.zeros((len(x), len(y)), np.uint8)
    for c in range(x.shape[1]):
        hits += x[:, c][:, None] == y[:, c][None, :]
    return hits >= MATCHES


def same_sets(percent: int) -> Callable[[list, list], np.ndarray]:
    """Which sets of a and b have 100 * intersection >= percent * union: a matrix."""

    def run(a: list, b: list) -> np.ndarray:
        sets = [np.cumsum(unpacked(x)) for x in (a if b is a else [*a, *b])]
        n = np.array([len(s) for s in sets])
        ids, inv = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), n)
        # shingles of one set only add nothing to an intersection
        many = np.bincount(inv, minlength=len(ids)) > 1
        col = np.cumsum(many) - 1
        ok = many[inv]
        row, inv, width = row[ok], col[inv[ok]], int(many.sum())
        order = np.argsort(inv, kind="stable")
        row, inv = row[order], inv[order]
        m = len(a)
        both = np.zeros((m, len(sets) - m if b is not a else m), np.float32)
        for lo in range(0, width, 4096):
            s = slice(*np.searchsorted(inv, [lo, lo + 4096]))
            dense = np.zeros((len(sets), min(4096, width - lo)), np.float32)
            dense[row[s], inv[s] - lo] = 1
            both += dense[:m] @ (dense[m:] if b is not a else dense[:m]).T
        x, y = n[:m], n[m:] if b is not a else n[:m]
        union = x[:, None] + y[None, :] - both
        return (100 * both >= percent * union) & (both > 0)

    return run


def _solve(ids: np.ndarray, group: np.ndarray, payload: list, link: Callable, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of each group; rows are sorted by group."""
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(cut, len(group)))
    a, b = [], []
    for at, n in zip(cut[size > 1], size[size > 1], strict=True):
        if small and n <= 24:
            continue
        got = payload[at : at + n]
        i, j = np.nonzero(np.triu(link(got, got), 1))
        a.append(ids[at + i])
        b.append(ids[at + j])
    if small and len(cut):
        # all short groups of the batch at once
        sig = _by_signature(payload)
        for n in range(2, 25):
            at = cut[size == n]
            for i in range(n):
                for j in range(i + 1, n):
                    hit = (sig[at + i] == sig[at + j]).sum(1) >= MATCHES
                    a.append(ids[at[hit] + i])
                    b.append(ids[at[hit] + j])
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return forest(np.concatenate(a), np.concatenate(b))


def _stream(link: Callable, small: bool, limit: int):
    """Solve groups of a sorted partition, holding no more rows than a group and a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = _solve(pdf["id"].to_numpy(np.int64), pdf["group"].to_numpy(np.int64), pdf["payload"].tolist(), link, small)
            return pd.DataFrame({"a": a, "b": b})

        for pdf in batches:
            held.append(pdf)
            count += len(pdf)
            if count < limit:
                continue
            pdf = pd.concat(held, ignore_index=True)
            last = int(np.searchsorted(pdf["group"].to_numpy(np.int64), pdf["group"].iat[-1]))
            if last:
                yield solve(pdf.iloc[:last])
                pdf = pdf.iloc[last:]
            held, count = [pdf], len(pdf)
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    return run


def _cross(link: Callable):
    """Links between a block's members and the outsiders of its group; rows are sorted by group, the members first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, own, held = None, [], []

        def solve() -> pd.DataFrame:
            part, mine = pd.concat(held), pd.concat(own)
            held.clear()
            i, j = np.nonzero(link(part["payload"].tolist(), mine["payload"].tolist()))
            a, b = part["id"].to_numpy(np.int64)[i], mine["id"].to_numpy(np.int64)[j]
            x, y = forest(a[a != b], b[a != b])
            return pd.DataFrame({"a": x, "b": y})

        for pdf in batches:
            for (key, outside), part in pdf.groupby(["group", "outside"], sort=False):
                if key != group:
                    if held and own:
                        yield solve()
                    group, own, held = key, [], []
                if not outside:
                    own.append(part)
                    continue
                for lo in range(0, len(part), BLOCK):
                    held.append(part.iloc[lo : lo + BLOCK])
                    if own and (sum(map(len, held)) >= BLOCK or sum(p["weight"].sum() for p in held) >= BLOCK_SHINGLES):
                        yield solve()
        if held and own:
            yield solve()

    return run


def linked(members: DataFrame, payloads: DataFrame, link: Callable, tag: str, small: bool = False) -> DataFrame:
    """Links (a, b) that span the components of every group under link.

    members: group, id (distinct rows); payloads: id, weight, payload. link: a matrix for two lists of payloads.
    """
    # members, and tables of a row a group or id, grow with the input, so they are never broadcast; estimates don't know how many rows an explode makes
    fetch = lambda t: t.hint("merge").join(payloads, "id")
    if small:
        members = members.select("group", "id", F.lit(1).alias("weight"))
    else:
        members = members.hint("merge").join(payloads.groupBy("id").agg(F.max("weight").alias("weight")), "id").select("group", "id", "weight")
    sizes = members.groupBy("group").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).where("n > 1")
    sizes = stored(sizes, f"{tag}-sizes")  # a join of two shuffles, so that large groups can be split
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("w") / BLOCK_SHINGLES)).cast("int")
    rows = members.hint("merge").join(sizes, "group").withColumn("blocks", F.least(blocks, F.col("n").cast("int")))
    rows = stored(rows.select("group", "id", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")), f"{tag}-members")
    schema = "a long, b long"
    full = fetch(rows).select(F.xxhash64("group", "block").alias("group"), "id", "payload")
    one = stored(full.repartition("group").sortWithinPartitions("group", "id").mapInPandas(lean(_stream(link, small, 20_000 if small else 256)), schema), f"{tag}-blocks")
    large = rows.where("blocks > 1")
    if large.isEmpty():
        return one
    # a few members of each block's components, the largest first, meet those of the other blocks
    comp = components(one, f"{tag}-in-block")
    inside = large.hint("merge").join(comp, "id", "left").select("group", "id", "blocks", "block", F.coalesce("component_id", "id").alias("c"))
    inside = stored(inside, f"{tag}-large")
    weight = inside.groupBy("group", "block", "c").agg(F.count("*").alias("m"))
    top = weight.groupBy("group", "block").agg(F.max(F.struct("m", "c")).alias("t")).select("group", "block", F.col("t.c").alias("c"))
    lead = inside.hint("merge").join(top, ["group", "block", "c"]).where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(BLOCK)) < LEADERS).select("group", "id").distinct()
    # count, most and the outsiders' groups have a row a large group, a small part of the members
    count = lead.groupBy("group").agg(F.count("*").alias("n"))
    lead = lead.join(count, "group").withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / (2 * BLOCK))))
    lead_rows = fetch(lead).select(F.xxhash64("group", "part").alias("group"), "id", "payload")
    two = stored(lead_rows.repartition("group").sortWithinPartitions("group", "id").mapInPandas(lean(_stream(link, small, 256)), schema), f"{tag}-leaders")
    links = one.unionByName(two)
    comp = components(links, f"{tag}-led")
    inside = large.hint("merge").join(comp, "id", "left").select("group", "id", "blocks", "block", F.coalesce("component_id", "id").alias("c"))
    most = inside.groupBy("group", "c").agg(F.count("*").alias("m")).groupBy("group").agg(F.max(F.struct("m", "c")).alias("t")).select("group", F.col("t.c").alias("most"))
    outside = stored(inside.join(most, "group").where("c <> most").select("group", "id", "blocks"), f"{tag}-outside")
    if outside.isEmpty():
        return links
    spread = outside.select("group", "id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("outside"))
    # only groups with outsiders need their blocks again
    both = large.join(outside.select("group").distinct(), "group", "left_semi").select("group", "id", "block", F.lit(False).alias("outside")).unionByName(spread)
    cross = fetch(both).select(F.xxhash64("group", "block").alias("group"), "outside", "id", "weight", "payload").repartition("group").sortWithinPartitions("group", "outside", "id")
    return links.unionByName(stored(cross.mapInPandas(lean(_cross(link)), schema), f"{tag}-rest"))


def prefixes(sig: DataFrame) -> DataFrame:
    """(group, id): the prefix postings of each signature, of lists with more than one member."""
    posts = sig.select("id", F.posexplode("coords").alias("c", "v")).select("id", F.xxhash64("c", "v").alias("group"))
    often = posts.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    shared = posts.hint("merge").join(often, "group")
    # lists of one member come first in the order and take their part of the prefix
    listed = shared.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "group"))).alias("l"))  # COORDS at most
    length = F.lit(COORDS - MATCHES + 1) - (F.lit(COORDS) - F.size("l"))
    return listed.where(length > 0).select("id", F.explode(F.slice("l", F.lit(1), length)).alias("p")).select(F.col("p.group").alias("group"), "id")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = stored(docs.mapInPandas(lean(_sketches(shingle)), "doc_id long, n_shingles long, k1 long, k2 long, sig binary"), "mh-sketches")
    classes = sketch.where("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min_by(F.struct("doc_id", "sig"), "doc_id").alias("r")).where("r is not null")
    reps = stored(classes.select("k1", "k2", "n_shingles", "r.doc_id", "r.sig"), "mh-classes")
    unpack = F.pandas_udf(lambda s: pd.Series([np.frombuffer(x, np.uint32).astype(np.int64) for x in s], dtype=object), "array<bigint>")
    posted = stored(prefixes(reps.select(F.col("doc_id").alias("id"), unpack("sig").alias("coords"))), "mh-prefixes")
    sigs = reps.select(F.col("doc_id").alias("id"), F.lit(1).alias("weight"), F.col("sig").alias("payload"))
    pairs = linked(posted, sigs, same_signature, "mh-lists", small=True)
    clusters = components(pairs, "mh-clusters")
    # texts move once, those of clusters' members stay
    texts = docs.select(F.col("doc_id").alias("id"), "text").where("id is not null").join(clusters.select("id").hint("merge"), "id")
    sets = stored(texts.mapInPandas(lean(_sets(shingle)), "id long, weight long, payload binary"), "mh-texts")
    sure = linked(clusters.select(F.col("component_id").alias("group"), "id"), sets, same_sets(percent), "mh-sets")
    found = components(sure, "mh-components")
    rep = reps.select("k1", "k2", "n_shingles", F.col("doc_id").alias("rep")).hint("merge").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    rep = rep.select("k1", "k2", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    out = sketch.select("doc_id", "n_shingles", "k1", "k2").hint("merge").join(rep, ["k1", "k2", "n_shingles"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
