"""Best-fit packing into fixed-size sequences with a swap-based local search.

Documents become token ids and, where longer than a sequence, pieces. Pieces are dealt over shards of bounded
size by a hash. Each shard is packed best-fit decreasing; then its underfull bins exchange pieces one for one,
one for two, or move a piece, whenever that raises the sum of squared fills, so that fill gathers in few bins and others
empty; the search ends when no exchange gains. The bins that stay underfull are dealt again over fewer shards and packed anew, as long as that makes
them fewer. No task holds more than a shard.

Input cases: a null text counts as empty (one piece: the end id); equal rows are packed each for itself, pieces
of rows with one id are told apart by a row's own number; ties go to the lower bin; an empty table gives no row.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import lean, ship, stored

CAPACITY = 1024
SHARD = 2500
#: Bins below this share of the capacity are dealt again.
UNDERFULL = 0.995
#: Runs whose ids a worker keeps.
CACHE = 100_000
#: Rows of a batch that a worker holds as Python's objects.
ROWS = 1000
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, the ids of each space-led run of characters being kept.

    A cut before a space between two characters that are no white space is a cut of the pre-tokenizer
    as well, so ids of such runs can be joined. Texts with other white space around spaces go through whole.
    """

    def __init__(self, ranks_path: str, json_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.whole = json_path, None
        self.led: dict[str, bytes | None] = {}

    def _bytes(self, text: str) -> bytes:
        return np.array(self.own.encode_ordinary(text), "<u4").tobytes()

    def _exact(self, text: str) -> bytes:
        if SPECIAL not in text:
            return self._bytes(text)
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.json_path)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if SPECIAL in text:
            return self._exact(text)
        first, *rest = text.split(" ")
        if not rest:
            return self._bytes(text)
        if not first or first[-1].isspace():
            return self._exact(text)
        led = self.led
        if len(led) > CACHE:
            led.clear()
        out = [self._bytes(first)]
        for x in rest:
            got = led.get(x)
            if got is None:
                if not x or x[0].isspace() or x[-1].isspace():
                    return self._exact(text)
                got = self._bytes(" " + x)
                if len(x) < 40:
                    led[x] = got
            out.append(got)
        return b"".join(out)


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(paths: tuple) -> Encoder:
    if paths not in _ENCODERS:
        _ENCODERS[paths] = Encoder(*paths)
    return _ENCODERS[paths]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only longer ones are cut, the first piece takes what is over."""
    if n <= capacity:
        return [(0, n)]
    over = n % capacity
    begin = [0, *range(over, n, capacity)] if over else [*range(0, n, capacity)]
    return [(a, (b if b is not None else n) - a) for a, b in zip(begin, [*begin[1:], None], strict=True)]


def pieces_of(docs: DataFrame, paths: tuple, end_id: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's pieces. paths: (ranks, json, pattern)."""
    ship(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
        enc, end = _encoder(paths), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            # a batch may be large; only some of its rows are Python's at a time
            for lo in range(0, batch.num_rows, ROWS):
                part, rows = batch.slice(lo, ROWS), []
                for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    data = enc.ids(t or "") + end
                    rows += [(i, k, a, n, zlib.crc32(data[4 * a : 4 * (a + n)])) for k, (a, n) in enumerate(cut(len(data) // 4, capacity))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece goes into the fullest bin that has room. Bins of piece numbers."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        free = mask >> n
        if free:
            at = n + (free & -free).bit_length() - 1
            b = room[at].pop()
            if not room[at]:
                mask &= ~(1 << at)
        else:
            at, b = capacity, len(bins)
            bins.append([])
        bins[b].append(int(i))
        room[at - n].append(b)
        mask |= 1 << (at - n)
    return bins


class Stock:
    """Pieces that other bins may take, one by one or two of one bin, by size; what has gone is passed over when it is met."""

    def __init__(self, capacity: int):
        self.lists: list[list] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, size: int, item) -> None:
        self.lists[size].append(item)
        self.mask |= 1 << size

    def largest(self, most: int, over: int, good) -> tuple[int, object] | None:
        """The largest item of at most `most` and more than `over`."""
        mask = self.mask & ((1 << (most + 1)) - 1)
        while (size := mask.bit_length() - 1) > over:
            held = self.lists[size]
            while held:
                if good(held[-1]):
                    return size, held[-1]
                held.pop()
            self.mask &= ~(1 << size)
            mask &= ~(1 << size)
        return None


def one_a_size(pieces: list[int], size_of: list[int]) -> list[int]:
    """One piece of each size; a bin holds few different sizes, since they add up to the capacity at most."""
    return list({size_of[p]: p for p in pieces}.values())


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Raise the sum of squared fills by moves, one-for-one and two-for-one exchanges, until no bin gains.

    From the fullest on, each underfull bin takes from emptier ones whatever best closes its gap: a piece for none, one or two of its own, or two
    of one bin for none or one. It only ever gains, so each exchange raises the squared fill and the search ends. Emptied bins go.
    """
    bins = [[*b] for b in bins]
    size = [int(lengths[b].sum()) for b in bins]
    size_of = lengths.tolist()
    where = np.zeros(len(lengths), int).tolist()
    changed = True
    while changed:
        changed = False
        order = sorted((b for b in range(len(bins)) if 0 < size[b] < capacity), key=lambda b: (-size[b], b))
        free = bytearray(len(size_of))
        one, two = Stock(capacity), Stock(capacity)
        for b in reversed(order):
            for p in bins[b]:
                where[p], free[p] = b, 1
                one.add(size_of[p], p)
            few = one_a_size(bins[b], size_of)
            twins = [(p, q) for p in few for q in bins[b] if q != p and size_of[q] == size_of[p]][: len(few)]
            for p, q in [(p, q) for i, p in enumerate(few) for q in few[i + 1 :]] + twins:
                two.add(size_of[p] + size_of[q], (p, q))
        whole = lambda t: free[t[0]] and free[t[1]] and where[t[0]] == where[t[1]]
        single = free.__getitem__
        for a in order:
            for p in bins[a]:
                free[p] = 0
            while (gap := capacity - size[a]) and bins[a]:
                few = one_a_size(bins[a], size_of)
                outs = {0: ()} | {size_of[p]: (p,) for p in few}
                pairs = {size_of[p] + size_of[q]: (p, q) for i, p in enumerate(few) for q in few[i + 1 :]}
                best = 0, (), ()
                for stock, good, gone in ((one, single, outs | {k: v for k, v in pairs.items() if k not in outs}), (two, whole, outs)):
                    for out, go in gone.items():
                        if best[0] == gap:
                            break
                        got = stock.largest(min(out + gap, capacity), out + best[0], good)
                        if got:
                            best = got[0] - out, go, (got[1],) if stock is one else got[1]
                gain, gone, come = best
                if not gain:
                    break
                b = where[come[0]]
                for p in come:
                    bins[b].remove(p)
                    free[p], where[p] = 0, a
                for p in gone:
                    bins[a].remove(p)
                    for q in one_a_size(bins[b], size_of):
                        two.add(size_of[p] + size_of[q], (p, q))
                    bins[b].append(p)
                    free[p], where[p] = 1, b
                    one.add(size_of[p], p)
                bins[a] += come
                size[a] += gain
                size[b] -= gain
                changed = True
    return [b for b in bins if b]


def _pack_group(capacity: int, tag: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "uid"], ascending=[False, True], kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        seq, off, fill = (np.empty(len(pdf), np.int64) for _ in range(3))
        for k, b in enumerate(bins):
            ends = np.cumsum(lengths[b])
            seq[b] = (tag << 56) + (int(key[0]) << 24) + k
            off[b] = ends - lengths[b]
            fill[b] = ends[-1]
        return pdf.assign(sequence_id=seq, offset=off, fill=fill)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """pieces (any columns, length among them) with sequence_id and offset; at most capacity a sequence."""
    spark = pieces.sparkSession
    ship(spark)
    clash = [c for c in pieces.columns if c in ("uid", "shard", "sequence_id", "offset", "fill")]
    rows = stored(pieces.drop(*clash).withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    full = rows.where(F.col("length") >= capacity).select("*", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # what is dealt over shards: number and length; the rest joins again at the end
    left = rows.where(F.col("length") < capacity).select("uid", "length")
    schema = "uid long, length long, shard long, sequence_id long, offset long, fill long"
    done, round_no, open_bins = None, 0, None
    while True:
        n = left.count()
        if not n:
            break
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(round_no)), F.lit(max(1, n // shard))))
        packed = stored(dealt.groupBy("shard").applyInPandas(_pack_group(capacity, round_no), schema), f"pack-{round_no}")
        under = F.col("fill") < int(capacity * UNDERFULL)
        before, open_bins = open_bins, packed.where(under).select("sequence_id").distinct().count()
        # dealt again as long as that makes fewer underfull bins by a hundredth
        last = open_bins == 0 or n <= shard or (before is not None and 100 * open_bins > 99 * before)
        part = packed if last else packed.where(~under)
        done = part if done is None else done.unionByName(part)
        if last:
            break
        left, round_no = packed.where(under).select("uid", "length"), round_no + 1
    out = [*rows.drop("uid").columns, "sequence_id", "offset"]
    if done is None:
        return full.select(out)
    return full.select(out).unionByName(rows.join(done.select("uid", "sequence_id", "offset"), "uid").select(out))


def pack_documents(docs: DataFrame, paths: tuple, end_id: int = 2, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    return pack(pieces_of(docs, paths, end_id, capacity), capacity, shard)
