"""What the operators of this subpackage share: tables, the shared folder, words, union of links."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of characters other than space and \t to \r.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What str.split() also splits at.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
WORD_SQL = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
#: Characters of text that a Python worker holds as words at once.
CHUNK_CHARS = 6_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give executors this package, wherever the driver runs from."""
    sc = spark.sparkContext
    if getattr(sc, "_sluice_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    at = os.path.join(os.path.realpath(tempfile.mkdtemp()), "sluice_pkg.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(at)
    sc._sluice_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; one of its own where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = known.get() if known.isDefined() else None
    if not at:
        at = "file://" + os.path.join(tempfile.gettempdir(), "sluice-checkpoints")
        spark.sparkContext.setCheckpointDir(at)
    return at


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors.

    Hadoop removes the files when the driver's JVM ends, if forget() hasn't before.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/sluice-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    out._sluice_path = at
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables from stored() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._sluice_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give the memory that this process has freed back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library of another kind has no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for a task's batches; its worker, which stays for later tasks and stages, then keeps no more memory than it uses."""

    def own(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return own


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the value as text, modulo m."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(m))


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[slice]:
    """Slices of the list with about so many characters; a longer text is a slice of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t)
        if i > begin and size + n > limit:
            yield slice(begin, i)
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield slice(begin, len(texts))


def texts_of(pdf: pd.DataFrame, name: str = "text") -> list[str]:
    """The column's texts; a null counts as empty."""
    return [t if isinstance(t, str) else "" for t in pdf[name]]


def slabs(batches: Iterator[pd.DataFrame], limit: int = CHUNK_CHARS, name: str = "text") -> Iterator[pd.DataFrame]:
    """The rows, with empty texts for nulls, in frames of about so many characters; a longer text is a frame of its own."""
    held, size = [], 0
    for pdf in batches:
        texts = texts_of(pdf, name)
        pdf = pdf.assign(**{name: texts})
        for at in chunks(texts, limit):
            n = sum(map(len, texts[at]))
            if held and size + n > limit:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
            held.append(pdf.iloc[at])
            size += n
    if held:
        yield pd.concat(held, ignore_index=True)


def packed(x: np.ndarray) -> bytes:
    """Unsigned whole numbers as compressed planes of their bytes."""
    import zstandard

    x = np.ascontiguousarray(x).astype(np.uint64)
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    """The numbers of packed()."""
    import zstandard

    width, planes = data[0], np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = planes.reshape(width, -1).T
    return out.view(np.uint64).ravel()


def word_bytes(text: str) -> list[bytes]:
    """The words of a text with A-Z lower-cased, as UTF-8: bytes split at just the six white characters, and lower just these letters."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def words(text: str) -> list[str]:
    """The same as WORD.findall(text), by the faster str.split() where that splits alike."""
    return WORD.findall(text) if ODD_SPACE.search(text) else text.split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its component) of the links a[i]-b[i], for ids that aren't the smallest themselves."""
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ids, ix = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ix[: len(a)], ix[len(a) :]
    root = np.arange(len(ids))
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while not np.array_equal(root, jumped := root[root]):
            root = jumped
        if np.array_equal(before, root):
            break
    keep = root != np.arange(len(ids))
    return ids[keep], ids[root[keep]]


#: Links that one task reduces to a forest at once.
FOREST_LINKS = 400_000


def _local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, count = [], 0

    def solve() -> pd.DataFrame:
        a, b = forest(*(np.concatenate([p[c].to_numpy(np.int64) for p in held]) for c in ("a", "b")))
        return pd.DataFrame({"a": a, "b": b})

    for pdf in batches:
        held.append(pdf)
        count += len(pdf)
        if count >= FOREST_LINKS:
            held, count = [solve()], 0
            yield held.pop()
    if held:
        yield solve()


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(id, component_id) of every id in the links (a, b); component_id is the smallest id reachable.

    Tasks first reduce their links to forests, then so many of these as one task may hold to one forest. If that is one
    task's work, it is done. Else labels fall to the smallest neighbour's label and then to that label's own label, until their sum stays;
    each round is one aggregate with map-side combine and three equi-joins without broadcasts, written to the shared folder.
    """
    spark = edges.sparkSession
    ship(spark)
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    some = stored(edges.mapInPandas(lean(_local_forest), "a long, b long").distinct(), f"{tag}-links")
    tasks = -(-some.count() // FOREST_LINKS)
    thin = stored(some.coalesce(max(1, tasks)).mapInPandas(lean(_local_forest), "a long, b long"), f"{tag}-forest")
    if tasks <= 1:
        # one forest: each id with its root, and the roots
        return thin.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(thin.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
    both = thin.unionByName(thin.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("c")), f"{tag}-0")
    total = F.sum(F.col("c").cast("decimal(38,0)"))
    before, k = label.agg(total).first()[0], 0
    while before is not None:
        k += 1
        low = both.hint("merge").join(label.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        near = label.hint("merge").join(low, "a").select("a", F.least("c", "m").alias("c"))
        far = label.select(F.col("a").alias("c"), F.col("c").alias("cc"))
        old, label = label, stored(near.hint("merge").join(far, "c", "left").select("a", F.least("c", F.coalesce("cc", "c")).alias("c")), f"{tag}-{k}")
        forget(old)
        now = label.agg(total).first()[0]
        if now == before:
            break
        before = now
    return label.select(F.col("a").alias("id"), F.col("c").alias("component_id"))
