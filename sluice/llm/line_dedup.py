"""Removal of lines that repeat an earlier line, up to one edited word, by a deletion-neighbourhood join.

A line is its words; a line without words stays. Equal lines are one class with its earliest place (doc_id, row, line). Two
classes of MIN_WORDS words or more are near if one word inserted, removed or replaced turns one into the other; shorter lines, in which a word is too much, are only
compared for equality. A line goes if its class or a near class has an earlier place. edits is the edit bound: 1, or 0 for equal lines only.

Near classes share a half: the edit lies in the other. So only classes whose half is also found in another class emit
deletion variants, hashed; that leaves out no near pair. Lines of n words meet under equal variants of equal position
(a replaced word), or one's variant is another (a removed word). From each variant only the earliest member is looked at,
which bounds the work by the number of variants, however large a group is. The edit distance of what was found is then verified on the words.

Input cases: a null text has no lines and stays null; an empty text has one empty line, which stays; of rows with one doc_id and different texts each is a document, in the order of
a hash of the text; copies of a row keep and lose the same lines; null ids are the earliest; columns other than text and n_chars pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import WORD_SQL, lean, mix64, ship, stored, words
from sluice.llm.toxicity import hash_word

MIN_WORDS = 5
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SUB, FULL, DEL = 0, 1, 2
#: A line's place: row is a hash of the document's id and text, which tells rows with one id apart.
PLACE = ("doc_id", "row", "line_no")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id without nulls (the least number stands for them), row, text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("doc_id"), row_key().alias("row"), "text")


def plain(text: Column) -> Column:
    """The text with spaces for the other white characters of a line."""
    odd = [F.contains(text, F.lit(c)) for c in "\t\r\v\f"]
    return F.when(odd[0] | odd[1] | odd[2] | odd[3], F.translate(text, "\t\r\v\f", "    ")).otherwise(text)


def words_of(line: Column) -> Column:
    """The words of a plain line; a split at one character is cheaper than a pattern."""
    return F.array_remove(F.split(line, " "), "")


def row_key():
    return F.xxhash64("doc_id", "text")


def lines_of(docs: DataFrame) -> DataFrame:
    """PLACE, w (words) and the two hashes h, g of each line with words."""
    rows = keyed(docs).select("doc_id", "row", F.posexplode(F.split(plain(F.col("text")), "\n")).alias("line_no", "line"))
    rows = rows.select(*PLACE, words_of(F.col("line")).alias("w")).where(F.size("w") > 0)
    return rows.select("*", F.xxhash64("w").alias("h"), F.xxhash64(F.lit(7), "w").alias("g"))


def half_keys():
    """Hashes of the first and last half, for the line's own number of words and for one less."""
    n = F.size("w")
    out = []
    for size in (n, n - 1):
        head = F.floor(size / 2).cast("int")
        tail = size - head
        out += [F.xxhash64(size, F.lit("P"), F.slice("w", F.lit(1), head)), F.xxhash64(size, F.lit("S"), F.slice("w", n - tail + 1, tail))]
    return F.array(*out)


def variant_keys(w: list[str], head: bool = True, tail: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(key, role) of a line: itself as FULL, and each one-word deletion as DEL (by words left) and SUB (by words left and place).

    head: the edit may lie behind a shared first half; tail: before a shared last half. Other places can't be edited.
    """
    n = len(w)
    x = np.fromiter(map(hash_word, w), np.uint64, n)
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, INVERSE)]))
    # sum of x[j] * BASE^-j, so that a stretch's hash is a difference
    run = np.concatenate([[np.uint64(0)], np.cumsum(x * inverse[:n])])
    left = run[:n] + (run[n] - run[1:]) * BASE  # what is left after deletion i, the words behind it moved one place
    size = np.uint64(n)
    gone = mix64(left + mix64(np.array([size - np.uint64(1)], np.uint64)))
    full = mix64(run[n:] + mix64(np.array([size], np.uint64)))
    place = mix64(gone ^ mix64(np.arange(n, dtype=np.uint64) + np.uint64(1 << 40)))
    at = np.arange(n)
    some = (head & (at >= (n - 1) // 2)) | (tail & (at <= n // 2))
    gone, place, n = gone[some], place[some], int(some.sum())
    keys = np.concatenate([full, np.unique(gone), place])
    roles = np.repeat([FULL, DEL, SUB], [1, len(keys) - 1 - n, n])
    return keys.astype(np.int64), roles


def word_distance_at_most_one(a: list[str], b: list[str]) -> bool:
    n, m = len(a), len(b)
    if abs(n - m) > 1:
        return False
    i = 0
    while i < min(n, m) and a[i] == b[i]:
        i += 1
    return a[i + (n >= m) :] == b[i + (m >= n) :]


def _variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for a in range(0, len(pdf), 2000):
            part = pdf.iloc[a : a + 2000]
            got = [variant_keys(list(w), head, tail) for w, head, tail in zip(part["w"], part["head"], part["tail"], strict=True)]
            at = np.repeat(np.arange(len(part)), [len(k) for k, _ in got])
            yield pd.DataFrame({"key": np.concatenate([k for k, _ in got]), "role": np.concatenate([r for _, r in got]), "no": part["no"].to_numpy()[at]})


def near_places(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """h, g and near_place, the earliest place of a near class, of the classes (h, g, place, halves) with a near class before them."""
    halves = classes.where("halves is not null").select("h", "g", "place", F.posexplode("halves").alias("k", "half"))
    shared = halves.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("half")
    near = halves.join(shared, "half", "left_semi").groupBy("h", "g").agg(F.first("place").alias("place"), F.max(F.col("k") % 2 == 0).alias("head"), F.max(F.col("k") % 2 == 1).alias("tail"))
    # numbers in the order of places: a variant carries 8 bytes instead of a place
    near = stored(near.repartitionByRange("place").sortWithinPartitions("place").withColumn("no", F.monotonically_increasing_id()), "line-numbers")
    line = F.struct("place.line_no", "no", "h", "g", "head", "tail")
    wanted = near.groupBy("place.row").agg(F.collect_list(line).alias("wanted"))  # a document's lines
    found = keyed(docs).join(wanted, "row").select("doc_id", "row", F.explode("wanted").alias("x"), F.split(plain(F.col("text")), "\n").alias("parts"))
    words_at = words_of(F.get("parts", F.col("x.line_no")))
    found = found.select(F.struct("doc_id", "row", "x.line_no").alias("at"), "x.no", "x.h", "x.g", "x.head", "x.tail", words_at.alias("w"))
    lines = stored(found.dropDuplicates(["h", "g"]), "line-near")  # once for copies of a row
    # one row a line, spread evenly: long lines make many variants
    spread = lines.select("no", "head", "tail", "w").repartition("no")
    variants = stored(spread.mapInPandas(lean(_variants), "key long, role int, no long"), "line-variants")
    best = variants.groupBy("key").agg(*[F.min(F.when(F.col("role") == r, F.col("no"))).alias(f"r{r}") for r in (SUB, FULL, DEL)], F.count("*").alias("n")).where("n > 1").drop("n")
    partner = F.when(F.col("role") == SUB, F.col(f"r{SUB}")).when(F.col("role") == FULL, F.col(f"r{DEL}")).otherwise(F.col(f"r{FULL}"))
    met = variants.join(best, "key").select("no", partner.alias("p")).where(F.col("p") < F.col("no"))
    met = met.groupBy("no").agg(F.min("p").alias("p"))
    verify = F.pandas_udf(lambda a, b: pd.Series([word_distance_at_most_one(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype=bool), "boolean")
    other = lines.select(F.col("no").alias("p"), F.col("at").alias("near_place"), F.col("w").alias("pw"))
    sure = met.join(lines.select("no", "h", "g", "w"), "no").select("h", "g", "w", "p").join(other, "p").where(verify("w", "pw"))
    return sure.select("h", "g", "near_place")


def earliest(docs: DataFrame, edits: int = 1) -> DataFrame:
    """h, g and place (the earliest of the class and near classes) of every class that has a later line to lose."""
    ship(docs.sparkSession)
    halves = F.when(F.size("w") >= MIN_WORDS, half_keys()) if edits else F.lit(None).cast("array<bigint>")
    classes = lines_of(docs).select("h", "g", *PLACE, halves.alias("halves")).groupBy("h", "g").agg(F.min(F.struct(*PLACE)).alias("place"), F.count("*").alias("n"), F.first("halves").alias("halves"))
    classes = stored(classes, "line-classes")
    out = classes.select("h", "g", "place", "n") if edits else classes.where("n > 1")
    near = F.col("place")
    if edits:
        out = out.join(near_places(docs, classes), ["h", "g"], "left").where("n > 1 or near_place is not null")
        near = F.least("place", F.coalesce("near_place", "place"))
    return stored(out.select("h", "g", near.alias("place")), "line-earliest")


def removed_lines(docs: DataFrame, edits: int = 1) -> DataFrame:
    """row and removed (its line numbers that go, from 0) of documents that lose lines."""
    docs = docs.select("doc_id", "text")
    first = earliest(docs, edits)
    lost = lines_of(docs).select(*PLACE, "h", "g").join(first, ["h", "g"]).where(F.col("place") < F.struct(*PLACE))
    return lost.groupBy("row").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def _with_removed(docs: DataFrame, edits: int) -> DataFrame:
    """docs with the columns _row and _removed; null where nothing goes."""
    lost = removed_lines(docs, edits).select(F.col("row").alias("_row"), F.col("removed").alias("_removed"))
    return docs.withColumn("_row", row_key()).join(lost, "_row", "left")


def dedup_lines(docs: DataFrame, drop_emptied: bool = False, edits: int = 1) -> DataFrame:
    """docs with their lines removed from text; with drop_emptied, documents that lose all their words go."""
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_removed", i)), "\n")
    rows = _with_removed(docs, edits)
    if drop_emptied:
        rows = rows.where(F.col("_removed").isNull() | kept.rlike(WORD_SQL))
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(kept)
    return rows.select(*[text.alias("text") if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def line_report(docs: DataFrame, edits: int = 1) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (list of line numbers) of every row."""
    rows = _with_removed(docs.select("doc_id", "text"), edits)
    lines = F.greatest(F.coalesce(F.size(F.split("text", "\n")), F.lit(0)), F.lit(0)).cast("long")
    return rows.select("doc_id", lines.alias("n_lines"), F.coalesce(F.size("_removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("_removed", ","), F.lit("")).alias("removed"))


ORACLE = r"""
with parts as (select doc_id, string_split(text, chr(10)) as p from documents where text is not null),
l as (select doc_id, i - 1 as line_no, regexp_extract_all(p[i], '[^\x20\x09-\x0D]+') as w from parts, unnest(range(1, len(p) + 1)) as u(i)),
e as (select doc_id, line_no, doc_id * 10000000 + line_no as o, w, array_to_string(w, ' ') as k from l where len(w) >= 1),
c as (select k, any_value(w) as w, min(o) as o from e group by k),
v as (select k, o, len(w) as n, i, array_to_string(list_concat(w[1:i-1], w[i+1:len(w)]), ' ') as r from c, unnest(range(1, len(w) + 1)) as u(i) where len(w) >= 5),
s as (select n, i, r, min(o) as o from v group by all),
near as (
  select v.k, min(s.o) as o from v join s using (n, i, r) group by v.k
  union all select v.k, min(c.o) from v join c on v.r = c.k where len(c.w) >= 5 group by v.k
  union all select c.k, min(v.o) from v join c on v.r = c.k where len(c.w) >= 5 group by c.k),
m as (select c.k, least(min(c.o), coalesce(min(near.o), min(c.o))) as o from c left join near using (k) group by c.k),
x as (select e.doc_id, e.line_no from e join m using (k) where e.o > m.o),
g as (select doc_id, count(*) as n, string_agg(line_no::varchar, ',' order by line_no) as removed from x group by doc_id)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::bigint as n_lines, coalesce(g.n, 0)::bigint as n_removed, coalesce(g.removed, '') as removed
from documents d left join g using (doc_id)
"""
