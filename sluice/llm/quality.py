"""Quality rules: base counts, and perplexity bands of a modified Kneser-Ney model.

The model predicts the characters of a word and its end from the four characters before (word start included),
one model a language and one of all languages, mixed four to one. Spark counts the 5-grams of all reference documents, every one of them, and
from these the lower orders: in how many different symbols' wake an n-gram is found; n-grams at a word's start, which have nothing before them, keep their counts.
Discounts of one, two and more come from the counts of counts of each language and order.

Each n-gram is stored under a 64-bit hash of language, order and symbols, with its discounted share, and each context with its backoff weight,
in sorted arrays. The arrays are cut into as many slices as hold SLICE_ROWS n-grams each, by the two symbols before the last, so that a slice has all orders
that its n-grams back off to (the orders one and two are in every slice). One slice after the other is broadcast and scores the n-grams that are its own in all documents; a document's sums add up. So no n-gram is cut and no more
than a slice is broadcast, at any size; small models are one slice.

Reference documents are those that pass the base rules, have few symbols and are mostly lower case. A document's perplexity is that of its symbols (characters of words, and
words' ends). A language's band is the reference documents' median log-perplexity, plus and minus a
number of robust standard deviations; for short documents it is wider by the symbols' own spread.

Input cases: a null or empty text has zero counts, fails the base rules and has no perplexity; a null language is a language
of its own; a language without reference documents has no band and keeps what passes the base rules; equal rows get equal results, rows of one id each their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import forget, mix64, ship, slabs, stored

ORDER = 5
BITS = 12
#: N-grams and contexts of a slice, on average.
SLICE_ROWS = 4_000_000
MIN_WORDS, MAX_REPEAT_PCT, WINDOW = 20, 30, 8
BAND, WITHIN = 9.0, 6.0
SYMBOLS = "#*$%&|<>"
#: Rows (one a language) up to which a table of languages is broadcast.
MANY_LANGS = 10_000
START, END, MASK = 1, 2, (1 << BITS) - 1
NO_LANG, ALL = "\0none", "\0all"
#: Share of the model of all languages in a symbol's probability: texts that quote other languages stay probable.
POOLED = 0.2
#: Distinct words that a worker counts, or keeps the scores of, before it starts anew.
WORDS_HELD = 400_000


def code_points(joined: bytes) -> np.ndarray:
    return np.frombuffer(joined.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def symbol_codes(cp: np.ndarray) -> np.ndarray:
    """Code points as 12-bit symbols: those under 2048 as they are, others hashed over the rest; 1 and 2 are the word's start and end."""
    high = np.uint64(2048) + (cp * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(2048)
    return np.where(cp < 2048, np.where(cp < 3, np.uint64(3), cp), high)


def word_windows(types: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(5-gram, number of its word) for every symbol of each word and its end."""
    joined = b"\0".join(types) + b"\0"
    octets = np.fromiter(map(len, types), np.int64, len(types)) + 1
    # characters: bytes that don't go on with one
    sizes = np.add.reduceat((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80, np.cumsum(octets) - octets, dtype=np.int64)
    codes = symbol_codes(code_points(joined))
    ends = np.cumsum(sizes) - 1
    codes[ends] = END
    owner = np.repeat(np.arange(len(types)), sizes)
    place = np.arange(len(codes)) - np.repeat(ends - sizes + 1, sizes)
    gram = codes.copy()
    for back in range(1, ORDER):
        prev = np.concatenate([np.full(back, START, np.uint64), codes[:-back]])[: len(codes)]
        gram |= np.where(place >= back, prev, np.uint64(START)) << np.uint64(BITS * back)
    return gram, owner


class Words:
    """The words of some texts: kinds, and of all words one after the other the number of its kind and of its text."""

    def __init__(self, texts: list[str]):
        table: dict[bytes, int] = defaultdict(count().__next__)
        ids = [np.fromiter(map(table.__getitem__, t.encode("utf-8", "surrogatepass").split()), np.int64) for t in texts]
        self.kinds = list(table)
        self.sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids = np.concatenate(ids) if ids else np.empty(0, np.int64)
        self.row = np.repeat(np.arange(len(ids)), self.sizes)


def _dup_lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) == 1:
        return 0
    seen = Counter(lines)
    return 0 if len(seen) == len(lines) else sum(c - 1 for x, c in seen.items() if c > 1 and x.encode("utf-8", "surrogatepass").split())


def base_counts(texts: list[str]) -> tuple[pd.DataFrame, Words]:
    """The base columns of each text, and its words."""
    found = Words(texts)
    total = len(found.ids)
    repeat = np.zeros(len(texts), np.int64)
    if total >= WINDOW:
        h = mix64(np.arange(len(found.kinds), dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))[found.ids]
        n = total - WINDOW + 1
        win = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            win = win * np.uint64(6364136223846793005) + h[k : k + n]
        at = np.flatnonzero(found.row[:n] == found.row[WINDOW - 1 :])
        # equal windows of one text are neighbours in the order of (window and text) hashes
        key = mix64(win[at]) ^ mix64(found.row[at].astype(np.uint64) + np.uint64(77))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        hits = at[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]
        edge = np.zeros(total + 1, np.int64)
        np.add.at(edge, hits, 1)
        np.add.at(edge, hits + WINDOW, -1)
        repeat = np.bincount(found.row[np.cumsum(edge[:-1]) > 0], minlength=len(texts))
    out = {
        "n_words": found.sizes,
        "word_chars": [len(t) - sum(map(t.count, " \t\n\v\f\r")) for t in texts],
        "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
        "n_dup_lines": list(map(_dup_lines, texts)),
        "n_repeat_words": repeat,
    }
    return pd.DataFrame(out), found


def _failed(base: pd.DataFrame) -> np.ndarray:
    return ((base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PCT * base["n_words"])).to_numpy()


@cache
def _upper() -> np.ndarray:
    """Whether each code point is an upper-case letter."""
    return np.fromiter((chr(i).isupper() for i in range(0x110000)), bool, 0x110000)


def _reference(text: str, n_words: int, n_symbols: int) -> bool:
    """Few symbols and mostly lower case."""
    if 10 * n_symbols > n_words or 4 * (text.count("!") + text.count("?")) > n_words:
        return False
    if text.isascii():
        octets = np.frombuffer(text.encode(), np.uint8)
        upper = int(np.count_nonzero(octets - np.uint8(65) < 26))
    else:
        upper = int(np.count_nonzero(_upper()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]))
    return 10 * upper <= 3 * len(text)


def _langs(pdf: pd.DataFrame) -> list[str]:
    return [x if isinstance(x, str) else NO_LANG for x in pdf["lang"]]


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FIRST = "k1 long, k2 long, doc_id string, lang string, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, reference boolean, g long, c long"


def _first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of documents (g is null) with their base counts, and rows (lang, g, c) of reference documents' 5-grams."""
    counts: dict[str, Counter] = {}

    def grams() -> Iterator[pd.DataFrame]:
        for lang, c in counts.items():
            gram, owner = word_windows(list(c))
            weight = np.fromiter(c.values(), np.int64, len(c))[owner]
            g, inv = np.unique(gram, return_inverse=True)
            empty = dict.fromkeys([x.split()[0] for x in FIRST.split(", ")])
            yield pd.DataFrame(empty | {"lang": lang, "g": g.astype(np.int64), "c": np.bincount(inv, weights=weight).astype(np.int64)})
        counts.clear()

    for pdf in slabs(batches):
        texts, langs = pdf["text"].tolist(), np.array(_langs(pdf), object)
        base, found = base_counts(texts)
        bad = _failed(base)
        ref = np.array([not b and _reference(t, n, m) for t, b, n, m in zip(texts, bad, base["n_words"], base["n_symbols"], strict=True)], bool)
        for lang in set(langs[ref]):
            times = np.bincount(found.ids[(ref & (langs == lang))[found.row]], minlength=len(found.kinds))
            some = np.flatnonzero(times)
            counts.setdefault(lang, Counter()).update(dict(zip(map(found.kinds.__getitem__, some), times[some].tolist(), strict=True)))
        yield base.assign(k1=pdf["k1"], k2=pdf["k2"], doc_id=pdf["doc_id"], lang=langs, base_failed=bad, reference=ref, g=None, c=None)[[x.split()[0] for x in FIRST.split(", ")]]
        if sum(map(len, counts.values())) > WORDS_HELD:
            yield from grams()
    if counts:
        yield from grams()


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more; 0.5, 0.75 and 1 where counts of counts are missing."""
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * (n4 or 0) / n3)
    return tuple(min(max(d, 0.1 * k), 0.95 * k) for k, d in zip((1, 2, 3), raw, strict=True))


@cache
def _salt(lang: str, n: int) -> np.ndarray:
    import xxhash

    return mix64(np.array([xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")) ^ (n << 32)], np.uint64))


def gram_hash(lang: str, n: int, g: np.ndarray) -> np.ndarray:
    return mix64(mix64(g.astype(np.uint64)) ^ _salt(lang, n))


def slice_of(pair: np.ndarray, slices: int) -> np.ndarray:
    """The slice of n-grams by the two symbols before the last."""
    return (mix64(pair.astype(np.uint64) + np.uint64(1)) % np.uint64(slices)).astype(np.int64)


class HashModel:
    """A slice: for each order, sorted hashes of n-grams with their shares, and of contexts with backoff weights."""

    def __init__(self, parts: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]], number: int = 0, slices: int = 1):
        self.parts, self.number, self.slices = parts, number, slices

    def _find(self, n: int, context: bool, want: np.ndarray, default: float) -> np.ndarray:
        keys, vals = self.parts[n, context]
        if not len(keys):
            return np.full(len(want), default)
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[at] == want, vals[at], default)

    def probability(self, lang: str, gram: np.ndarray) -> np.ndarray:
        """Of the last symbol of each 5-gram after the others, in one language's model."""
        p = np.full(len(gram), 1.0 / (1 << BITS))
        for n in range(1, ORDER + 1):
            g = gram & np.uint64((1 << (BITS * n)) - 1)
            p = self._find(n, False, gram_hash(lang, n, g), 0.0) + self._find(n, True, gram_hash(lang, n, g >> np.uint64(BITS)), 1.0) * p
        return p

    def log10p(self, lang: str, gram: np.ndarray) -> np.ndarray:
        return np.log10((1 - POOLED) * self.probability(lang, gram) + POOLED * self.probability(ALL, gram))

    def own(self, gram: np.ndarray) -> np.ndarray:
        """Which 5-grams this slice scores."""
        return slice_of(gram >> np.uint64(BITS) & np.uint64((1 << 2 * BITS) - 1), self.slices) == self.number


def _few(languages: DataFrame) -> DataFrame:
    """A table with a row a language: broadcast if it has at most MANY_LANGS; beyond that the join is the optimizer's."""
    return F.broadcast(languages) if languages.count() <= MANY_LANGS else languages


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """n, context, key, pair (-1 for what every slice needs), v."""
    for pdf in batches:
        for (lang, n, context), part in pdf.groupby(["lang", "n", "context"], sort=False):
            n, context = int(n), bool(context)
            g = part["g"].to_numpy(np.int64).view(np.uint64)
            length = n - context
            pair = (g if context else g >> np.uint64(BITS)) & np.uint64((1 << 2 * BITS) - 1)
            yield pd.DataFrame({"n": n, "context": context, "key": gram_hash(lang, n, g).view(np.int64), "pair": pair.astype(np.int64) if length >= 2 + (not context) else -1, "v": part["v"]})


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    key = pdf["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    return pd.DataFrame({**{c: pdf[c].iloc[:1] for c in ("n", "context", "range")}, "key": [key[order].tobytes()], "v": [pdf["v"].to_numpy(np.float32)[order].tobytes()]})


class Model:
    """Stored rows (n, context, key, pair, v) and the number of slices."""

    def __init__(self, rows: DataFrame, slices: int):
        self.rows, self.slices = rows, slices

    def slice(self, number: int) -> HashModel:
        """Bounded: about SLICE_ROWS rows, and the orders one and two; tasks sort the arrays, which come as bytes."""
        here = self.rows.where((F.col("pair") < 0) | (F.col("slice") == number)).select("n", "context", "key", "v")
        # 16 ranges of the hashes a kind, which follow each other in the arrays
        ranges = here.withColumn("range", F.shiftrightunsigned("key", 60).cast("int"))
        got = ranges.groupBy("n", "context", "range").applyInPandas(_sorted, "n int, context boolean, range int, key binary, v binary").collect()
        got = sorted(got, key=lambda r: r["range"])
        parts = {}
        for n in range(1, ORDER + 1):
            for context in (False, True):
                own = [r for r in got if (r["n"], r["context"]) == (n, context)]
                parts[n, context] = np.frombuffer(b"".join(r["key"] for r in own), np.uint64), np.frombuffer(b"".join(r["v"] for r in own), np.float32)
        return HashModel(parts, number, self.slices)


def train(first: DataFrame) -> Model:
    """The model of the 5-grams (lang, g, c) in first, other rows having a null g."""
    ship(first.sparkSession)
    five = first.where("g is not null").groupBy("lang", "g").agg(F.sum("c").alias("c"))
    own = stored(five, "kn-5")
    level = own.unionByName(own.groupBy("g").agg(F.sum("c").alias("c")).withColumn("lang", F.lit(ALL)))
    rules = F.udf(lambda *n: list(discounts(*n)), "array<double>")
    parts, used = [], [own]
    for n in range(ORDER, 0, -1):
        if n < ORDER:
            # the first symbol of the shorter n-gram tells whether it is at a word's start
            short = F.col("g").bitwiseAND(F.lit((1 << (BITS * n)) - 1))
            starts = F.shiftright("g", BITS * (n - 1)).bitwiseAND(F.lit(MASK)) == START
            level = level.select("lang", short.alias("g"), F.when(starts, F.col("c")).otherwise(F.lit(1)).alias("c")).groupBy("lang", "g").agg(F.sum("c").alias("c"))
            level = stored(level, f"kn-{n}")
            used.append(level)
        stat = level.groupBy("lang").agg(*[F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)])
        stat = stored(stat.select("lang", rules("n1", "n2", "n3", "n4").alias("d")), f"kn-rules-{n}")
        used.append(stat)
        rows = level.join(_few(stat), "lang").select("lang", "g", "c", F.element_at("d", F.least("c", F.lit(3)).cast("int")).alias("cut"), F.shiftright("g", BITS).alias("h"))
        # at most 4096 symbols follow a context
        after = Window.partitionBy("lang", "h")
        share = rows.select("lang", "h", "g", ((F.col("c") - F.col("cut")) / F.sum("c").over(after)).alias("v"), F.sum("cut").over(after).alias("s"), F.sum("c").over(after).alias("t"), F.row_number().over(after.orderBy("g")).alias("k"))
        share = share.select("lang", F.explode(F.when(F.col("k") == 1, F.array(F.struct(F.lit(False).alias("context"), F.col("g"), F.col("v")), F.struct(F.lit(True).alias("context"), F.col("h").alias("g"), (F.col("s") / F.col("t")).alias("v")))).otherwise(F.array(F.struct(F.lit(False).alias("context"), F.col("g"), F.col("v"))))).alias("x"))
        parts.append(share.select("lang", F.lit(n).alias("n"), "x.context", "x.g", "x.v"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = stored(rows.mapInPandas(_keys, "n int, context boolean, key long, pair long, v float"), "kn-model")
    forget(*used)
    slices = max(1, -(-rows.where("pair >= 0").count() // SLICE_ROWS))
    number = F.pandas_udf(lambda pair: pd.Series(slice_of(pair.to_numpy(), slices)), "long")
    return Model(rows.withColumn("slice", number("pair") if slices > 1 else F.lit(0)), slices)


class Scores:
    """Sums over the symbols of words that a slice scores, kept for the words that a worker has seen."""

    def __init__(self, model: HashModel):
        self.model, self.known = model, {}

    def of(self, lang: str, kinds: list[bytes]) -> np.ndarray:
        """A row a word: log10 probabilities and their squares, added up, and symbols."""
        place, table = self.known.get(lang, ({}, np.zeros((0, 3))))
        if len(place) > WORDS_HELD:
            place, table = {}, np.zeros((0, 3))
        new = [w for w in kinds if w not in place]
        if new:
            gram, owner = word_windows(new)
            mine = self.model.own(gram) if self.model.slices > 1 else slice(None)
            g, inv = np.unique(gram[mine], return_inverse=True)
            x, owner = self.model.log10p(lang, g)[inv], owner[mine]
            table = np.concatenate([table, np.stack([np.bincount(owner, weights=w, minlength=len(new)) for w in (x, x * x, np.ones(len(x)))], 1)])
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
        self.known = {k: v for k, v in self.known.items() if k != lang} | {lang: (place, table)}
        while len(self.known) > 1 and sum(len(p) for p, _ in self.known.values()) > 3 * WORDS_HELD:
            self.known.pop(next(iter(self.known)))
        return table[np.fromiter(map(place.__getitem__, kinds), np.int64, len(kinds))]


def _sums(held):
    """k1, k2, x, xx, n: sums over the symbols that a slice scores."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = Scores(held.value)
        for pdf in slabs(batches):
            found, langs = Words(pdf["text"].tolist()), np.array(_langs(pdf), object)
            out = np.zeros((len(pdf), 3))
            for lang in set(langs):
                here = (langs == lang)[found.row]
                ids, row = found.ids[here], found.row[here]
                kinds, inv = np.unique(ids, return_inverse=True)
                if len(kinds):
                    got = scores.of(lang, [found.kinds[k] for k in kinds])[inv]
                    out += np.stack([np.bincount(row, weights=got[:, j], minlength=len(pdf)) for j in range(3)], 1)
            yield pd.DataFrame({"k1": pdf["k1"], "k2": pdf["k2"], "x": out[:, 0], "xx": out[:, 1], "n": out[:, 2].astype(np.int64)})

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """k1, k2 (hashes of the row), log_ppl (minus the mean log10 probability of a symbol), sd (of a symbol) and symbols of all documents with words."""
    spark = docs.sparkSession
    parts = None
    for number in range(model.slices):
        held = spark.sparkContext.broadcast(model.slice(number))
        got = stored(docs.select("k1", "k2", "lang", "text").mapInPandas(_sums(held), "k1 long, k2 long, x double, xx double, n long"), f"kn-sums-{number}")
        held.destroy()
        got = got.groupBy("k1", "k2").agg(*[F.first(c).alias(c) for c in ("x", "xx", "n")])  # equal rows have equal sums
        parts = got if parts is None else parts.unionByName(got)
    if model.slices > 1:
        parts = parts.groupBy("k1", "k2").agg(*[F.sum(c).alias(c) for c in ("x", "xx", "n")])
    mean = F.col("x") / F.col("n")
    return parts.where("n > 0").select("k1", "k2", (-mean).alias("log_ppl"), F.sqrt(F.greatest(F.col("xx") / F.col("n") - mean * mean, F.lit(0.0))).alias("sd"), F.col("n").alias("symbols"))


def bands(scored: DataFrame, width: float = BAND, within: float = WITHIN) -> DataFrame:
    """A row a language: centre, spread between documents, spread of symbols, of the reference documents."""
    ref = scored.where("reference")
    quart = F.percentile_approx("log_ppl", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000)
    per = ref.groupBy("lang").agg(quart.alias("q"), F.avg("sd").alias("w"))
    return per.select("lang", F.col("q")[1].alias("centre"), (F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, F.lit(0.002)) * width).alias("between"), (F.col("w") * within).alias("within"))


def quality(docs: DataFrame, width: float = BAND) -> DataFrame:
    """The base counts and verdict of every document, with log_ppl, lower and upper (the band it is held to)."""
    ship(docs.sparkSession)
    row = ("doc_id", "text", "lang")
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", F.xxhash64(*row).alias("k1"), F.xxhash64(F.lit(7), *row).alias("k2"))
    first = stored(docs.mapInPandas(_first, FIRST), "kn-first")
    base = first.where("g is null").drop("g", "c")
    scored = stored(base.join(score(docs, train(first)), ["k1", "k2"], "left"), "kn-scored")
    forget(first)
    band = F.sqrt(F.pow("between", F.lit(2)) + F.pow("within", F.lit(2)) / F.greatest("symbols", F.lit(1)))
    out = scored.join(_few(stored(bands(scored, width), "kn-bands")), "lang", "left").withColumns({"lower": F.col("centre") - band, "upper": F.col("centre") + band})
    inside = F.coalesce(F.col("log_ppl").between(F.col("lower"), F.col("upper")), F.lit(True))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.nullif("lang", F.lit(NO_LANG)).alias("lang"), *BASE, "base_failed", "log_ppl", "lower", "upper", (~F.col("base_failed") & inside).alias("kept"))
