"""Toxic passages by maximum-scoring segment search.

Words, and prefixes of four to six letters of words, get log-odds of toxic against clean labelled documents with an
informative Dirichlet prior (the pooled rate, weighing 5 % of the documents). Positive log-odds count only if the excess
in toxic documents would be expected to arise by chance at most once among all features; negative ones count as they are. Every word
without positive log-odds costs a constant besides, as in a passage with one toxic word in ten. One scan over a text's scores then finds all maximal scoring segments
in linear time. A segment's significance is that of the extreme-value law of local maxima: E = K n exp(-lambda S). K and lambda are fitted by maximum likelihood to
the best segments of the clean labelled documents (those without a segment count as below any score), with the lambda that solves sum p exp(lambda s) = 1 over clean words
as a prior that weighs PRIOR_FITS documents. A logistic curve over the best normalised segment, the number of
significant ones and of all turns this into a score from 0 to 1.

Labels are learnt from a bounded sample: of each label at most SAMPLE rows, those whose id hashes lowest, near copies
among them once. A row with a null label or null id is not learnt from; of several labels of one
id the highest counts.

Input cases: null and empty texts have no segment and get the lowest score; equal rows get equal scores; where nothing can be learnt
(no labels, one label only) every score is the prior rate, 0.5 without labels; null ids are scored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import chunks, lean, mix64, ship, texts_of, words

SAMPLE = 10_000
PRIOR = 0.05
NEUTRAL = math.log(0.9)
PRIOR_FITS = 20
ALPHA = 0.05
PREDICT = 0.7
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
PREFIXES = (6, 5, 4)


def tokens(text: str) -> list[str]:
    return words(text.lower())


def bare(word: str) -> str:
    """The word without the marks around it."""
    return word if word.isalnum() else EDGE.sub("", word)


def features(word: str) -> list[str]:
    """The word, then its prefixes from long to short, marked by a hyphen after them."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) > n)]


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last) of a text's scores.

    Linear: a segment on the stack is merged or passed over once; links skip what can't be merged.
    """
    left, right, first, last, link = [], [], [], [], []
    total = 0.0
    for i, s in enumerate(scores):
        lo, total = total, total + s
        if s <= 0:
            continue
        hi, begin = total, i
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= lo:
                j = link[j]
            if j < 0 or right[j] >= hi:
                break
            lo, begin = left[j], first[j]
            for x in (left, right, first, last, link):
                del x[j:]
        left.append(lo)
        right.append(hi)
        first.append(begin)
        last.append(i)
        link.append(j)
    return [(b - a, i, j) for a, b, i, j in zip(left, right, first, last, strict=True)]


def all_segments_plain(scores: list[float]) -> list[tuple[float, int, int]]:
    """For tests: the best segment (the shortest of equal ones), then the same left and right of it."""

    def cut(a: int, b: int) -> list[tuple[float, int, int]]:
        best = None
        for i in range(a, b):
            s = 0.0
            for j in range(i, b):
                s += scores[j]
                if s > 0 and (best is None or s > best[0] + 1e-12 or (abs(s - best[0]) < 1e-12 and j - i < best[2] - best[1])):
                    best = s, i, j
        return [] if best is None else [*cut(a, best[1]), best, *cut(best[2] + 1, b)]

    return cut(0, len(scores))


class Known(dict):
    """Scores of the words that a worker has seen."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        got = 0.0
        if b := bare(word):
            got = next((self.weights[f] for f in features(b) if f in self.weights), 0.0)
        self[word] = got = got if got > 0 else got + NEUTRAL
        return got


class ToxicModel:
    """weights: log-odds by feature; lam, k: of the extreme-value law; coef: logistic weights, None if nothing could be learnt."""

    def __init__(self, weights: dict[str, float], lam: float, k: float, coef: list[float] | None, rate: float):
        self.weights, self.lam, self.k, self.coef, self.rate = weights, lam, k, coef, rate
        self.known = Known(weights)

    def parts(self) -> tuple:
        return self.weights, self.lam, self.k, self.coef, self.rate

    def scan(self, text: str) -> tuple[list[tuple[float, int, int]], int]:
        """The segments of a text, and the number of words."""
        found = tokens(text)
        if len(self.known) > 400_000:
            self.known.clear()
        scores = list(map(self.known.__getitem__, found))
        return (segments(scores) if scores and max(scores) > 0 else []), len(found)

    def passages(self, got: list[tuple[float, int, int]], n: int) -> list[tuple[float, float, int, int]]:
        """(normalised score, E, first word, last word) of segments of a text of n words."""
        norm = math.log(self.k * max(n, 10))
        return [(self.lam * s - norm, math.exp(min(50.0, norm - self.lam * s)), i, j) for s, i, j in got]

    def measures(self, got: list[tuple[float, float, int, int]]) -> list[float]:
        best = max((x[0] for x in got), default=-6.0)
        return [1.0, min(max(best, -6.0), 12.0), math.log1p(sum(significant(e) for _, e, _, _ in got)), math.log1p(len(got))]

    def score(self, got: list[tuple[float, float, int, int]]) -> float:
        """Of a text's passages."""
        if self.coef is None:
            return self.rate
        z = float(np.dot(self.coef, self.measures(got)))
        return 1 / (1 + math.exp(-min(max(z, -30), 30)))

    def score_text(self, text: str) -> float:
        return self.score(self.passages(*self.scan(text)))


def significant(e: float) -> bool:
    return -math.expm1(-e) <= ALPHA


def fit_extremes(best: np.ndarray, n: np.ndarray, lam0: float) -> tuple[float, float]:
    """(lambda, K) of maximum likelihood for the best scores of clean texts of n words, 0 for texts without a segment."""
    some = best > 0
    m = int(some.sum())
    n = np.maximum(n, 10).astype(float)

    def k_of(lam: float) -> float:
        return (m + 1) / ((n * np.exp(-lam * best)).sum() + n.mean())

    def value(lam: float) -> float:
        return m * math.log(k_of(lam)) + m * math.log(lam) - lam * best[some].sum() + PRIOR_FITS * (math.log(lam) - lam / lam0)

    lo, hi = math.log(0.02), math.log(20.0)
    for _ in range(80):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (a, hi) if value(math.exp(a)) < value(math.exp(b)) else (lo, b)
    lam = math.exp((lo + hi) / 2)
    return lam, k_of(lam)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of n draws."""
    if k <= n * p:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, min(n, k + 400) + 1)]
    top = max(logs)
    return math.exp(top) * sum(math.exp(x - top) for x in logs)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> list[float]:
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - y) + ridge * b
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return b.tolist()


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        h1, h2 = [], []
        for i, t in zip(pdf["doc_id"], texts_of(pdf), strict=True):
            w = tokens(t)
            h = np.array([hash_word(" ".join(w[k : k + 5])) for k in range(max(1, len(w) - 4))] if w else [i & (2**63 - 1)], np.uint64)
            h1.append(mix64(h).min().astype(np.int64))
            h2.append(mix64(h ^ np.uint64(0x5DEECE66D)).min().astype(np.int64))
        yield pdf.assign(h1=h1, h2=h2)


def hash_word(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def _doc_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each label with each feature, summed over a batch."""
    for pdf in batches:
        by = {0: Counter(), 1: Counter()}
        for y, t in zip(pdf["toxic"], texts_of(pdf), strict=True):
            by[int(y)].update({f for w in {bare(x) for x in tokens(t)} if w for f in features(w)})
        keys = list(by[0].keys() | by[1].keys())
        yield pd.DataFrame({"f": keys, "t": [by[1][k] for k in keys], "c": [by[0][k] for k in keys]}).astype({"f": "object", "t": "int64", "c": "int64"})


def sample_of(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic of the bounded sample: of each label the rows whose id hashes lowest, near copies once."""
    one = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = None
    for y in (0, 1):
        part = one.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
        pick = part if pick is None else pick.unionByName(part)
    got = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id")  # at most 2 * size rows
    rows = got.mapInPandas(lean(_sketch), "doc_id long, text string, toxic int, h1 long, h2 long")
    for h in ("h1", "h2"):
        rows = rows.groupBy(h).agg(F.min_by(F.struct(*[c for c in ("doc_id", "text", "toxic", "h1", "h2") if c != h]), "doc_id").alias("r")).select(h, "r.*")
    return rows.select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> ToxicModel:
    """docs: doc_id, text; labels: doc_id, toxic. Only rows that may be learnt from."""
    from sluice.llm.common import stored

    ship(docs.sparkSession)
    sample = stored(sample_of(docs, labels, size), "toxic-sample")
    seen = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_t, n_c = seen.get(1, 0), seen.get(0, 0)
    rate = n_t / (n_t + n_c) if n_t + n_c else 0.5
    if not n_t or not n_c:
        return ToxicModel({}, 1.0, 0.1, None, rate)
    counts = sample.repartition(24, "doc_id").mapInPandas(lean(_doc_counts), "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    # bounded by the sample's words
    got = counts.where((F.col("t") + F.col("c") >= 3) & (~F.col("f").endswith("-") | (F.col("t") * n_c > 3 * F.col("c") * n_t))).toPandas()
    n_features = max(1, len(got))
    a0 = PRIOR * (n_t + n_c)
    weights, occurs = {}, []
    for f, t, c in got.itertuples(index=False):
        a = a0 * (t + c) / (n_t + n_c)
        odds = math.log((t + a) / max(n_t + a0 - t - a, 1e-9)) - math.log((c + a) / max(n_c + a0 - c - a, 1e-9))
        chance = t < 3 or t * n_c <= 3 * c * n_t or binomial_tail(int(t), int(t + c), rate) * n_features > 1
        if odds <= 0 and not f.endswith("-") or odds > 0 and not chance:
            weights[f] = odds
        if not f.endswith("-"):
            w = weights.get(f, 0.0)
            occurs.append((w if w > 0 else w + NEUTRAL, c + a * n_c / (n_t + n_c)))
    # lambda of the theory: clean words' scores by how many clean documents have them
    s, p = np.array(occurs).T if occurs else (np.array([NEUTRAL]), np.array([1.0]))
    p = p / p.sum()
    lo, hi = 1e-3, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (p * np.exp(np.minimum(mid * s, 600.0))).sum() > 1 else (mid, hi)
    model = ToxicModel(weights, min(lo, 3.0), 0.1, None, rate)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [model.scan(t) for t in texts_of(pdf)]
            yield pd.DataFrame({"toxic": pdf["toxic"], "n": [n for _, n in found], "s": [[float(x[0]) for x in got] for got, _ in found]})

    fit = sample.mapInPandas(lean(run), "toxic int, n long, s array<double>").toPandas()  # at most 2 * size rows
    y = fit["toxic"].to_numpy(float)
    best = np.array([max(x, default=0.0) for x in fit["s"]])
    model.lam, model.k = fit_extremes(best[y == 0], fit["n"].to_numpy()[y == 0], model.lam)
    x = np.array([model.measures(model.passages([(v, 0, 0) for v in own], n)) for own, n in zip(fit["s"], fit["n"], strict=True)])
    model.coef = fit_logistic(x, y)
    return model


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """docs (doc_id, text) with score, predicted, n_passages (significant) and passages (first and last word, normalised score)."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model.parts())
    token = held._jbroadcast.id()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _model(token, held.value)
        for pdf in batches:
            texts = texts_of(pdf)
            for at in chunks(texts):
                scores, spans = [], []
                for t in texts[at]:
                    found = own.passages(*own.scan(t))
                    scores.append(own.score(found))
                    spans.append([{"first_word": i, "last_word": j, "bits": s / math.log(2)} for s, e, i, j in found if significant(e)])
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[at], "score": scores, "passages": spans})

    schema = "doc_id long, score double, passages array<struct<first_word:int,last_word:int,bits:double>>"
    out = docs.select("doc_id", "text").mapInPandas(lean(run), schema)
    return out.withColumn("predicted", (F.col("score") >= PREDICT).cast("int")).withColumn("n_passages", F.size("passages"))


def score_column(spark, model: ToxicModel, text: str = "text"):
    """The score as a column of the text, for filters that need no join."""
    ship(spark)
    held = spark.sparkContext.broadcast(model.parts())
    token = held._jbroadcast.id()

    def scored(cols: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _model(token, held.value)
        for col in cols:
            yield pd.Series([own.score_text(t if isinstance(t, str) else "") for t in col], dtype=float)

    def run(cols: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return lean(scored)(cols)

    return F.pandas_udf(run, "double")(text)


_MODELS: dict[int, ToxicModel] = {}


def _model(token: int, parts: tuple) -> ToxicModel:
    if token not in _MODELS:
        _MODELS.clear()
        _MODELS[token] = ToxicModel(*parts)
    return _MODELS[token]
