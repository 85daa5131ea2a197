"""Scoring texts with a weighted backoff automaton of word n-grams that grows with the training texts.

Every word and every n-gram of the training texts up to ORDER words counts, from one occurrence on; no table is cut and none is
broadcast. A state is an n-gram that the next word can follow; its arcs carry log10 P(word | state), its failure arc, to the state without the first word,
log10 of the share that goes there. P is interpolated: (1 - share) * c(state, word) / c(state) + share * P(word | shorter state), so the words after a state sum
to one. The share of a state with c occurrences is SHARE_OF_ONE * c ^ -g. The exponent g of each order is solved such that all states give away
as much as the training texts' n-grams that occur once, the Good-Turing estimate of what is new. Words that no training text has
are one unknown word, with the mass of the words that occur once. A text begins in the state of the end token.

Texts are taken in batches of about BATCH_CHARS characters. A batch asks once for each of its n-grams, by hash and sorted, so that only differences are
written. One shuffle by hash ranges sums the counts of all batches; the answers go back to the batch in the same order. So a task holds the part of the
automaton that its batch needs, or one hash range (about RANGE_KEYS keys). The batch's texts then run through the automaton from left to right, in lockstep.

Hashes of words have 64 bits; those of longer n-grams KEY_BITS, which at 10^10 different n-grams give one of them the count of another with a probability of 4e-5.

Input cases: a null text is empty, whose only token is the end; equal rows get equal scores, each from its own row; null ids stay null and
are learnt from if held_out is null or false for them; with no training text every word is unknown with probability one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import crc_mod, mix64, packed, ship, slabs, stored, unpacked, word_bytes

ORDER = 3
BATCH_CHARS = 12_000_000
RANGE_KEYS = 3_000_000
KEY_BITS = 48
SHARE_OF_ONE = 0.95
#: The token that ends each text; no word holds a space.
END = b" end"
NONE = -1
#: Counts meet in bins of a sixteenth of an octave when the exponents are solved.
BINS = 16


def tokens_of(text: str) -> list[bytes]:
    return [*word_bytes(text), END]


def encode(docs: DataFrame, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """A row a batch: b, doc_ids, held (a byte a text), sizes, ids (of each token, numbers in the batch; the end is 0), high and low (the words' hashes), n (tokens)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        number = count(TaskContext.get().partitionId() << 32)
        for pdf in slabs(batches, batch_chars):
            table: dict[bytes, int] = defaultdict(count().__next__)
            table[END]  # noqa: B018
            ids = [np.fromiter(map(table.__getitem__, tokens_of(t)), np.uint32) for t in pdf["text"]]
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, table), np.uint64, len(table))
            held = bytes(isinstance(x, (bool, np.bool_)) and bool(x) for x in pdf["held_out"])
            asked = [None if x is None else bool(x) for x in pdf["held_out"]]
            yield pd.DataFrame(
                [(next(number), list(pdf["doc_id"]), held, asked, packed(np.array([len(x) for x in ids])), packed(np.concatenate(ids)), packed(h >> np.uint64(16)), packed(h & np.uint64(0xFFFF)), sum(map(len, ids)))],
                columns=["b", "doc_ids", "held", "asked", "sizes", "ids", "high", "low", "n"],
            )

    # ids as strings, since pandas has no whole numbers beside nulls
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "held_out", "text")
    return stored(rows.mapInPandas(run, "b long, doc_ids array<string>, held binary, asked array<boolean>, sizes binary, ids binary, high binary, low binary, n long"), "lm-ids")


def before(at: np.ndarray, start: np.ndarray, first: int) -> np.ndarray:
    """The value of the token before each, first at a text's start."""
    out = np.concatenate([[first], at[:-1]])
    out[start] = first
    return out


def ngrams(ids: np.ndarray, sizes: np.ndarray, high: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the hashes of the batch's n-grams, sorted, and the place among them of the one that ends at each token."""
    start = np.cumsum(sizes) - sizes
    rank = np.argsort(high, kind="stable")
    place = np.empty(len(high), np.int64)
    place[rank] = np.arange(len(high))
    yield high[rank], place[ids]
    own = mix64(high + np.uint64(1))[ids]
    h = high[ids].astype(np.uint64)
    for k in range(2, order + 1):
        shifted = np.concatenate([h[:1], h[:-1]])
        shifted[start] = high[0]  # the end token
        h = mix64(shifted * np.uint64(0x9E3779B97F4A7C15) + own)
        ok = np.ones(len(ids), bool)
        if k > 2:
            # a state does not reach back before its text
            for back in range(k - 2):
                short = start[sizes > back] + back
                ok[short] = False
        at = np.full(len(ids), NONE, np.int64)
        keys, at[ok] = np.unique(h[ok] >> np.uint64(64 - KEY_BITS), return_inverse=True)
        yield keys, at


def ranges(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """The hash range of each key."""
    return (keys >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)


def _ask(order: int, parts: int):
    """Rows (b, p, n, keys, m): a batch's n-grams of order n in hash range p, and how often its training texts have them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                ids, sizes, high, low = (unpacked(x) for x in (r.ids, r.sizes, r.high, r.low))
                ids, sizes = ids.astype(np.int64), sizes.astype(np.int64)
                learn = np.repeat(np.frombuffer(r.held, np.uint8) == 0, sizes)
                for n, (keys, at) in enumerate(ngrams(ids, sizes, high, order), 1):
                    m = np.bincount(at[learn & (at >= 0)], minlength=len(keys))
                    p = ranges(keys, KEY_BITS, parts)
                    if n == 1:
                        rank = np.argsort(high, kind="stable")
                        keys = (high[rank] << np.uint64(16)) | low[rank]
                    if not len(p):
                        continue
                    cut = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
                    ends = [*cut[1:], len(p)]
                    yield pd.DataFrame([(r.b, int(p[i]), n, packed(np.diff(keys[i:j], prepend=np.uint64(0))), packed(m[i:j])) for i, j in zip(cut, ends, strict=True)], columns=["b", "p", "n", "keys", "m"])

    return run


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """The counts of one hash range, for each batch in the order of its keys; and rows (n, bin, kinds, total) of how many n-grams have which counts."""
    out = []
    for n, part in pdf.groupby("n"):
        keys = [np.cumsum(unpacked(x)) for x in part["keys"]]
        seen, inv = np.unique(np.concatenate(keys), return_inverse=True)
        c = np.bincount(inv, weights=np.concatenate([unpacked(x) for x in part["m"]]), minlength=len(seen)).astype(np.int64)
        answers = np.split(c[inv], np.cumsum([len(k) for k in keys])[:-1])
        out.append(pd.DataFrame({"b": part["b"].to_numpy(), "p": part["p"].to_numpy(), "n": n, "c": [packed(a) for a in answers], "bin": 0, "kinds": 0, "total": 0}))
        some = c[c > 0]
        if len(some):
            # a first occurrence is bin 0, alone
            bins, where = np.unique(np.floor(np.log2(some) * BINS).astype(int), return_inverse=True)
            out.append(pd.DataFrame({"b": NONE, "p": 0, "n": n, "c": None, "bin": bins, "kinds": np.bincount(where), "total": np.bincount(where, weights=some).astype(np.int64)}))
    return pd.concat(out)


def answers(coded: DataFrame, order: int) -> tuple[DataFrame, list[pd.DataFrame]]:
    """(b, p, n, c) of what the batches ask for, and for each order the table of (bin, kinds, total)."""
    tokens = coded.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-tokens * order // RANGE_KEYS))
    asked = coded.mapInPandas(_ask(order, parts), "b long, p long, n int, keys binary, m binary")
    got = stored(asked.groupBy("p").applyInPandas(_count, "b long, p long, n int, c binary, bin int, kinds long, total long"), "lm-counts")
    # at most 64 * BINS rows an order
    stat = got.where(F.col("b") == NONE).groupBy("n", "bin").agg(F.sum("kinds").alias("kinds"), F.sum("total").alias("total")).toPandas().sort_values("bin")
    return got.where(F.col("b") != NONE).select("b", "p", "n", "c"), [stat[stat["n"] == n] for n in range(1, order + 1)]


def once(stat: pd.DataFrame) -> int:
    """How many n-grams occur once."""
    return int(stat.loc[stat["bin"] == 0, "kinds"].sum())


def exponent(states: pd.DataFrame, new: float) -> float:
    """g such that the shares of all states, each weighing its occurrences, add up to new."""
    total = states["total"].to_numpy(float)
    c = total / np.maximum(states["kinds"].to_numpy(float), 1)
    lo, hi = 0.0, 8.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (total * SHARE_OF_ONE * c**-mid).sum() > new else (lo, mid)
    return lo


class Automaton:
    """The arcs that a batch can take. Of each order: counts of its n-grams, the place of the one at each token and of the state before it."""

    def __init__(self, tokens: int, unknown: float, exponents: list[float]):
        self.tokens, self.unknown, self.exponents = tokens, unknown, exponents

    def share(self, c: np.ndarray, order: int) -> np.ndarray:
        """What a state with c occurrences gives to its failure arc; all of it if it doesn't exist."""
        return np.where(c > 0, np.maximum(SHARE_OF_ONE * np.maximum(c, 1) ** -self.exponents[order - 2], 1e-12), 1.0)

    def traverse(self, counts: list[np.ndarray], at: list[np.ndarray], start: np.ndarray, end: int) -> np.ndarray:
        """log10 probability of each token: that of its arc, or of the failure arc and then the shorter state's.

        counts: of each order's n-grams; at: the place of the n-gram that ends at each token, NONE if that reaches back before its text; end: the
        place of the end token, at which texts begin.
        """
        c = counts[0]
        value = np.log10(np.where(c > 0, (1 - self.unknown) * np.maximum(c, 1) / max(self.tokens, 1), self.unknown))[at[0]]
        for k in range(2, len(counts) + 1):
            c, have = counts[k - 1], counts[k - 2]
            state = before(at[k - 2], start, end if k == 2 else NONE)
            ok = np.flatnonzero((at[k - 1] >= 0) & (state >= 0))
            here, state = at[k - 1][ok], state[ok]
            # a token that shows each n-gram, and with it the shorter state's probability
            shown = np.zeros(len(c), np.int64)
            shown[here] = np.arange(len(ok))
            times, share = have[state][shown], self.share(have, k)
            arc = np.log10((1 - share[state][shown]) * c / np.maximum(times, 1) + share[state][shown] * 10.0 ** value[ok][shown]) if len(ok) else value[:0]
            value[ok] = np.where(c[here] > 0, arc[here], np.log10(share)[state] + value[ok])
        return value


def score_documents(docs: DataFrame, held_out, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; learnt from those that held_out isn't true for."""
    ship(docs.sparkSession)
    coded = encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out")))
    rows, stat = answers(coded, order)
    tokens, kinds = int(stat[0]["total"].sum()), int(stat[0]["kinds"].sum())
    unknown = (once(stat[0]) + 1) / (tokens + 2) if tokens else 1.0
    auto = Automaton(tokens, unknown, [exponent(a, once(b)) for a, b in zip(stat, stat[1:], strict=False)])
    per = math.log10(tokens + kinds + 1)

    def run(pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        out = []
        for r in pdf.itertuples():
            ids, sizes, high = unpacked(r.ids).astype(np.int64), unpacked(r.sizes).astype(np.int64), unpacked(r.high)
            start = np.cumsum(sizes) - sizes
            at = [a for _, a in ngrams(ids, sizes, high, order)]
            counts = []
            for n in range(1, order + 1):
                own = got[got["n"] == n].sort_values("p")
                counts.append(np.concatenate([unpacked(x) for x in own["c"]]).astype(np.float64) if len(own) else np.zeros(0))
            end = int(at[0][start[0] + sizes[0] - 1])
            value = auto.traverse(counts, at, start, end)
            c = counts[0][at[0]]
            total = [np.add.reduceat(x, start) for x in ((c > 0).astype(np.int64), np.log10(c + 1) - per, value)]
            out.append(pd.DataFrame(dict(zip(names, [list(r.doc_ids), list(r.asked), sizes, *total], strict=True))))
        return pd.concat(out) if out else pd.DataFrame(columns=names)

    # twice as many partitions as batches, so that few of them meet in one task
    parts = 2 * max(1, coded.count())
    both = coded.drop("low", "n").repartition(parts, "b").groupBy("b").cogroup(rows.repartition(parts, "b").groupBy("b"))
    out = both.applyInPandas(run, "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def by_remainder(m: int = 7, r: int = 2):
    """The rows whose id's crc32 leaves remainder r; a null id leaves none."""
    return F.coalesce(crc_mod(F.col("doc_id"), m) == r, F.lit(False))
