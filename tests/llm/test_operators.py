"""The operators of the subpackage against brute force, round trips, held-out rows and awkward input."""

import functools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.llm import ann, html_text, line_dedup, minhash, mixing, ngram_scoring, packing, quality, queries, token_count, toxicity
from sluice.llm.common import WORD, components, forest, lean, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, g long, id long, uid long, `group` long, shard long, w string, c long, component_id long, kept boolean, weight double"


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), *[1] * 6, "x", 2, 3, True, 0.5) for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeats, ties, clashing columns."""
    rng = random.Random(3)
    vocab = ["w" + str(k) for k in range(60)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    base = text(90)
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, "  \n\t ", "en", None), (4, "one", "en", "a"), (5, base, "en", "a"), (6, base, "en", "b"), (6, base, "en", "b"), (7, base.replace("w1 ", "zz "), "en", "b"), (8, text(30_000), "en", "a"), (9, base + "\n" + base, "de", "b"), (None, base, "en", "a")]
    rows += [(10 + k, text(40) + "\n" + text(25), "en", "a") for k in range(40)]
    return make(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [(1, "x", "en", "a")]).where("doc_id < 0")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


# common

@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=200))
@settings(max_examples=200, deadline=None)
def test_words_equal_the_pattern(text):
    assert words(text) == WORD.findall(text)


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
@settings(max_examples=60, deadline=None)
def test_forest_keeps_components(links):
    a, b = np.array([x for x, _ in links], np.int64), np.array([y for _, y in links], np.int64)
    ids, low = forest(a, b)
    label = {i: i for i in range(31)}
    for _ in range(31):
        for x, y in links:
            label[x] = label[y] = min(label[x], label[y])
    assert {int(i): int(j) for i, j in zip(ids, low, strict=True)} == {i: j for i, j in label.items() if i != j}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys(range(500, 560), 500)}


# 1 quality

def base_by_hand(text: str) -> tuple:
    w = WORD.findall(text)
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_base_counts(documents):
    texts = [r["text"] for r in documents.limit(60).collect()] + ["", "a b", "a b c d e f g h a b c d e f g h", "x\nx\n\n\nx y"]
    got, _ = quality.base_counts(texts)
    for k, t in enumerate(texts):
        assert tuple(got.loc[k, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == base_by_hand(t)


@pytest.fixture(scope="module")
def first(documents):
    docs = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", F.lit(1).cast("long").alias("k1"), F.lit(1).cast("long").alias("k2"))
    return docs.mapInPandas(quality._first, quality.FIRST).cache()


def test_model_sums_to_one(first):
    model = quality.train(first).slice(0)
    rng = np.random.default_rng(1)
    gram, _ = quality.word_windows([b"the", b"on", b"zzz", b"thing"])
    for g in gram[rng.permutation(len(gram))[:6]]:
        context = (g >> np.uint64(12)) << np.uint64(12)
        every = context + np.arange(1 << 12, dtype=np.uint64)
        for lang in ("en", quality.ALL):
            assert model.probability(lang, every).sum() == pytest.approx(1, abs=1e-4)


def plain_kneser_ney(words: Counter):
    """Modified Kneser-Ney over the characters of counted words, by its definition: p(symbols before, symbol)."""
    n, level = quality.ORDER, [Counter()]
    for w, c in words.items():
        full = [1] * (n - 1) + [int(x) for x in quality.symbol_codes(np.array([ord(ch) for ch in w], np.uint64))] + [2]
        for i in range(n - 1, len(full)):
            level[0][tuple(full[i - n + 1 : i + 1])] += c
    for _ in range(n - 1):
        nxt = Counter()
        for g, c in level[-1].items():
            # at a word's start the count stays, elsewhere different left neighbours count
            nxt[g[1:]] += c if g[1] == 1 else 1
        level.append(nxt)
    level.reverse()
    rules = []
    for c in level:
        rules.append(quality.discounts(*[sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]))
    after = [{} for _ in level]
    for k, c in enumerate(level):
        for g, x in c.items():
            d = after[k].setdefault(g[:-1], [0, 0.0])
            d[0] += x
            d[1] += rules[k][min(x, 3) - 1]

    def p(g):
        value = 1 / 4096
        for k in range(n):
            own = g[n - 1 - k :]
            total, cut = after[k].get(own[:-1], (0, 0))
            c = level[k].get(own, 0)
            if total:
                value = (c - rules[k][min(c, 3) - 1] if c else 0) / total + cut / total * value
        return value

    return p


@pytest.mark.parametrize("rows", [10**9, 900])
def test_model_and_sums_equal_the_plain_method(spark, monkeypatch, rows):
    rng = random.Random(6)
    pool = ["".join(rng.choices("abcdé", k=rng.randint(1, 7))) for _ in range(80)]
    texts = [(k, " ".join(rng.choices(pool, k=30)), "x" * 300 + str(k % 2)) for k in range(40)] + [(100, "zq " + pool[0], "x" * 300 + "1"), (101, "", "y"), (102, "ab", "never seen")]
    docs = spark.createDataFrame(texts, "doc_id string, text string, lang string").withColumns({"k1": F.xxhash64("doc_id"), "k2": F.lit(0).cast("long")})
    monkeypatch.setattr(quality, "SLICE_ROWS", rows)
    first = docs.mapInPandas(quality._first, quality.FIRST).cache()
    model = quality.train(first)
    assert (model.slices > 1) == (rows == 900)
    got = {r["k1"]: r for r in quality.score(docs, model).collect()}
    keys = {r["doc_id"]: r["k1"] for r in docs.collect()}
    known = {}
    for _, t, lang in texts[:40]:
        for k in (lang, quality.ALL):
            known.setdefault(k, Counter()).update(t.split())
    plain = {k: plain_kneser_ney(c) for k, c in known.items()}
    for i, t, lang in texts:
        logs = []
        for w in t.split():
            full = [1] * 4 + [int(x) for x in quality.symbol_codes(np.array([ord(ch) for ch in w], np.uint64))] + [2]
            for j in range(4, len(full)):
                g = tuple(full[j - 4 : j + 1])
                own = plain[lang](g) if lang in plain else 1 / 4096
                logs.append(math.log10(0.8 * own + 0.2 * plain[quality.ALL](g)))
        if not logs:
            assert keys[str(i)] not in got
            continue
        r = got[keys[str(i)]]
        assert r["symbols"] == len(logs) and r["log_ppl"] == pytest.approx(-np.mean(logs), rel=1e-5) and r["sd"] == pytest.approx(np.std(logs), rel=1e-4, abs=1e-6)


def test_verdicts_follow_the_bands(documents):
    got = quality.quality(documents).toPandas()
    fits = ~(got["log_ppl"] < got["lower"]) & ~(got["log_ppl"] > got["upper"])
    assert (got["kept"] == (~got["base_failed"] & fits)).all() and (got.loc[got["n_words"] > 0, "log_ppl"].notna()).all()
    assert got["base_failed"].tolist() == ((got["n_words"] < 20) | (100 * got["n_repeat_words"] > 30 * got["n_words"])).tolist()


def test_quality_separates_junk(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality(documents).join(labels, "doc_id").toPandas()
    assert got[got["quality"] == 1]["kept"].mean() > 0.85 and got[got["quality"] == 0]["kept"].mean() < 0.35


# 2 toxicity

@given(st.lists(st.sampled_from([-0.53, -0.11, 0.97, 2.03]), max_size=24))
@settings(max_examples=200, deadline=None)
def test_segments_equal_the_plain_method(scores):
    got, want = toxicity.segments(scores), toxicity.all_segments_plain(scores)
    assert [s for s, _, _ in got] == pytest.approx([s for s, _, _ in want])
    assert [sum(scores[i : j + 1]) for _, i, j in got] == pytest.approx([s for s, _, _ in got])
    assert all(a < b for (_, _, a), (_, b, _) in zip(got, got[1:], strict=False))


def test_extremes_are_fitted():
    rng = np.random.default_rng(2)
    n = rng.integers(50, 2000, 4000)
    best = np.maximum(0, (np.log(0.02 * n) - np.log(-np.log(rng.random(4000)))) / 0.7)
    lam, k = toxicity.fit_extremes(best, n, 0.5)
    assert lam == pytest.approx(0.7, rel=0.05) and k == pytest.approx(0.02, rel=0.15)


def test_toxic_held_out(spark, sf):
    d = sf.replace("0.001", "0.01")
    got = queries.op2_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert got["score"].between(0, 1).all()
    assert got[got["toxic"] == 0]["predicted"].mean() < 0.03 and got[got["toxic"] == 1]["predicted"].mean() > 0.6


# 3 token counts

@given(st.lists(st.text("abc", min_size=1, max_size=4), min_size=1, max_size=12), st.text("abcd", min_size=1, max_size=14))
@settings(max_examples=300, deadline=None)
def test_automaton_equals_greedy(pieces, word):
    p = {tuple(x) for x in pieces}
    assert token_count.PieceCounter(p).count(tuple(word)) == token_count.greedy_count(tuple(word), p, 4)


def test_token_counts_of_texts_equal_greedy_cutting_of_the_librarys_words(spark, documents):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    inside, longest = set(load := token_count.load_pieces(path)), max(map(len, load))
    rows = [(r["doc_id"], r["text"]) for r in documents.limit(40).collect()] + [(9001, "Ünïcode e\u0301 ½ x² 日本語 don't we'll -- ... \x1c a_b 12"), (9002, ""), (9003, None)]
    got = {r["doc_id"]: r for r in token_count.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    back = {c: bytes([b]) for b, c in enumerate(token_count.byte_symbols())}
    for i, t in rows:
        cut = [w for w, _ in tk.pre_tokenizer.pre_tokenize_str(tk.normalizer.normalize_str(t or ""))]
        words = [b"".join(back[c] for c in w).decode() for w in cut]
        want = sum(token_count.greedy_count(tuple(token_count.symbols_of(w)), inside, longest) for w in words)
        assert (got[i]["n_words"], got[i]["n_tokens"], got[i]["n_unknown"]) == (len(words), want, 0), i


# 4 packing

@given(st.lists(st.integers(1, 100), min_size=1, max_size=120))
@settings(max_examples=60, deadline=None)
def test_local_search_keeps_pieces(lengths):
    x = np.array(lengths)
    first = packing.best_fit(x, 100)
    bins = packing.local_search(first, x, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(x)))
    assert all(x[b].sum() <= 100 for b in bins) and len(bins) <= len(first)
    assert sum(int(x[b].sum()) ** 2 for b in bins) >= sum(int(x[b].sum()) ** 2 for b in first)


def test_packing_of_tokens(spark, awkward):
    from tokenizers import Tokenizer

    got = packing.pack_documents(awkward, queries.encoder_paths()).toPandas()
    tk = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    pieces = Counter(zip(got["length"], got["ids_crc32"], strict=True))
    want: Counter = Counter()
    for r in awkward.collect():
        ids = np.array([*tk.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        for a, n in packing.cut(len(ids), 1024):
            want[(n, zlib.crc32(ids[a : a + n].tobytes()))] += 1
    assert pieces == want
    for _, seq in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert seq["offset"].tolist() == [0, *np.cumsum(seq["length"])[:-1]] and seq["length"].sum() <= 1024


@pytest.mark.parametrize("text", ["a  b", " lead", "x\n y", "tab\there it's 12 34", "x \n y", "trail ", "<|endoftext|> a", "é ñ ß", "a b c", "don't we'll"])
def test_encoder_equals_the_library(text):
    from tokenizers import Tokenizer

    enc = packing.Encoder(*queries.encoder_paths())
    tk = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    for t in (text, "word " + text + " more words", text * 3):
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids


@given(st.lists(st.sampled_from([*"ab1 \n\t.,'!-", "é", "日", "\u00a0", "Don't ", " the", "  ", "12 "]), max_size=40).map("".join))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_the_library_on_any_text(text):
    enc, tk = _encoders()
    assert np.frombuffer(enc.ids(text), "<u4").tolist() == tk.encode(text, add_special_tokens=False).ids


@functools.cache
def _encoders():
    from tokenizers import Tokenizer

    return packing.Encoder(*queries.encoder_paths()), Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))


def test_local_search_comes_near_the_volume():
    x = np.random.default_rng(1).integers(200, 521, 1200)
    first = packing.best_fit(x, 1024)
    assert len(packing.local_search(first, x, 1024)) <= len(first) - 6


@pytest.mark.parametrize("shard", [50, 2500])
def test_packing_places_every_piece_once(spark, shard):
    rng = random.Random(4)
    sizes = [rng.choice([1024, rng.randint(1, 1023), rng.randint(200, 520)]) for _ in range(900)]
    got = packing.pack(spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "piece long, length long"), shard=shard).toPandas()
    assert got.set_index("piece")["length"].to_dict() == dict(enumerate(sizes))
    for _, seq in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert seq["offset"].tolist() == [0, *np.cumsum(seq["length"])[:-1]] and seq["length"].sum() <= 1024
    assert got["sequence_id"].nunique() <= 1.06 * sum(sizes) / 1024


# 5 vectors

def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 16))
    x[300:600] = x[0] + rng.normal(size=(300, 16)) * 0.15
    x[700:720] = x[5]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None, *[1.0] * 15]), (2004, [float("inf")] * 16), (None, x[5].tolist()), (2005, [1.0, 2.0])]
    got = ann.vector_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shards=3).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    own = got[got["vec_id"] < 1200].set_index("vec_id").loc[range(1200)]
    assert (own["n_links"].to_numpy() == link.sum(1) - 1).mean() > 0.99
    a, b = np.nonzero(link)
    low = dict(zip(*forest(a, b), strict=True))
    assert (own["component_id"].to_numpy() == [low.get(i, i) for i in range(1200)]).mean() > 0.99
    rest = got[got["vec_id"] >= 2000]
    assert (rest["n_links"] == 0).all() and (rest["component_id"] == rest["vec_id"]).all() and len(got) == len(rows)


def test_vectors_with_repeated_ids_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 9, True), (1, [0.0, 1.0], 9, True), (2, [0.0, 2.0], 9, True), (3, [3.0, 0.0], 9, True), (4, [0.0, 1.0], 9, True), (4, None, 9, True), (5, None, 9, True), (5, [], 9, True), (None, [1.0, 0.0], 9, True), (None, [1.0, 0.0], 9, True)]
    got = ann.vector_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard long, query boolean")).collect()
    # of the two values of 1 the lesser counts: it is linked with 2 and 4
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"]) == [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 2, 1, False), (5, 0, 5, True)]
    assert [(r["n_links"], r["component_id"]) for r in got if r["vec_id"] is None] == [(0, None)] * 2


def test_each_shard_is_a_task_of_its_own(spark):
    keys = ann.own_partitions(spark, 13)
    assert keys.select(F.pmod(F.hash("shard"), F.lit(13))).distinct().count() == keys.select("shard").distinct().count() == 13


def test_recall_of_links_by_vector(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(700, 32))
    x = np.concatenate([base, base[:350] + 0.25 * rng.normal(size=(350, 32)), base[:60] + 0.2 * rng.normal(size=(60, 32))])
    got = ann.vector_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas().set_index("vec_id")["n_links"]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    some = want > 0
    assert some.sum() > 300 and (got.loc[range(len(x))].to_numpy() <= want).all()
    assert (got.loc[range(len(x))].to_numpy()[some] / want[some]).mean() >= 0.97


def test_audit_counts_links_of_other_shards_queries_alone():
    # one hot group, answered from all rows, and pairs whose other half only asks; a graph without arcs finds no pair
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    hot = base[0] + 0.01 * rng.normal(size=(400, 16))
    rows, asks = np.concatenate([base, hot]), base[1:61] + 0.001 * rng.normal(size=(60, 16))
    shard = ann.Shard(np.arange(len(rows)), np.ones(len(rows), np.int64), list(rows), 0.9)
    true = shard.graph.query
    # the beam finds each asked row's partner only from 128 on
    shard.graph.query = lambda q, beam: true(q, beam) if beam >= 128 else _lose(*true(q, beam), 300)
    ids = np.concatenate([10_000 + np.arange(60), np.arange(len(rows))])
    shard.audit(ids, ann.unit([*asks, *rows]))
    assert shard.beam >= 128
    # found is each row's link with itself, which no audit counts
    alone = ann.Shard(np.arange(300), np.ones(300, np.int64), list(base), 0.999)
    alone.audit(np.arange(300), ann.unit(list(base)))
    assert alone.beam == ann.BEAM and alone.recall == 0.0


def _lose(ids, sims, below):
    return ids, np.where(ids < below, -np.inf, sims)


@pytest.mark.parametrize("shards", [1, 2, 5, 8])
def test_two_shards_meet_once_and_count_for_both_ends(spark, shards):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(120, 16))
    x = np.concatenate([base, base[:60] + 0.05 * rng.normal(size=(60, 16)), base[:60]])  # the last are copies
    got = ann.vector_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), shards=shards).toPandas().set_index("vec_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    assert (got.loc[range(len(x)), "n_links"].to_numpy() == link.sum(1) - 1).all()
    low = dict(zip(*forest(*np.nonzero(link)), strict=True))
    assert got.loc[range(len(x)), "component_id"].tolist() == [low.get(i, i) for i in range(len(x))]
    # of the 180 vectors that differ each asks its own shard, and about half of the others
    vectors = [(k, v.tolist(), 1) for k, v in enumerate(x[:180])]
    for n in (1, 2, 5, 8, 9):
        ask = ann.asked_parts(spark.createDataFrame(vectors, "vec_id long, embedding array<double>, n long"), n).collect()
        pairs = {(r["home"], r["part"]) for r in ask}
        assert len(ask) == len({(r["vec_id"], r["part"]) for r in ask}) <= 180 * (1 + n / 2)
        assert all((a, a) in pairs for a, _ in pairs) and all(((a, b) in pairs) != ((b, a) in pairs) for a in range(n) for b in range(a))


def test_no_vectors(spark):
    assert ann.vector_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_reference_texts_and_hints_are_judged_by_the_whole_text():
    low, high = "plain words of a text " * 1000, "JUNK ÀÉ LETTERS ΩΣ " * 3000
    for text, good in ((low + high, False), (high[:20_000] + low * 10, True), (low, True), (high, False)):
        assert quality._reference(text, len(text.split()), 0) is good
    hint = html_text.HINTS[0]
    block = html_text.blocks_of(f"<p>{'x ' * 300}{hint}</p>")
    assert "hint " + hint in html_text.features(block)[0]


# 6 scoring

def test_scores_are_log_probabilities(spark):
    docs = make(spark, [(k, t, "en", "a") for k, t in enumerate(["a b a b c", "a b c", None, "", "a b d", "B a", "zz zz"] * 4)])
    held = F.col("doc_id") % 7 == 6
    got = ngram_scoring.score_documents(docs, held).toPandas()
    train = [ngram_scoring.tokens_of(r["text"] or "") for r in docs.collect() if r["doc_id"] % 7 != 6]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    texts = {r["doc_id"]: ngram_scoring.tokens_of(r["text"] or "") for r in docs.collect()}
    for r in got.itertuples():
        t = texts[r.doc_id]
        assert r.n_tokens == len(t) and r.n_known == sum(w in c for w in t) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r.score < 0


def plain_model(train):
    """Counts and exponents of the model, and log10 probability of a token after others, by the plain formula."""
    grams = [Counter(), Counter(), Counter()]
    end = ngram_scoring.END
    for t in train:
        for i, w in enumerate(t):
            grams[0][(w,)] += 1
            grams[1][(t[i - 1] if i else end, w)] += 1
            if i:
                grams[2][(t[i - 2] if i > 1 else end, t[i - 1], w)] += 1
    n = sum(grams[0].values())
    unknown = (sum(c == 1 for c in grams[0].values()) + 1) / (n + 2) if n else 1.0

    def exponent(k):
        new = sum(c == 1 for c in grams[k].values())
        bins = {}
        for c in grams[k - 1].values():
            bins.setdefault(int(math.log2(c) * ngram_scoring.BINS), []).append(c)
        lo, hi = 0.0, 8.0
        for _ in range(60):
            mid = (lo + hi) / 2
            total = sum(sum(cs) * ngram_scoring.SHARE_OF_ONE * (sum(cs) / len(cs)) ** -mid for cs in bins.values())
            lo, hi = (mid, hi) if total > new else (lo, mid)
        return lo

    g = [exponent(1), exponent(2)]

    def p(state, w):
        if not state:
            return (1 - unknown) * grams[0][(w,)] / n if grams[0][(w,)] else unknown
        have = grams[len(state) - 1][state]
        if not have:
            return p(state[1:], w)
        share = max(ngram_scoring.SHARE_OF_ONE * have ** -g[len(state) - 1], 1e-12)
        return (1 - share) * grams[len(state)][(*state, w)] / have + share * p(state[1:], w)

    def score(t):
        full = [end, *t]
        return sum(math.log10(p(tuple(full[max(0, i - 1) : i + 1]), w)) for i, w in enumerate(t))

    return p, score, {w for (w,) in grams[0]}


@pytest.mark.parametrize("batch", [40, 12_000_000])
def test_automaton_equals_the_formula_and_sums_to_one(spark, monkeypatch, batch):
    rng = random.Random(1)
    texts = [" ".join(rng.choices("abcdef", weights=[9, 7, 5, 3, 2, 1], k=rng.choice([0, 1, 2, 30]))) for _ in range(60)]
    probe = [" ".join(rng.choices([*"aBcdef", "nope", "never"], k=rng.randint(0, 12))) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, t) for k, t in enumerate(probe)]
    both = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    coded = ngram_scoring.encode
    monkeypatch.setattr(ngram_scoring, "encode", lambda d: coded(d, batch))
    monkeypatch.setattr(ngram_scoring, "RANGE_KEYS", 300)
    got = {r["doc_id"]: r["score"] for r in ngram_scoring.score_documents(both, F.col("doc_id") >= 1000).collect()}
    p, score, vocabulary = plain_model([ngram_scoring.tokens_of(t) for t in texts])
    for i, t in rows:
        assert got[i] == pytest.approx(score(ngram_scoring.tokens_of(t)), abs=1e-6), t
    for state in [(), (b"a",), (ngram_scoring.END, b"a"), (b"a", b"b"), (b"f", b"f"), (b"nope",)]:
        assert sum(p(state, w) for w in [*vocabulary, b"unknown"]) == pytest.approx(1)


def test_rare_ngrams_keep_their_context_in_a_large_corpus(spark):
    # over 2^21 tokens, one of each rare word
    docs = make(spark, [(1, "a " * 2_300_000 + "x", "en", "a"), (2, "qq ww", "en", "a"), (10, "qq ww", "en", "a"), (11, "qq", "en", "a")])
    s = {r["doc_id"]: r["score"] for r in ngram_scoring.score_documents(docs, F.col("doc_id") >= 10).collect()}
    # the second word and the end follow the first one each time that it occurs
    assert -9 < s[10] < -1 and s[10] > s[11]


def test_scores_beat_the_base_on_held_out(spark, sf):
    got = queries.op6_lm_scoring(spark, sf).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got["s"] > got["b"]


# 7 mixing

def test_raking_meets_targets(spark, documents):
    goal = spark.createDataFrame([("en", 0.4), ("de", 0.3), ("fr", 0.2), ("es", 0.1)], "lang string, target double")
    cells = mixing.features(documents).groupBy(*mixing.DIMS).agg(F.sum("n_tokens").alias("tokens"))
    targets = mixing.goals(cells, {"lang": goal}, 0.3)
    raked = mixing.rake(cells, targets, 0.3).toPandas()
    assert (raked["ratio"] <= 1 / 0.3 + 1e-9).all()
    for d in mixing.DIMS:
        got = raked.groupby(d)["weight"].sum()
        for r in targets[d].collect():
            assert got[r[d]] == pytest.approx(r["target"], abs=3e-4)


def test_drawn_tokens_meet_targets(spark):
    # nine tenths of the tokens from one source; flattened targets are 82.3 and 17.7
    rng = random.Random(5)
    docs = spark.createDataFrame([(k, " ".join(rng.choices(["alpha", "gamma", "delta", "omega"], k=20)), "big" if k % 10 else "small", "en") for k in range(4000)], "doc_id long, text string, source string, lang string")
    for share in (0.5, 0.8):
        got = mixing.calibrated(docs, share=share, topic=F.lit("one")).toPandas()
        expected = (got["probability"] * got["n_tokens"]).groupby(got["source"]).sum()
        want = 0.9**0.7 / (0.9**0.7 + 0.1**0.7)
        want = max(want, 1 - mixing.HEADROOM * 0.1 / share)
        assert expected.sum() == pytest.approx(share * got["n_tokens"].sum(), rel=1e-3)
        assert expected["big"] / expected.sum() == pytest.approx(want, abs=3e-4)
        real = got[got["sampled"]].groupby("source")["n_tokens"].sum()
        assert real["big"] / real.sum() == pytest.approx(want, abs=0.02)


def test_topics_come_from_the_whole_text(spark):
    tail = " ".join(["zweite"] * 500)
    rows = [(1, "erstes " * 3 + tail), (2, "anderes " * 3 + tail), (3, "日本語の文章です " * 4), (4, "a b c"), (5, None)]
    got = {r["doc_id"]: r["topic"] for r in mixing.features(make(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    assert got[1] == got[2] != "none" and got[3] != "none" and got[4] == got[5] == "none"


# 8 HTML

def test_held_out_pages():
    pages = html_text.labelled_pages(120, seed=99)
    right = total = 0
    for page, gold in pages:
        want = "\n\n".join(" ".join(t.split()) for t, y in gold if y)
        right += html_text.main_text(page, html_text.default_field()) == want
        total += 1
    assert right / total > 0.8


def test_viterbi_is_the_best_sequence():
    f = html_text.Field({"x": 1.3, "y": -0.7, "z": 0.2}, np.array([[0.5, -0.4], [-0.3, 0.6]]), np.array([0.1, -0.2]))
    feats = [["x"], ["y"], ["z", "y"], ["x", "y"], ["z"]]

    def value(y):
        s = f.begin[y[0]] + sum(f.w[k] for t, fs in enumerate(feats) if y[t] for k in fs)
        return s + sum(f.trans[a, b] for a, b in zip(y, y[1:], strict=False))

    best = max(([*map(int, f"{k:05b}")] for k in range(32)), key=value)
    assert f.decode(feats) == best


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<html><body></body></html>", ""), ("<article><h1>T &amp; x</h1><p>one  two<br>three.</p><p><b>four five<p>six, seven eight.</article><footer>&copy; me</footer>", "T & x\n\none two three.\n\nfour five\n\nsix, seven eight."), ("<nav><a href=x>menu</a></nav><article><p>Some words in here, for all.</p><div class='ad'>Buy this now</div></article><!-- <p>no</p>", "Some words in here, for all."), ("<script>var t='<p>'</script><main><p>A text of some length, with words.</p></main><ol class=comments><li>me too</li></ol>", "A text of some length, with words.")])
def test_pages(page, text):
    assert html_text.main_text(page, html_text.default_field()) == text


def test_unnamed_remarks_after_the_article_go():
    page = "<body><article><h1>T of it</h1><p>One long paragraph of the article, with words and more words in it.</p></article><div><p>I liked this, it is a nice text and I have many words to say.</p></div></body>"
    assert html_text.main_text(page, html_text.default_field()) == "T of it\n\nOne long paragraph of the article, with words and more words in it."


def test_extract_in_spark(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    want = {r["page_id"]: r for r in pages.collect()}
    assert got.keys() == want.keys() and sum(len(r["text"]) > 100 for r in got.values()) > 0.9 * len(got)
    for i, r in got.items():
        assert r["text"] == html_text.main_text(want[i]["html"], html_text.default_field()) and r["n_chars"] == len(r["text"]) and r["url"] == want[i]["url"]
        assert not any(x != " ".join(x.split()) or not x for x in r["text"].split("\n\n") if r["text"])


def test_extract_of_awkward_pages(spark):
    long = "<article>" + "<p>Some words of a long page, again and again.</p>" * 20_000 + "</article>"
    rows = [(1, None, None, "x"), (1, "u", "", "x"), (None, "u", "<p>", "x"), (4, "u", long, "x"), (4, "u", long, "x"), (5, "u", "\x00<article><p>Words, and more words here.\u2003 Then an end.</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert len(got) == 6 and html_text.extract(df.where("page_id < 0")).count() == 0
    assert [r["n_chars"] for r in got if r["page_id"] == 4] == [46 * 20_000 - 2] * 2 or len({r["n_chars"] for r in got if r["page_id"] == 4}) == 1
    assert all(r["text"] == "" and r["n_chars"] == 0 for r in got if r["page_id"] in (1, None))


# 9 lines

def test_workers_give_back_what_a_task_took():
    rss = lambda: int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) // 1024

    def run(batches):
        for _ in batches:
            many = [bytes(3000) for _ in range(100_000)]
            last.append(bytes(3000))  # lies behind them on the heap
            del many
            yield rss()

    last = []
    for _ in lean(run)(iter([None])):
        held = rss()
    assert held - rss() > 100


def test_word_distance():
    ok = line_dedup.word_distance_at_most_one
    assert ok(["a", "b"], ["a", "b"]) and ok(["a", "b"], ["a"]) and ok(["a"], ["b"]) and ok(["b", "c"], ["a", "b", "c"])
    assert not ok(["a", "b"], ["b", "a"]) and not ok(["a"], ["a", "b", "c"])


@given(st.lists(st.lists(st.sampled_from("abc"), min_size=2, max_size=6), min_size=2, max_size=2))
@settings(max_examples=200, deadline=None)
def test_variants_meet_iff_near(two):
    a, b = two
    ka, ra = line_dedup.variant_keys(a)
    kb, rb = line_dedup.variant_keys(b)
    roles = lambda k, r, x: set(k[r == x].tolist())
    met = roles(ka, ra, 0) & roles(kb, rb, 0) or roles(ka, ra, 1) & roles(kb, rb, 2) or roles(ka, ra, 2) & roles(kb, rb, 1) or a == b
    assert bool(met) == line_dedup.word_distance_at_most_one(a, b)


def test_lines_against_brute_force(spark):
    rng = random.Random(8)
    pool = [[rng.choice("abcdefg") for _ in range(rng.randint(3, 9))] for _ in range(60)]
    docs = []
    for k in range(40):
        lines = []
        for _ in range(4):
            w = list(rng.choice(pool))
            if rng.random() < 0.4:
                w[rng.randrange(len(w))] = rng.choice("xyz")
            lines.append(" ".join(w))
        docs.append((k, "\n".join(lines), "en", "a"))
    df = make(spark, docs)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    seen, want = [], {}
    for k, t, _, _ in docs:
        keep = []
        for line in t.split("\n"):
            w = line.split()
            long = len(w) >= line_dedup.MIN_WORDS
            if not any(w == x or long and len(x) >= line_dedup.MIN_WORDS and line_dedup.word_distance_at_most_one(w, x) for x in seen):
                keep.append(line)
            seen.append(w)
        want[k] = "\n".join(keep)
    assert got == want


def test_lines_of_rows_with_one_id(spark):
    long = "one two three four five six"
    rows = [(5, long + "\nalpha", "en", "a"), (5, "beta\ngamma\n" + long + " seven\nalpha", "en", "a"), (5, long + "\nalpha", "en", "a"), (None, "gamma", "en", "a"), (7, None, "en", "a")]
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in line_dedup.dedup_lines(make(spark, rows)).collect()))
    # the row with the null id is the earliest; of the two texts of 5 that of the lower hash keeps the lines they share
    assert len(got) == 5 and (0, "gamma") in got and (7, "") in got
    own = [t for i, t in got if i == 5]
    assert sorted(own) in (sorted([long + "\nalpha"] * 2 + ["beta"]), sorted(["beta\n" + long + " seven\nalpha"] + [""] * 2))
    exact = [r["text"] for r in line_dedup.dedup_lines(make(spark, rows), edits=0).collect() if r["doc_id"] == 5]
    assert sum(long in (t or "") for t in exact) == 3


def test_variants_carry_numbers_in_the_order_of_places(spark, monkeypatch):
    tables, keep = {}, line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda d, tag: tables.setdefault(tag, keep(d, tag)))
    rng = random.Random(4)
    rows = [(k % 30, " ".join(rng.choices("abc", k=6)) + "\n" + " ".join(rng.choices("abc", k=6)), "en", "a") for k in range(60)]
    line_dedup.dedup_lines(make(spark, rows)).collect()
    assert tables["line-variants"].columns == ["key", "role", "no"]
    near = tables["line-near"].select("no", "at").collect()
    assert len(near) > 20 and [r["no"] for r in sorted(near, key=lambda r: r["at"])] == sorted({r["no"] for r in near})


# 10 MinHash

@pytest.mark.parametrize("block", [8, 768])
def test_near_duplicates_against_brute_force(spark, monkeypatch, block):
    rng = random.Random(2)
    vocab = [f"t{k}" for k in range(400)]
    base = rng.choices(vocab, k=60)
    rows = [(0, None), (1, ""), (2, "solo"), (3, "Solo")]
    for k in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(60)] = rng.choice(vocab)
        rows.append((10 + k, " ".join(w)))
    rows += [(200 + k, " ".join(rng.choices(vocab, k=30))) for k in range(30)]
    rows += [(300, rows[10][1]), (301, rows[10][1].upper())]
    monkeypatch.setattr(minhash, "BLOCK", block)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(make(spark, [(i, t, "en", "a") for i, t in rows]), shingle=2).collect()}
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[k : k + 2]) for k in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    ids = list(sets)
    for _ in range(6):
        for i in ids:
            for j in ids:
                if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    assert {i: r["component_id"] for i, r in got.items()} == label
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


def test_near_duplicates_broadcast_nothing_that_grows(spark, monkeypatch):
    plans = {}
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    keep = minhash.stored
    monkeypatch.setattr(minhash, "stored", lambda d, tag: (plans.update({tag: plan(d)}), keep(d, tag))[1])
    monkeypatch.setattr("sluice.llm.common.stored", lambda d, tag: (plans.update({tag: plan(d)}), keep(d, tag))[1])
    monkeypatch.setattr("sluice.llm.common.FOREST_LINKS", 4)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = [(k, " ".join(f"w{j}" for j in range(40)) + f" x{k // 2}", "en", "a") for k in range(60)]
    out = minhash.near_duplicates(make(spark, rows), shingle=2)
    plans["out"] = plan(out)
    assert {"mh-prefixes", "mh-lists-members", "mh-sets-members", "mh-lists-large", "out"} <= set(plans)
    small = ("-outside", "-leaders", "-rest")  # these join a row a large group
    assert [tag for tag, p in plans.items() if "Broadcast" in p and not tag.endswith(small)] == []
    assert {r["component_id"] for r in out.collect()} == {0}


def test_the_pipelines_near_duplicates_broadcast_no_postings(spark, monkeypatch):
    import corpus_pipeline

    plans, keep = {}, minhash.stored
    monkeypatch.setattr(minhash, "stored", lambda d, tag: (plans.update({tag: d._jdf.queryExecution().executedPlan().toString()}), keep(d, tag))[1])
    rows = [(k, " ".join(f"w{j}" for j in range(60)) + f" x{k // 2}", "en", "a") for k in range(12)]
    assert [r["doc_id"] for r in corpus_pipeline.minhash(spark, make(spark, rows), "").collect()] == [0]
    assert [tag for tag in ("mh-prefixes", "mh-lists-members", "mh-sets-members") if "Broadcast" in plans[tag]] == []


def test_the_pipeline_broadcasts_no_ids_of_near_duplicates(spark):
    import corpus_pipeline

    rows = [(k, " ".join(f"w{j}" for j in range(60)) + f" x{k // 2}", "en", "a") for k in range(12)]
    out = corpus_pipeline.minhash(spark, make(spark, [*rows, (None, rows[0][1], "en", "a"), (20, "another text", "en", "a")]), "")
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["0", "20", "None"]
    plan = out._jdf.queryExecution().executedPlan().toString()  # with what ran
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan


# awkward and empty input

OPERATORS = {
    "quality": lambda d: quality.quality(d),
    "toxicity": lambda d: toxicity.score(d, toxicity.train(d, d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))),
    "token_counts": lambda d: token_count.token_counts(d, queries.tokenizer_path("word_bpe_49k.json")),
    "scoring": lambda d: ngram_scoring.score_documents(d, ngram_scoring.by_remainder()),
    "mixing": lambda d: mixing.calibrated(d),
    "lines": lambda d: line_dedup.dedup_lines(d),
    "line_report": lambda d: line_dedup.line_report(d),
    "minhash": lambda d: minhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_rows_all_come_back(awkward, name):
    assert OPERATORS[name](awkward).toPandas().shape[0] == awkward.count()


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables(empty, name):
    assert OPERATORS[name](empty).count() == 0


def test_pieces_take_some_rows_at_a_time(spark, monkeypatch):
    texts = [None, "", "one", "two words", "a b c " * 400, "x" * 50] * 3
    frame = spark.createDataFrame([(k if k else None, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    want = packing.pieces_of(frame, queries.encoder_paths()).collect()
    monkeypatch.setattr(packing, "ROWS", 4)
    assert packing.pieces_of(frame, queries.encoder_paths()).collect() == want and len({r["doc_id"] for r in want}) == 18
    assert packing.CACHE <= 100_000


def test_packing_of_nothing(empty):
    assert packing.pack_documents(empty, queries.encoder_paths()).count() == 0


def test_equal_rows_have_equal_results(awkward):
    got = quality.quality(awkward).where("doc_id = 6").toPandas()
    assert len(got) == 2 and got.iloc[0].equals(got.iloc[1])


def test_passages_are_found_in_long_texts():
    m = toxicity.ToxicModel({"idiot": 6.0, "scum": 6.0, "kind": -1.0}, 1.0, 0.1, [-3.0, 0.5, 1.0, 1.0], 0.1)
    text = "word " * 20_000 + "idiot scum idiot " + "word " * 20_000
    got, n = m.scan(text)
    assert n == 40_003 and [(i, j) for _, i, j in got] == [(20_000, 20_002)]
    assert m.score_text(text) > m.score_text("word " * 10)
    # words of clean documents cost more than unknown ones
    assert len(m.scan("idiot " + "word " * 40 + "idiot")[0]) == 1 and len(m.scan("idiot " + "kind " * 40 + "idiot")[0]) == 2
    assert isinstance(pd.Series([m.score_text("")])[0], float)
