"""The registered queries: SQL where it can state them, and the pipeline by hand."""

import random

import duckdb
import pytest

from sluice.llm import line_dedup, minhash, queries

TABLES = "documents labels pages embeddings".split()


def plain(df):
    return sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf).toPandas()
    assert plain(got) == plain(con.execute(queries.oracle_sql()[name]).df())


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, seen[-1], sf).cache()
        assert out.columns == docs.columns, name
        seen.append(out)
    counts = [d.count() for d in seen]
    assert all(a >= b for a, b in zip(counts, counts[1:], strict=False)) and counts[-1] > 0
    assert minhash.near_duplicates(seen[3]).where("not kept").count() == 0
    assert line_dedup.line_report(seen[2]).where("n_removed > 0").count() == 0
    packed = p.STAGES[-1][1](spark, seen[-1], sf).toPandas()
    assert set(packed["doc_id"]) == {r["doc_id"] for r in seen[-1].select("doc_id").collect()}
    assert packed.groupby("sequence_id")["length"].sum().max() <= 1024


def near(a: list[str], b: list[str]) -> bool:
    """Equal, or one word put in, taken out or replaced."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    cuts = lambda w: {tuple(w[:i] + w[i + 1 :]) for i in range(len(w))}
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return tuple(min(a, b, key=len)) in cuts(max(a, b, key=len))


def shingles(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents and labels with toxic passages, repeated lines, copies, nulls, empty texts and repeated rows."""
    rng = random.Random(7)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(500)]
    bad = ["zzidiot", "zzscum", "zzvermin", "zztrash"]
    rows, labels = [], []
    for k in range(160):
        lines = [" ".join(rng.choices(vocab, k=rng.randint(5, 25))) for _ in range(4)]
        if k % 4 == 0:
            lines[1] += " " + " ".join(rng.choices(bad, k=8))
        if k % 9 == 1:
            lines[0] = "read more of this here on our pages"
        if k % 10 == 3 and rows:
            lines = rows[-1][1].split("\n")[:3] + lines[:1]
        rows.append((k, "\n".join(lines), "en" if k % 3 else "de", f"s{k % 2}"))
        labels.append((k, 1, int(k % 4 == 0)))
    long = " ".join(rng.choices(vocab, k=120))
    rows += [(200, long, "en", "s0"), (201, long, "en", "s0"), (202, long.replace(" ", "  "), None, None), (203, None, "en", "s0"), (204, "", None, "s1"), (None, " ".join(rng.choices(vocab, k=30)), "en", "s0"), (205, "solo words of one more line here", "en", "s1"), (205, "solo words of one more line here", "en", "s1")]
    at = str(tmp_path_factory.mktemp("small"))
    docs = spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), 1, "x", "y", 2) for i, t, lang, src in rows], "doc_id long, text string, lang string, source string, n_chars long, h long, `row` string, topic string, _mix_p long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_pipeline_against_brute_force(spark, small):
    import corpus_pipeline as p

    stages = dict(p.STAGES)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plain_rows = lambda df: sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in df.collect()), key=str)
    clean = stages["toxicity"](spark, docs, small).cache()
    # each text with four words of the toxic ones in a row or more goes, all others stay
    assert plain_rows(clean) == [x for x in plain_rows(docs) if not x[1] or x[1].count("zz") < 4] and clean.columns == docs.columns

    deduped = stages["line_dedup"](spark, clean, small).cache()
    seen, want = [], []
    for i, t in sorted(set(plain_rows(clean)), key=lambda x: x[0]):
        keep = []
        for line in (t or "").split("\n"):
            w = line.split()
            if not w or not any(w == x or len(w) >= 5 and len(x) >= 5 and near(w, x) for x in seen):
                keep.append(line)
            seen += [w] if w else []
        text = "\n".join(keep)
        if t is None or text == t or text.split():
            want += [(i, None if t is None else text)] * plain_rows(clean).count((i, t))
    assert plain_rows(deduped) == sorted(want, key=str)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in deduped.collect())

    one = stages["minhash"](spark, deduped, small).cache()
    rows = [(i, shingles(t or "")) for i, t in plain_rows(deduped)]
    gone = set()
    for i, a in rows:
        for j, b in rows:
            if i != -1 and j != -1 and i < j and a and 100 * len(a & b) >= 80 * len(a | b):
                gone.add(j)
    assert {r["doc_id"] for r in one.collect()} == {i if i != -1 else None for i, _ in rows} - gone

    mixed = stages["mixing"](spark, one, small).cache()
    assert mixed.columns == docs.columns and 0 < mixed.count() <= one.count() and mixed.subtract(one).count() == 0
    packed = stages["packing"](spark, mixed, small).toPandas()
    assert len(packed) == mixed.count() and packed.groupby("sequence_id")["length"].sum().max() <= 1024


def test_pipeline_of_nothing(spark, small, tmp_path):
    import corpus_pipeline as p

    spark.read.parquet(f"{small}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{small}/labels.parquet").where("false").write.parquet(str(tmp_path / "labels.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
