"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents' tokens (words here) are summed over cells of source, language and topic. Raking scales the cells so that their
sums over each dimension in turn meet the targets, sweep after sweep, until no sum is off by more than TOLERANCE. A cell can't give more than all its tokens: its
weight stays under tokens / (share * all tokens). That bound is part of the fitting, so the other cells make up for a cell that gives all it has, and a
document's probability, share * weight / (share of its cell in all tokens), never has to be cut afterwards: the expected tokens of the draw are in the target shares. The
draw compares a hash of the document's id with the probability, so it is the same on every run.

Without given targets, a dimension's target shares are its token shares to the power TEMPERATURE, brought to sum 1. A value whose
target is more than HEADROOM of its tokens gives that part of them; the others share the rest in proportion to their targets. A value without a target share keeps no weight.

The default topic is that of the whole text: each word of LONG characters or more falls by its md5 into one of TOPICS, and the one with most words is the text's. Callers who have
topics pass a column of their own.

Input cases: null source, language or text are values of their own ('' stands for null; a null text has no tokens and no topic); a document without tokens is
drawn with its cell's probability, and with 1 in a cell without tokens; copies of a row share one draw; null ids are always drawn; an empty table gives an empty result;
columns whose names the result uses are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sluice.llm.common import WORD_SQL, forget, stored

DIMS = ("source", "lang", "topic")
TOPICS, LONG = 8, 5
#: Sums may be off by so much of all tokens; sweeps end then, or after so many.
TOLERANCE, SWEEPS = 1e-4, 40
TEMPERATURE = 0.7
SHARE = 0.8
#: No value is asked for more than this part of its tokens: at all of them the fitting would go on for ever.
HEADROOM = 0.9
#: Values of a dimension up to which its sums are broadcast; beyond that the joins are the optimizer's.
FEW = 100_000
#: Rounds in which values that give all they have are found; each finds one at least, or is the last.
ROUNDS = 30


def topic_of(text: Column) -> Column:
    """The number of the topic with most of the text's long words, the first of equal ones; 'none' without such words."""
    found = F.regexp_extract_all(text, F.lit(f"({WORD_SQL.replace('+', '')}{{{LONG},}})"), 1)
    # the last character of a hexadecimal md5, of which the first eight and the last eight pair up
    marks = F.translate(F.array_join(F.transform(found, lambda w: F.substring(F.md5(w.cast("binary")), 32, 1)), ""), "89abcdef", "01234567")
    counts = lambda m: F.array(*[F.length(m) - F.length(F.replace(m, F.lit(str(k)), F.lit(""))) for k in range(TOPICS)])
    name = lambda m: once(counts(m), lambda c: F.when(F.array_max(c) > 0, F.concat(F.lit("t"), F.array_position(c, F.array_max(c)) - 1)).otherwise(F.lit("none")))
    return once(marks, name)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, however often the expression has it."""
    return F.transform(F.array(value), then)[0]


def keys_of(topic: Column | None = None) -> dict[str, Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return {"source": F.coalesce("source", F.lit("")), "lang": F.coalesce("lang", F.lit("")), "topic": topic_of(text) if topic is None else F.coalesce(topic, F.lit(""))}


def features(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens of every document, written once so that texts are read once."""
    tokens = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD_SQL)).cast("long")
    return stored(docs.select("doc_id", *[c.alias(d) for d, c in keys_of(topic).items()], tokens.alias("n_tokens")), "mix-features")


def by_dim(values: dict[str, float]) -> Column:
    """The number of the row's dimension."""
    out = F.lit(None).cast("double")
    for d, v in values.items():
        out = F.when(F.col("dim") == d, F.lit(float(v))).otherwise(out)
    return out


def goals(cells: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE, temperature: float = TEMPERATURE) -> dict[str, DataFrame]:
    """For each dimension (value, target) that the values' tokens suffice for: the given targets, or token shares flattened by the temperature.

    All dimensions are one table; a few numbers of each come to the driver.
    """
    targets = targets or {}
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in DIMS])
    flat = cells.where("tokens > 0").select(F.explode(pairs).alias("p"), "tokens").select("p.dim", "p.value", "tokens").groupBy("dim", "value").agg(F.sum("tokens").alias("tokens"))
    flat = stored(flat, "mix-margins")
    sums = {r["dim"]: r for r in flat.groupBy("dim").agg(F.sum("tokens").alias("t"), F.sum(F.pow("tokens", F.lit(temperature))).alias("w")).collect()}
    if not sums:
        return {d: flat.select(F.col("value").alias(d), F.lit(0.0).alias("target")) for d in DIMS}
    most = F.col("tokens") * F.lit(HEADROOM) / by_dim({d: share * r["t"] for d, r in sums.items()})
    rows = flat.where(~F.col("dim").isin(list(targets))).withColumn("target", F.pow("tokens", F.lit(temperature)) / by_dim({d: r["w"] for d, r in sums.items()}))
    for d, t in targets.items():
        rows = rows.unionByName(flat.where(F.col("dim") == d).join(t.select(F.col(d).alias("value"), F.col("target").cast("double").alias("target")), "value"))
    rows = stored(rows.select("dim", "value", "target", most.alias("most")), "mix-goals")
    factor = dict.fromkeys(DIMS, 1.0)
    for _ in range(ROUNDS):
        full = by_dim(factor) * F.col("target") >= F.col("most")
        got = rows.groupBy("dim").agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("target"))).alias("open")).collect()
        new = factor | {r["dim"]: (1 - r["full"]) / r["open"] for r in got if r["open"]}
        last, factor = factor, new
        if all(abs(factor[d] - last[d]) <= 1e-13 * last[d] for d in DIMS):
            break
    return {d: rows.where(F.col("dim") == d).select(F.col("value").alias(d), F.least(by_dim(factor) * F.col("target"), F.col("most")).alias("target")) for d in DIMS}


def rake(cells: DataFrame, targets: dict[str, DataFrame], share: float = SHARE, sweeps: int = SWEEPS) -> DataFrame:
    """cells (DIMS, tokens) with weight: token shares raked to the targets (dim, target), none over its bound; ratio: weight over token share."""
    dims = list(DIMS)
    rows = cells.where("tokens > 0")
    total = rows.agg(F.sum("tokens")).first()[0] or 1  # one number
    part = F.col("tokens") / F.lit(total)
    weight = F.least("raw", F.lit(1 / share) * part)
    rows = stored(rows.select(*dims, "tokens", part.alias("raw")), "mix-start")
    few = {d: t.limit(FEW + 1).count() <= FEW for d, t in targets.items()}
    small = lambda frame, dim: F.broadcast(frame) if few[dim] else frame
    for k in range(sweeps):
        new = rows.withColumn("off", F.lit(0.0))
        for dim in dims:
            step = new.groupBy(dim).agg(F.sum(weight).alias("m")).join(small(targets[dim], dim), dim).select(dim, "m", "target")
            off = F.greatest("off", F.coalesce(F.abs(F.col("m") - F.col("target")), F.lit(0.0)))
            new = new.join(small(step, dim), dim, "left").select(*dims, "tokens", (F.col("raw") * F.coalesce(F.col("target") / F.col("m"), F.lit(0.0))).alias("raw"), off.alias("off"))
        # a step reads the cells twice, so more sweeps unwritten would double the plan again and again
        seen = Observation()
        old, rows = rows, stored(new.observe(seen, F.max("off").alias("off")).drop("off"), f"mix-{k}")
        forget(old)
        if (seen.get["off"] or 0.0) <= TOLERANCE:
            break
    return rows.select(*dims, "tokens", weight.alias("weight"), (weight / part).alias("ratio"))


def cell_probabilities(docs_f: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE) -> DataFrame:
    """DIMS, weight and probability of every cell with tokens."""
    cells = stored(docs_f.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "mix-tokens")
    raked = rake(cells, goals(cells, targets, share), share)
    return stored(raked.select(*DIMS, "weight", F.least(F.lit(1.0), F.lit(share) * F.col("ratio")).alias("probability")), "mix-probabilities")


def drawn(doc_id: Column, probability: Column) -> Column:
    """Whether the id's hash, as a number from 0 to 1, is under the probability; null ids always are."""
    # 13 hexadecimal digits of the md5
    u = F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    return F.coalesce(u < probability, F.lit(True))


def calibrated(docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE, topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight (of its cell), probability and sampled of every document."""
    docs_f = features(docs, topic)
    table = cell_probabilities(docs_f, targets, share)
    rows = docs_f.join(table, list(DIMS), "left").withColumn("probability", F.coalesce("probability", F.lit(1.0))).withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return rows.withColumn("sampled", drawn(F.col("doc_id"), F.col("probability")))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE, topic: Column | None = None) -> DataFrame:
    """The documents that are drawn, with their columns. Texts move only if the table of cells is too large for the optimizer to broadcast."""
    table = cell_probabilities(features(docs, topic), targets, share)
    # the documents are one column, so that none of theirs can clash
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *[c.alias(d) for d, c in keys_of(topic).items()])
    return rows.join(table.drop("weight"), list(DIMS), "left").where(drawn(F.col("doc.doc_id"), F.coalesce("probability", F.lit(1.0)))).select("doc.*")


def _oracle() -> str:
    word = "'[^\\x20\\x09-\\x0D]"
    steps = [
        f"m as (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, len(regexp_extract_all(coalesce(text, ''), {word}+'))::bigint as n_tokens, translate(array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), {word}{{{LONG},}}'), lambda w: substr(md5(w), 32, 1)), ''), '89abcdef', '01234567') as marks from documents)",
        f"n as (select *, list_transform(range({TOPICS}), lambda k: length(marks) - length(replace(marks, k::varchar, ''))) as counts from m)",
        "f as (select doc_id, source, lang, case when length(marks) > 0 then 't' || (list_position(counts, list_max(counts)) - 1) else 'none' end as topic, n_tokens from n)",
        "c as (select source, lang, topic, sum(n_tokens)::bigint as tokens from f group by all)",
    ]
    for d in DIMS:
        steps.append(f"h_{d} as materialized (select {d}, pow(t, {TEMPERATURE}) / sum(pow(t, {TEMPERATURE})) over () as target, t * {HEADROOM} / ({SHARE} * sum(t) over ()) as most from (select {d}, sum(tokens)::double as t from c group by {d} having sum(tokens) > 0))")
        steps.append(f"l_{d}_0 as (select 1.0::double as factor)")
        for k in range(ROUNDS):
            steps.append(f"l_{d}_{k + 1} as materialized (select coalesce((1 - sum(case when factor * target >= most then most else 0 end)) / nullif(sum(case when factor * target >= most then 0 else target end), 0), any_value(factor)) as factor from h_{d}, l_{d}_{k})")
        steps.append(f"t_{d} as materialized (select {d}, least(factor * target, most) as target from h_{d}, l_{d}_{ROUNDS})")
    steps.append(f"r0 as materialized (select source, lang, topic, tokens, tokens::double / sum(tokens) over () as raw, tokens::double / sum(tokens) over () / {SHARE} as cap from c where tokens > 0)")
    steps.append("on_0 as (select true as go)")
    n = 0
    for k in range(SWEEPS):
        off = []
        for d in DIMS:
            steps.append(f"m{n} as materialized (select {d}, m, target from (select {d}, sum(least(raw, cap)) as m from r{n} group by {d}) join t_{d} using ({d}))")
            steps.append(f"r{n + 1} as materialized (select r.source, r.lang, r.topic, r.tokens, case when go then r.raw * m.target / m.m else r.raw end as raw, r.cap from r{n} r join m{n} m using ({d}), on_{k})")
            off.append(f"(select max(abs(m - target)) from m{n})")
            n += 1
        steps.append(f"on_{k + 1} as materialized (select go and greatest({', '.join(off)}) > {TOLERANCE} as go from on_{k})")
    steps.append(f"p as (select source, lang, topic, least(raw, cap) as weight, least(1.0, least(raw, cap) / cap) as probability from r{n})")
    return "with " + ",\n".join(steps) + """
select doc_id, source, lang, topic, n_tokens, round(coalesce(weight, 0), 6) as weight, round(coalesce(probability, 1), 6) as probability,
coalesce(('0x' || substr(md5(doc_id::varchar), 1, 13))::bigint::double / 4503599627370496.0 < coalesce(probability, 1), true) as sampled
from f left join p using (source, lang, topic)"""


ORACLE = _oracle()


def report(docs: DataFrame) -> DataFrame:
    rows = calibrated(docs)
    return rows.select("doc_id", *DIMS, "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "sampled")
