"""Mixing sources to target weights: iterative proportional fitting, then sampling, in DataFrame operations only.

Documents are summed to cells (source, language, topic). Raking scales the cells' shares of tokens to the targets of one
dimension after the other, round after round, until all three marginals hold. A document's expected number of copies is the
budget times its cell's share over the tokens of the cell; the whole part is given to each document, the rest by a draw that
depends only on the id and the seed. Where documents are drawn once each, no expected number may exceed 1: a full cell stays
full, and what it cannot give comes from the other cells of its source, language or topic.

The share of a cell is its tokens by a factor of its source and one of its kind (language and topic). Sources may be millions, so
their factors are solved for source by source in Spark, and what a round shuffles is a sum for each kind, combined before the
shuffle. Kinds are few, and checked to be: the driver holds a number for each, and scales these to languages and topics.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import bounded, stage
from parley.llm.profile import kept_columns

DIMENSIONS = ("source", "lang", "topic")
#: Pairs of language and topic that the driver may hold.
MOST_KINDS = 20_000
#: With a bound: the most that factors differ by, however far targets are out of reach.
SPREAD = 1e5
#: With a bound: rounds without coming nearer to the targets, after which no more are tried.
IDLE = 3


def token_weight(text: Column) -> Column:
    """About four characters to a token; 1 for a null or empty text."""
    return F.greatest(F.lit(1), F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by the form of a text: tabular, numeric or prose."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.contains(" | "), "tabular").when(text.rlike("[0-9]"), "numeric").otherwise("prose")


def targets(values: DataFrame, dimension: str, wanted: Mapping[str, float] | None, temper: float) -> DataFrame:
    """``values`` (dimension, own: their shares) with target, of sum 1: ``wanted`` among the values that occur, or their own shares
    to the power ``temper``. Values that ``wanted`` leaves out keep their own share."""
    if wanted is None:
        raw = F.pow("own", F.lit(temper))
    else:
        given = F.lit(None).cast("double")
        for value, weight in wanted.items():
            given = F.when(F.col(dimension) == value, F.lit(float(weight))).otherwise(given)
        raw = F.coalesce(given, F.col("own"))
    return values.withColumn("target", raw / F.lit(float(values.agg(F.sum(raw)).first()[0])))


def within_reach(goals: DataFrame, budget: float) -> DataFrame:
    """Targets that ``own`` can give at ``budget`` without repeats: those beyond are lowered to it, the others raised by one factor."""
    bound, by = F.col("own") / budget, 1.0
    while True:
        full = F.col("target") * by >= bound
        held, free = goals.agg(F.sum(F.when(full, bound).otherwise(0.0)), F.sum(F.when(~full, F.col("target")).otherwise(0.0))).first()
        more = (1.0 - held) / free if free > 0 else by
        if more <= by * (1 + 1e-12):
            return goals.withColumn("target", F.least(F.col("target") * by, bound))
        by = more  # it only rises, and each rise fills at least one value more


def _shares(by_source: DataFrame, factors: list[float], budget: float | None) -> DataFrame:
    """(source, kind, share) of each cell by the kinds' ``factors`` and the factor of each source that meets its target.

    Without a bound that is the target over the sum of own * by. With one, cells fill up in the order of their kinds' factors: the
    cells are taken from the largest factor on, and each that the source's factor would overfill gives what it has.
    """
    by = F.from_json(F.lit(json.dumps(factors)), "array<double>")  # folded to one constant
    placed = by_source.withColumn("cells", F.sort_array(F.transform("cells", lambda c: F.struct(F.get(by, c["kind"]).alias("by"), c["own"].alias("own"), c["kind"].alias("kind"))), asc=False))
    free = F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["own"] * c["by"])
    if budget is None:
        placed = placed.withColumn("factor", F.coalesce(F.try_divide("target", free), F.lit(0.0)))
        share = F.col("c.own") * F.col("c.by") * F.col("factor")
    else:
        most = F.lit(1.0 / budget)
        start = F.struct(F.lit(0.0).alias("held"), free.alias("free"), F.lit(0).alias("full"))

        def filled(s: Column, c: Column) -> Column:
            full = (F.col("target") - s["held"]) * c["by"] >= most * s["free"]
            more = F.struct((s["held"] + most * c["own"]).alias("held"), (s["free"] - c["own"] * c["by"]).alias("free"), (s["full"] + 1).alias("full"))
            return F.when(full, more).otherwise(s)

        placed = placed.withColumn("s", F.aggregate("cells", start, filled))
        # summed again, since little is left of a difference where most cells are full
        rest = F.aggregate(F.slice("cells", F.col("s.full") + 1, F.size("cells")), F.lit(0.0), lambda s, c: s + c["own"] * c["by"])
        placed = placed.withColumn("rest", rest)
        placed = placed.withColumn("factor", F.when(F.col("rest") > 0, F.greatest(F.lit(0.0), F.col("target") - F.col("s.held")) / F.col("rest")).otherwise(F.lit(1e300)))
        share = F.col("c.own") * F.least(most, F.col("c.by") * F.col("factor"))
    placed = placed.select("source", "factor", F.explode("cells").alias("c"))
    return placed.select("source", "c.kind", share.alias("share"))


def rake(cells: DataFrame, wanted: Mapping[str, Mapping[str, float] | None], *, budget: float | None = None, temper: float = 0.5, rounds: int = 24, tolerance: float = 1e-12) -> tuple[DataFrame, float]:
    """``cells`` (source, lang, topic, tokens) with ``share``: the calibrated share of each cell; and the largest change that the
    last round made to a factor of a kind.

    A round scales to the sources, the languages and the topics; sources come once more at the end, so their marginals hold, the
    others as near as the rounds bring them. Rounds end once the change is below ``tolerance``, after ``rounds`` at most. Cells
    without tokens do not occur. With ``budget`` no share exceeds the cell's own share of all tokens over the budget; as targets may
    be out of reach together, the round that comes nearest to those of languages and topics counts.
    """
    kinds = cells.select("lang", "topic").distinct().limit(MOST_KINDS + 1).collect()
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} pairs of language and topic")
    if not kinds:
        return cells.select(*DIMENSIONS, F.lit(0.0).alias("share")), 0.0
    kinds = sorted((k["lang"], k["topic"]) for k in kinds)
    # An Arrow table, as Spark has a list of rows read by Python workers of a kind of their own, which then stay beside the others.
    numbers = pa.table({"lang": pa.array([k for k, _ in kinds], pa.string()), "topic": pa.array([k for _, k in kinds], pa.string()), "kind": pa.array(range(len(kinds)), pa.int32())})
    numbers = cells.sparkSession.createDataFrame(numbers)
    own = F.col("tokens") / F.lit(float(cells.agg(F.sum("tokens")).first()[0]))
    goals = {}
    for d in DIMENSIONS:
        goals[d] = stage(targets(cells.groupBy(d).agg(F.sum("tokens").alias("tokens")).select(d, own.alias("own")), d, wanted.get(d), temper), "goals")
        if budget is not None:
            goals[d] = within_reach(goals[d], budget)
    by_source = cells.join(F.broadcast(numbers), ["lang", "topic"]).groupBy("source").agg(F.collect_list(F.struct("kind", own.alias("own"))).alias("cells"))
    by_source = stage(by_source.join(goals["source"].select("source", "target"), "source"), "by_source")
    goals = {d: {r[d]: r["target"] for r in goals[d].select(d, "target").collect()} for d in ("lang", "topic")}
    factors, moved = [1.0] * len(kinds), 0.0
    best, idle = (float("inf"), factors), 0
    for _ in range(rounds):
        sums = {r["kind"]: r["sum"] for r in _shares(by_source, factors, budget).groupBy("kind").agg(F.sum("share").alias("sum")).collect()}
        off = 0.0
        for at, d in enumerate(("lang", "topic")):
            short = dict(goals[d])
            for i, k in enumerate(kinds):
                short[k[at]] -= sums[i]
            off += sum(map(abs, short.values()))
        if budget is not None and off > best[0] * (1 - 1e-3) + 1e-12:
            idle += 1
        else:
            idle = 0
        best = min(best, (off, factors), key=lambda x: x[0])
        if idle >= IDLE:
            break
        up = [1.0] * len(kinds)
        for at, d in enumerate(("lang", "topic")):
            held = dict.fromkeys(goals[d], 0.0)
            for i, k in enumerate(kinds):
                held[k[at]] += sums[i] * up[i]
            up = [u * (goals[d][k[at]] / held[k[at]] if held[k[at]] > 0 else 1.0) for u, k in zip(up, kinds, strict=True)]
        factors = [f * u for f, u in zip(factors, up, strict=True)]
        if budget is not None:  # the sources' factors make up for a common one; out of reach, factors would part for ever
            factors = [max(f / max(factors), 1 / SPREAD) for f in factors]
        moved = max(abs(u - 1) for u in up)
        if moved < tolerance:
            break
    found = _shares(by_source, factors if budget is None else best[1], budget).join(F.broadcast(numbers), "kind")
    return found.select(*DIMENSIONS, "share"), moved


def draw(doc_id: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends only on the id and the seed; 32 bits of MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def mix(
    docs: DataFrame,
    wanted: Mapping[str, Mapping[str, float] | None],
    *,
    budget: float = 0.5,
    seed: int = 11,
    temper: float = 0.5,
    rounds: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens_col: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, lang, topic, tokens, share (of the cell), expected and copies, a row for each row; or, with ``keep``, these
    columns of the rows that are drawn, once each: then no rate is above 1, and full cells leave their excess to the others. The
    budget (up to 1) stays: a value with fewer tokens than its target asks for gives all that it has.

    ``wanted`` maps source, lang and topic to target weights; None tempers the shares that the values have (power ``temper``).
    ``budget`` is the number of tokens to draw, as a share of those there are. copies may be 0, or more than 1 where a cell must
    be repeated. ``tokens_col`` names a column of token counts, such as an exact tokenizer's; without it four characters make a
    token. Null counts, and null and empty texts, weigh one token. Null sources and languages count as the value ''. Rows that
    repeat an id get the same draw; ids may be null. Columns other than id, text, source, lang, tokens and ``keep`` are not read and
    may have any name. Texts of any length are weighed whole. An empty table gives an empty result.
    """
    if budget <= 0 or (keep and budget > 1):
        raise ValueError("the budget is positive, and 1 at most where rows are drawn once")
    there, back = kept_columns(docs, keep)
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    weight = F.greatest(F.lit(1).cast("long"), F.coalesce(F.col(tokens_col).cast("long"), F.lit(1).cast("long"))) if tokens_col else token_weight(F.col(text_col))
    found = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        fill("source").alias("source"),
        fill("lang").alias("lang"),
        topic_of(F.col(text_col)).alias("topic"),
        weight.alias("tokens"),
        *there,
    )
    cells = stage(found.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "sums")
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shares, _ = rake(cells, wanted, budget=budget if keep else None, temper=temper, rounds=rounds)
    rate = F.col("share") * F.lit(budget * total) / F.col("tokens")
    rates = cells.join(bounded(shares), list(DIMENSIONS)).select(*DIMENSIONS, "share", (F.least(F.lit(1.0), rate) if keep else rate).alias("rate"))
    placed = found.join(bounded(stage(rates, "rates")), list(DIMENSIONS))
    whole = F.floor("rate")
    copies = (whole + (draw(F.col("doc_id"), seed) < F.col("rate") - whole).cast("long")).alias("copies")
    found = placed.select("doc_id", *DIMENSIONS, "tokens", "share", F.col("rate").alias("expected"), copies, *[f"keep_{i}" for i in range(len(keep))])
    return found.where("copies > 0").select(*back) if keep else found
