"""Mixing sources to target weights by temperature.

Weights are the sources' token shares raised to an exponent and normalised. The exponent is bisected until the
weights have the wanted entropy, or no source repeats more often than allowed. A budget of tokens is then
dealt out by the weights: each source passes whole permutations of its documents while they fit, and the last
pass stops where its budget is used up. A permutation is cut into blocks by the documents' hash, so its running
sum needs block totals and one block only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallymark.llm.arrow import free_names
from tallymark.session import broadcast_if_small, durable

GRID = 32
ROUNDS = 5
BLOCK_DOCS = 1024
_HASH_RANGE = 1 << 32


def token_count(text: Column) -> Column:
    """Words without ASCII white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw_key(doc_id: Column, seed: int = 0) -> Column:
    """The place of a document in its source's permutation; equal doc_ids share a place."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_totals(tokens: DataFrame) -> DataFrame:
    """``source, tokens, docs, share`` of every source, null being one of its own. Sources without tokens have share 0."""
    totals = tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    whole = Window.partitionBy()  # over one row per source
    return totals.withColumn("share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(whole).cast("double")), F.lit(0.0)))


def temperature(totals: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None) -> float:
    """The exponent in [0, 1] that the targets ask for; 1 without any.

    ``target_entropy`` is a part of the entropy of equal weights: the largest exponent that still has it. With
    ``max_repetition``, no source is wanted more than so many times its share: the smallest exponent that keeps
    to it, or the former where that is larger. Both are monotone in the exponent, so a grid of 33 exponents is narrowed
    five times; each round is one aggregate, of which the driver sees a row per exponent.
    """
    exponent = 1.0 if max_repetition is None else 0.0
    if target_entropy is not None:
        n = totals.where("share > 0").count()
        wanted = target_entropy * math.log(n) if n > 1 else 0.0
        exponent = _last_on_grid(totals, lambda row: row["entropy"] >= wanted - 1e-12)
    if max_repetition is not None:
        exponent = max(exponent, 1.0 - _last_on_grid(totals, lambda row: row["repetition"] <= max_repetition + 1e-12, falling=True))
    return exponent


def _last_on_grid(totals: DataFrame, holds, falling: bool = False) -> float:
    """The largest x in [0, 1] found for which ``holds``, taking x (or 1 - x when ``falling``) as the exponent; 0 if none."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        steps = [low + (high - low) * k / GRID for k in range(GRID + 1)]
        rows = {r["k"]: r for r in _curve(totals, [1.0 - x if falling else x for x in steps]).collect()}
        last = max((k for k, r in rows.items() if holds(r)), default=0)
        if last == GRID:
            return steps[GRID]
        low, high = steps[last], steps[last + 1]
    return low


def _curve(totals: DataFrame, exponents: list[float]) -> DataFrame:
    """``k, entropy, repetition`` of the weights at each exponent; shares enter by their logarithm."""
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("x")) for k, x in enumerate(exponents)])
    each = totals.where("share > 0").select(F.log("share").alias("l"), F.inline(grid))
    raised = F.exp(F.col("x") * F.col("l"))
    sums = each.groupBy("k", "x").agg(F.sum(raised).alias("z"), F.sum(raised * F.col("x") * F.col("l")).alias("e"), F.max(raised / F.exp("l")).alias("r"))
    return sums.select("k", (F.log("z") - F.col("e") / F.col("z")).alias("entropy"), (F.col("r") / F.col("z")).alias("repetition"))


def weighted(totals: DataFrame, exponent: float) -> DataFrame:
    """``totals`` with ``weight``, which add up to 1 over the sources that have tokens (to nine decimals)."""
    raised = F.when(F.col("share") > 0, F.exp(F.lit(exponent) * F.log("share"))).otherwise(F.lit(0.0))
    return totals.withColumn("weight", F.round(raised / F.sum(raised).over(Window.partitionBy()), 9))


def source_plan(tokens: DataFrame, budget: int | None = None, target_entropy: float | None = None, max_repetition: float | None = None) -> DataFrame:
    """One row per source: ``source, tokens, weight, wanted, passes, cut_key``.

    ``tokens`` has ``source, key, n_tokens``, one row per document. A document is taken ``passes`` times and
    once more when its key is at most ``cut_key``; documents with equal keys go together. Without a ``budget``
    the smallest is taken at which every source with tokens is passed once at least, so no document is lost.
    """
    totals = durable(source_totals(tokens))
    weights = weighted(totals, temperature(totals, target_entropy, max_repetition))
    whole = budget is None
    if whole:
        budget = weights.where("weight > 0").agg(F.max(F.ceil(F.col("tokens") / F.col("weight")))).first()[0] or 0
    wanted = weights.withColumn("wanted", F.ceil(F.round(F.col("weight") * F.lit(budget), 3)).cast("long"))
    if whole:  # a weight may be too small for its nine decimals
        wanted = wanted.withColumn("wanted", F.greatest("wanted", "tokens"))
    passes = F.coalesce(F.expr("try_divide(wanted - wanted % tokens, tokens)"), F.lit(1)).cast("long")
    sources = durable(wanted.withColumn("passes", passes).withColumn("rest", F.col("wanted") - F.col("passes") * F.col("tokens")))

    blocks_of = F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_DOCS))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rests = broadcast_if_small(sources.select("source", "rest", "docs"))
    same = lambda left, right: left["source"].eqNullSafe(right["source"])
    dealt = tokens.join(rests, same(tokens, rests)).select(
        tokens["source"], "key", "n_tokens", "rest", F.expr("0L").alias("zero"), F.floor(place * blocks_of / _HASH_RANGE).alias("block"))
    blocks = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # The block in which the rest runs out: what came before it fits, it does not.
    edges = blocks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).where("base <= rest AND base + n > rest")
    edge_rows = edges.select(F.col("source").alias("s"), F.col("block").alias("b"), "base")
    inside = dealt.join(broadcast_if_small(edge_rows), dealt["source"].eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    running = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("key"))
    fitting = inside.withColumn("run", F.col("base") + running).where("run <= rest")
    last = fitting.groupBy("source").agg(F.max("key").alias("cut_key"))
    lead = dealt.join(broadcast_if_small(edge_rows.select("s", "b")), dealt["source"].eqNullSafe(F.col("s")) & (F.col("block") < F.col("b")))
    ahead = lead.groupBy("source").agg(F.max("key").alias("lead_key"))
    plan = sources.join(last.withColumnRenamed("source", "s1"), F.col("source").eqNullSafe(F.col("s1")), "left")
    plan = plan.join(ahead.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left")
    return plan.select("source", "tokens", "weight", "wanted", "passes", F.greatest("cut_key", "lead_key").alias("cut_key"))


def mix(df: DataFrame, budget: int | None = None, target_entropy: float | None = None, max_repetition: float | None = None,
        seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``df`` with ``_weight`` of their source and ``_copies``: how often each is taken; rows may have 0.

    Where ``df`` has columns of these names, the new ones have more underscores in front, and its own stay.

    The documents themselves are never shuffled: only ids, counts and keys are, and what comes back is one row
    per source. Rows of the same doc_id and source are taken alike. Null sources are a source; null ids share one key.
    """
    own_source, passes, cut_key, weight, copied = free_names(df, "_source", "_passes", "_cut_key", "_weight", "_copies")
    source, key = F.col(f"`{source_col}`").cast("string"), draw_key(F.col(f"`{id_col}`"), seed)
    tokens = durable(df.select(source.alias("source"), key.alias("key"), token_count(F.col(f"`{text_col}`")).alias("n_tokens")))
    plan = source_plan(tokens, budget, target_entropy, max_repetition).select(
        F.col("source").alias(own_source), F.col("passes").alias(passes), F.col("cut_key").alias(cut_key), F.col("weight").alias(weight))
    plan = broadcast_if_small(durable(plan))
    joined = df.join(plan, source.eqNullSafe(F.col(own_source)), "left")
    copies = F.col(passes) + F.coalesce((key <= F.col(cut_key)).cast("long"), F.lit(0))
    return joined.withColumn(copied, copies).drop(own_source, passes, cut_key)


def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` themselves, each as often as ``mix`` takes it, with the columns of ``df`` only."""
    mixed = mix(df, **options)
    copied = F.col(mixed.columns[-1])
    number, = free_names(mixed, "_copy")
    repeated = mixed.where(copied > 0).withColumn(number, F.explode(F.sequence(F.lit(1), copied)))
    return repeated.select(*[F.col(f"`{c}`") for c in df.columns])
