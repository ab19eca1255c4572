"""Costs, budgets and circuit breakers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import dims
from . import prefix


def with_engine_cost(df: DataFrame, engines: DataFrame) -> DataFrame:
    """Adds ``engine_cost``: the engine's cost of a page, 0 if it is not known."""
    costs = F.broadcast(engines.select("engine", F.col("cost").alias("_c")))
    return df.join(costs, "engine", "left").withColumn("engine_cost", F.coalesce("_c", F.lit(0.0))).drop("_c")


def token_rate(model: Column, provider: str) -> tuple[Column, Column]:
    """Rates in and out: those of the first table row whose name the model's name contains."""
    in_rate, out_rate = (F.lit(x) for x in dims.DEFAULT_RATES[provider])
    for name, i, o in reversed(dims.TOKEN_RATES[provider]):
        hit = F.contains(F.lower(model), F.lit(name))
        in_rate, out_rate = F.when(hit, i).otherwise(in_rate), F.when(hit, o).otherwise(out_rate)
    return in_rate, out_rate


def token_cost(model: Column, provider: str, tokens_in: Column, tokens_out: Column, from_chars: bool = False) -> Column:
    """USD for tokens; with ``from_chars`` the numbers are characters, four to a token."""
    if from_chars:
        tokens_in, tokens_out = F.floor(tokens_in / 4), F.floor(tokens_out / 4)
    i, o = token_rate(model, provider)
    return tokens_in / 1e6 * i + tokens_out / 1e6 * o


def rates_join(df: DataFrame, rates: DataFrame, model: str = "model") -> DataFrame:
    """The same choice as a join, for rate tables that are data: first match by ``ord``, one shuffle-free pass."""
    listed = F.broadcast(rates.agg(F.array_sort(F.collect_list(F.struct("ord", "prefix", "in_rate", "out_rate"))).alias("_r")))
    first = F.get(F.filter("_r", lambda r: F.contains(F.lower(F.col(model)), r["prefix"])), 0)
    return df.join(listed, F.lit(True), "left").withColumns({"in_rate": first["in_rate"], "out_rate": first["out_rate"]}).drop("_r")


def admit_constant(df: DataFrame, cap: float | None, cost: float, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``admitted`` for calls of one cost: the first floor(cap / cost) calls of each group in order.

    The running total is a window over each group; a single budget over everything can be dealt
    to groups beforehand, so no window needs all rows in one task."""
    if cap is None:
        return df.withColumn("admitted", F.lit(True))
    n = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("admitted", n * F.lit(cost) <= F.lit(cap))


def admit_variable(df: DataFrame, cap: float, group: list[str], seq: str, estimate: str, actual: str) -> DataFrame:
    """(group, seq, admitted, spent) for each call: admitted if spent + estimate <= cap; refused calls spend nothing.

    Refusals make this no running sum: each group's calls are folded in order. Groups are parted
    and sorted by Spark and then streamed, so no group is ever held in memory."""
    d = df.select(*group, F.col(seq).alias("seq"), F.col(estimate).cast("double").alias("_e"), F.col(actual).cast("double").alias("_a"))
    out = d.drop("_e", "_a").withColumns({"admitted": F.lit(True), "spent": F.lit(0.0)}).schema

    def fold(batches):
        key, spent = None, 0.0
        for b in batches:
            rows = zip(*(b[g].to_pylist() for g in group), strict=True)
            admitted, total = [], []
            for k, e, a in zip(rows, b["_e"].to_pylist(), b["_a"].to_pylist(), strict=True):
                if k != key:
                    key, spent = k, 0.0
                ok = spent + e <= cap
                spent += a if ok else 0.0
                admitted.append(ok)
                total.append(spent)
            yield pa.RecordBatch.from_arrays([*(b[g] for g in group), b["seq"], pa.array(admitted, pa.bool_()), pa.array(total, pa.float64())], names=[*group, "seq", "admitted", "spent"])

    return d.repartition(*group).sortWithinPartitions(*group, "seq").mapInArrow(fold, out)


def admit_run(df: DataFrame, cap: float, order: list[str], estimate: str, actual: str, parts: int | None = None, unit: float = 1e-6) -> DataFrame:
    """``df`` with ``admitted`` and ``spent`` (this call included) under one cap for the whole run, in order.

    A call is admitted if spent + estimate <= cap; refused ones spend nothing. Seen from what was spent before it, a
    range of calls is a function; two of its values are known from sums alone: if even its highest point (the greatest of
    what is spent so far and the next estimate) stays under the cap, the whole range is admitted, and calls whose
    estimate exceeds what is left are refused, however it goes on. So all ranges add up in parallel, and only one in
    which a call that was affordable at its beginning is refused is folded call by call, by one task that streams it.
    After that, the ranges behind it add up again, without the calls that can no longer be afforded. With few different
    estimates that happens a few times; it cannot happen more often than there are ranges.

    Costs are whole numbers of ``unit``; null and negative ones count as 0. Equal orders are to be told apart by
    ``order``'s last columns. The driver holds a few numbers a range."""
    micro = lambda c: F.greatest(F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / unit), F.lit(0.0)).cast("long")
    limit = round(cap / unit)
    d = prefix.ranges(df.withColumns({"_e": micro(estimate), "_a": micro(actual)}), order, parts)
    count = [r["_part"] for r in d.select("_part").distinct().collect()]
    steps = {p: [] for p in count}  # of a range: from which call on how much was left, as far as refusals tell
    spent, done = 0, -1
    while done < max(count, default=-1):
        left = limit - spent
        before = F.coalesce(F.sum("_a").over(W.partitionBy("_part").orderBy("_k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        open_ = d.filter((F.col("_part") > done) & (F.col("_e") <= left))
        sums = {r["_part"]: r for r in open_.withColumn("_top", before + F.col("_e")).groupBy("_part").agg(F.sum("_a").alias("total"), F.max("_top").alias("top")).collect()}
        folded = None
        for p in sorted(q for q in count if q > done):
            steps[p].append((0, left))
            if p in sums and spent + sums[p]["top"] > limit:
                folded = p
                break
            spent += sums[p]["total"] if p in sums else 0
            done = p
        if folded is not None:
            steps[folded], spent = _folded(open_.filter(F.col("_part") == folded), spent, limit, left)
            done = folded
    known = prefix.of_parts(d, {p: ([{"k": k, "left": r} for k, r in v],) for p, v in steps.items()}, "_steps array<struct<k:int,left:long>>")
    left = F.array_max(F.filter("_steps", lambda x: x["k"] <= F.col("_k")))["left"]
    known = known.withColumn("admitted", F.col("_e") <= left).drop("_steps")
    out = prefix.sums_before(known, {"_before": F.when(F.col("admitted"), F.col("_a")).otherwise(0)})
    return out.withColumn("spent", (F.col("_before") + F.when(F.col("admitted"), F.col("_a")).otherwise(0)) * F.lit(unit)).drop("_before", "_e", "_a", "_part", "_k")


def _folded(calls: DataFrame, spent: int, limit: int, left: int) -> tuple[list[tuple[int, int]], int]:
    """One range, call by call: from which calls on less was left than an earlier call's estimate, and what was spent at its end."""

    def fold(batches):
        total, bound, k, r = spent, left, [0], [left]
        for b in batches:
            for place, e, a in zip(b["_k"].to_pylist(), b["_e"].to_pylist(), b["_a"].to_pylist(), strict=True):
                if e > bound:
                    continue
                if total + e <= limit:
                    total += a
                else:
                    bound = limit - total
                    k.append(place), r.append(bound)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(r, pa.int64()), pa.array([total] * len(k), pa.int64())], names=["k", "left", "total"])

    rows = calls.select("_k", "_e", "_a").repartition(1).sortWithinPartitions("_k").mapInArrow(fold, "k int, left long, total long").collect()
    return [(r["k"], r["left"]) for r in rows], rows[0]["total"]


def breaker(df: DataFrame, engine: list[str], order: list[str], failed: str, threshold: int = 5) -> DataFrame:
    """Adds ``failures`` (in a row, this call included) and ``open`` (threshold reached): one success closes."""
    w = W.partitionBy(*engine).orderBy(*order)
    island = F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    d = df.withColumn("_island", island)
    run = F.sum(F.when(F.col(failed), 1).otherwise(0)).over(W.partitionBy(*engine, "_island").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn("failures", run.cast("long")).withColumn("open", F.col("failures") >= threshold).drop("_island")


def remaining(cap: Column, spent: Column) -> Column:
    return F.when(cap.isNotNull(), F.greatest(F.lit(0.0), cap - spent))
