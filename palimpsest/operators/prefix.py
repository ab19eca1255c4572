"""Running sums over a whole table in order, without a window that holds it.

Rows are dealt to ranges of the order; each range adds up its own rows, the ranges' totals (one row a range) give each
range its offset, and the running sum is the offset plus a window within the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import scratch


def ranges(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``_part``, the range of the order that a row is in, and ``_k``, its place there from 1 on; written once."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.materialise(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    return scratch.materialise(dealt.withColumn("_k", F.row_number().over(W.partitionBy("_part").orderBy(*order))), "ranges")


def of_parts(df: DataFrame, table: dict[int, tuple], columns: str) -> DataFrame:
    """``df`` with columns known by ``_part``: one row a range, which is broadcast."""
    known = df.sparkSession.createDataFrame([(p, *v) for p, v in sorted(table.items())], f"_part int, {columns}")
    return df.join(F.broadcast(known), "_part")


def sums_before(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``df`` (with ``_part`` and ``_k``) with the sum of each value over all rows before."""
    named = {f"_v{i}": v for i, v in enumerate(values.values())}
    d = df.withColumns(named)
    totals = {r["_part"]: [r[v] or 0 for v in named] for r in d.groupBy("_part").agg(*(F.sum(v).alias(v) for v in named)).collect()}
    offsets, running = {}, [0] * len(named)
    for p in sorted(totals):
        offsets[p] = tuple(running)
        running = [a + b for a, b in zip(running, totals[p], strict=True)]
    here = W.partitionBy("_part").orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    d = of_parts(d, offsets, ", ".join(f"_o{i} long" for i in range(len(named))))
    return d.withColumns({name: F.col(f"_o{i}") + F.coalesce(F.sum(f"_v{i}").over(here), F.lit(0)) for i, name in enumerate(values)}).drop(*named, *(f"_o{i}" for i in range(len(named))))
