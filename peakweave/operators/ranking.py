"""Row numbers over a whole table without one task that sees it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_rank(df: DataFrame, bucket: Column, order: Sequence[str | Column], name: str = "place", first: int = 1) -> DataFrame:
    """Numbers all rows in an order that has no ties.

    bucket: a whole number that never falls along the order, with thousands of
    values at most (coarse() makes one).  Rows are sorted bucket by bucket; only
    the sizes of the buckets are summed in one task and sent to all.
    """
    dealt = df.withColumn("_bucket", bucket)
    sizes = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select("_bucket", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    out = dealt.join(F.broadcast(before), dealt["_bucket"].eqNullSafe(before["_bucket"])).drop(before["_bucket"])
    return out.withColumn(name, F.col("_before") + nth + (first - 1)).drop("_bucket", "_before")


def coarse(x: Column, steps: int = 256) -> Column:
    """A whole number that grows with x: `steps` of them for each doubling of 1 + |x|."""
    return (F.signum(x) * F.floor(F.log2(1 + F.abs(x)) * steps)).cast("long")
