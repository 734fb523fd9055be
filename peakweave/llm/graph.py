"""Connected components of a graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root) for every vertex of an edge; root is the smallest vertex that it is connected with.

    Alternates large-star and small-star steps, each a grouped minimum and a
    join, until the edges stay the same; after that they are stars around the
    roots.  Every step's edges are written to the shared folder.  Vertices are
    numbers; nulls and loops are dropped, repeated edges count once; no edge
    gives no row.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = written(now, "edges")
    state = _state(now)
    while state[0]:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: each larger neighbour is linked with the smallest one.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each vertex and its smaller neighbours are linked with the smallest one.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = written(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        then, state = state, _state(now)
        if then == state:
            break
    roots = now.select("v").distinct().select("v", F.col("v").alias("root"))
    return now.select(F.col("u").alias("v"), F.col("v").alias("root")).unionAll(roots)


def _state(edges: DataFrame) -> tuple:
    """The number of edges and a sum over their hashes."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())
