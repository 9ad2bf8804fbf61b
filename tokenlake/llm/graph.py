"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stable


def components(edges: DataFrame) -> DataFrame:
    """``(u, root)`` of every node with an edge but the roots; the root is the smallest node of the component.

    ``edges`` has the columns ``u`` and ``v`` of one orderable type.  The rounds
    alternate large stars and small stars (Kiveris et al., 2014): each node
    links its larger neighbours, then its smaller ones, to the smallest node
    it knows.  Every round is written to the shared folder; the rounds end, with
    stars around the roots, when one changes nothing.
    """
    e = stable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = Window.partitionBy("u")
        large = both.withColumn("m", F.least("u", F.min("v").over(near))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        down = large.distinct().withColumn("m", F.min("v").over(near))
        small = down.select("u", F.col("m").alias("v")).union(down.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        e = stable(small)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select("u", F.col("v").alias("root"))
        before = now
