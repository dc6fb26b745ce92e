"""Connected components of links that are too many for one machine, by alternating star contractions.

In a large-star step every node hands its larger neighbours to the smallest node that it knows; in a small-star step
its smaller ones. Links stay as many as they were or fewer, and after some steps, about the logarithm of the longest
path, each node is linked with the smallest of its component alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(links: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """node and component (its smallest node) of every node that has a link; links: columns a and b, two nodes."""
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now, step = work.stage(links.where("a <> b").select(u, v).distinct(), f"{name}-0"), 0
    mark = _mark(now)
    while True:
        step += 1
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = work.stage(moved.union(small.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{step}")
        work.drop(f"{name}-{step - 1}")
        before, mark, now = mark, _mark(after), after
        if mark == before:
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _mark(links: DataFrame) -> tuple:
    """A number of rows and a sum of hashes; equal for equal sets of links."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
