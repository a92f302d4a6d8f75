"""Connected components over links in a table, by alternating star contraction.

Large stars and small stars (Kiveris et al., "Connected Components in MapReduce and Beyond",
2014) turn the links into stars around the smallest id.  A node's neighbours never meet in one
task: the smallest is found by an aggregation that combines before the shuffle, and joined back.
Each round is staged, so a lost executor costs no more than a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage


def _down(links: DataFrame) -> DataFrame:
    """Links from the larger to the smaller id, once each."""
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``u`` and ``v``: for each id that is not its component's smallest, that smallest id."""
    stars = stage(_down(links), "links")
    seen = None
    while True:
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return stars
        seen = state
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = _down(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = stage(_down(small.union(least.select("u", F.col("m").alias("v")))), "links")
