"""Connected components by alternating large-star and small-star steps: links stay distributed and become stars.

Each step groups by one end with partial aggregation, so a node with a third of all links is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    kept = e.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _is_stars(e: DataFrame) -> bool:
    """Whether each u has one v, which is no u itself: with v < u, every component is a star around its smallest node."""
    ends = e.select("u", F.lit(1).alias("n"), F.lit(0).alias("inner")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("n"), F.lit(1).alias("inner")))
    return ends.groupBy("u").agg(F.sum("n").alias("n"), F.max("inner").alias("inner")).filter("n > 1 or n = 1 and inner = 1").isEmpty()


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, label) for every end of the links (u, v): label is the smallest node reachable. Nulls and loops are left out.

    No links give no rows. Rows are unique by node; nodes without links are not listed. `labels`, what this function gave for
    other links, adds those links: only the links between its components remain to be settled.
    """
    if labels is not None:
        links = links.select("u", "v").unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v")))
    e = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v and u is not null and v is not null").distinct()
    while True:
        e = materialize(_small_star(_large_star(e)), "links")
        if _is_stars(e):
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
