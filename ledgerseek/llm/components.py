"""Connected components of a link table, by hook-and-compress union-find in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``links(a long, b long)`` -> ``(node long, component long)`` for every node in a link; component = smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each round is two
    aggregations by node with partial minima before the shuffle, and a written table cuts
    the lineage; nothing is gathered on the driver but one count a round.  An empty link
    table gives no rows; loops and repeated links change nothing.
    """
    edges = scratch.put(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    round_ = 0
    while True:
        # large star: every larger neighbour of u links to u's smallest neighbour (or u)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # (written, so that the join has an exchange on either side and a hub's rows can be split)
        low = scratch.put(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), f"{name}-low-{round_}")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours link to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        small = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        round_ += 1
        new = scratch.put(small, f"{name}-{round_}")
        # done when every node has one link and no target has a link of its own
        state = new.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        loose = state.where("n > 1").limit(1).count() or new.select(F.col("v").alias("u")).join(new.select("u"), "u", "left_semi").limit(1).count()
        scratch.drop(f"{name}-{round_ - 1}", f"{name}-low-{round_ - 1}")
        edges = new
        if not loose:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
