"""Connected components of links, as joins and groupings of the links themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import written

#: At most so many nodes count as hubs and are joined by broadcast: those with more than 1 / HUBS of the links' ends.
HUBS = 10_000


def _with_least(links: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """links (a, b) with m of their a: hubs, of which there are few, by broadcast, so that no task gets all links of one."""
    few = F.broadcast(least.where(F.col("n") > hub).select("a", F.col("m").alias("hub_m")))
    marked = links.join(few, "a", "left")
    often = marked.where("hub_m IS NOT NULL").select("a", "b", F.col("hub_m").alias("m"))
    return often.union(marked.where("hub_m IS NULL").select("a", "b").join(least.where(F.col("n") <= hub).select("a", "m"), "a"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link to another; component is its least node.

    Alternates large-star and small-star steps (Kiveris and others): every node
    ties its greater neighbours to its least one, then its smaller ones.  A hub
    is never gathered: a step is a minimum per node, in each task first, joined
    back to the links.
    """
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    links = written(links, "links")
    seen = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b"), F.col("b")).distinct())
        seen = now
        hub = max(100, 2 * now[0] // HUBS)
        both = links.union(links.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _with_least(both, least, hub).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, least, hub)
        links = written(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).distinct(), "links")


def merged(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of links on top of known ones (node, component): only the components that a link joins are worked on.

    Labels are least nodes again; nodes that neither has are left out.
    """
    if known is None:
        return written(components(links), "components")
    of = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("a_of", "a").alias("x"), F.coalesce("b_of", "b").alias("y"))
    ends = written(ends, "joined")
    up = written(components(ends.select("x", "y"), "x", "y").select(F.col("node").alias("component"), F.col("component").alias("top")), "contracted")
    nodes = known.union(ends.select("a", F.col("x"))).union(ends.select("b", F.col("y"))).distinct()
    return written(nodes.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "components")
