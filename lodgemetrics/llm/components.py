"""Connected components of a link table by alternating large and small stars, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodgemetrics.llm.shared import drop_staged, measured, staged


def _written(edges: DataFrame, tag: str) -> tuple[DataFrame, dict]:
    """The staged edges, and their number and the sum of their hashes."""
    return measured(edges, tag, n=F.count("*"), total=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (least node reachable) of every node that has a link to another; both ends are long.

    Each round is written to the shared folder. Links to a node's least neighbour replace its links, so rounds grow
    with the logarithm of a component's width. Repeated links, links to oneself and null ends change nothing.
    Both stars are written, so that no plan holds a table more than twice: driver memory follows the size of plans.
    """
    edges, seen = _written(links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter(
        (F.col("u") < F.col("v")) & F.col(a).isNotNull() & F.col(b).isNotNull()).distinct(), "links")
    while seen["n"]:
        # large star: every larger neighbour goes to the least of the neighbourhood
        turned = F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
        both = edges.select(F.explode(F.array(F.struct("u", "v"), turned)).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = staged(both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v").distinct(), "large")
        drop_staged(edges)
        # small star: the smaller neighbours and the node itself go to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")) \
            .filter("u < v").distinct()
        edges, now = _written(small, "stars")
        drop_staged(large)
        if now == seen:
            break
        seen = now
    return edges.select(F.explode(F.array("u", "v")).alias("node"), F.col("u").alias("component")).distinct()
