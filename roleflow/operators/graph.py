"""Connected components of an edge table by repeated minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roleflow.session import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """One row ``(node, component)`` for each node that has an edge; ``component`` is the smallest node it can reach.

    Edges are undirected; self loops, repeated edges and edges with a null end are ignored.
    Each round replaces every edge by one to the smaller end's label (large star, then small
    star), so a chain of length n needs about log n rounds. The aggregates are partial before
    their shuffle, so a node with very many neighbours is no hot group, and only the
    count of changed edges reaches the driver.
    """
    a, b = F.col(src), F.col(dst)
    links = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u is not null and v is not null and u <> v and u = u and v = v")
        .distinct()
    )
    links = cut(links)
    nodes = cut(links.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    before = None
    while True:
        links = cut(_small_star(_large_star(links)))
        # The sums identify the set of edges: it stops changing once every component is a star.
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(stars, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(low, "u")
    own = low.select("u", F.col("m").alias("v"))
    rest = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(rest).distinct()
