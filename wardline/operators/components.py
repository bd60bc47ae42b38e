"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.skew import MAX_HOT, MIN_HOT_ROWS, most_hot, salted_join
from wardline.session import cut_lineage


def _hubs(degrees: DataFrame, total_rows: int) -> DataFrame | None:
    """Nodes with so many neighbours that their rows must be split; none if the rows of all nodes are too few."""
    if total_rows <= MIN_HOT_ROWS:
        return None
    limit = max(MIN_HOT_ROWS, total_rows // most_hot(degrees.sparkSession, MAX_HOT))
    return degrees.where(F.col("n") > limit).select("node", F.ceil(F.col("n") / limit).cast("int").alias("_salts"))


def large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("near")).unionByName(
        edges.select(F.col("dst").alias("node"), F.col("src").alias("near"))
    )
    stars = both.groupBy("node").agg(F.min("near").alias("low"), F.count("*").alias("n"))
    smallest = stars.select("node", F.least("node", "low").alias("low"))
    joined = salted_join(both, smallest, ["node"], "inner", _hubs(stars, 2 * rows), ["near"])
    return joined.where(F.col("near") > F.col("node")).select(F.col("near").alias("src"), F.col("low").alias("dst"))


def small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("src", "dst").alias("node"), F.least("src", "dst").alias("near"))
    stars = down.groupBy("node").agg(F.min("near").alias("low"), F.count("*").alias("n"))
    smallest = stars.select("node", "low")
    joined = salted_join(down, smallest, ["node"], "inner", _hubs(stars, rows), ["near"])
    near = joined.where(F.col("near") != F.col("low")).select(F.col("near").alias("src"), F.col("low").alias("dst"))
    return near.unionByName(smallest.select(F.col("node").alias("src"), F.col("low").alias("dst")))


def _fingerprint(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("src", "dst").cast("decimal(38,0)")
    row = edges.agg(F.count("*").alias("n"), F.sum(mixed).alias("h")).first()
    return row.n, row.h


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of the edges; the component is its smallest node.

    ``edges`` has two columns src and dst of one orderable type. Each round is
    stored reliably, so lost executors only cost the running round; the driver
    sees one count and one checksum per round.
    """
    pairs = edges.select("src", "dst").where(F.col("src") != F.col("dst"))
    current = cut_lineage(pairs.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    seen = _fingerprint(current)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        current = cut_lineage(small_star(large_star(current, seen[0]).distinct(), seen[0]).distinct())
        now = _fingerprint(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = current.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return members.unionByName(roots)
