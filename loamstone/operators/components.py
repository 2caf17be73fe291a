"""Connected components of an edge list, by alternating star contraction.

Each round joins nothing: edges are grouped by node and reattached to the group's smallest node.
The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.scale import materialize, salt_of


SALTS = 32


def _with_least(edges: DataFrame, extra) -> DataFrame:
    """``edges`` with _least, the smallest ``dst`` of each ``src`` (``extra`` may add the src itself).

    What a node's edges are told is one row for each (node, salt) that occurs: a hub's edges are
    spread over all salts, and a node of one edge has one.
    """
    salted = edges.withColumn("_salt", salt_of(F.col("dst"), SALTS))
    per_salt = salted.groupBy("src", "_salt").agg(F.min("dst").alias("_m"))
    least = per_salt.groupBy("src").agg(F.min("_m").alias("_m"), F.collect_list("_salt").alias("_salts"))
    told = least.select("src", extra(F.col("_m")).alias("_least"), F.explode("_salts").alias("_salt"))
    return salted.join(told, ["src", "_salt"]).drop("_salt")


def _large_star(edges: DataFrame) -> DataFrame:
    """Reattach each node's larger neighbours to the smallest of the node and its neighbours."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    told = _with_least(both, lambda least: F.least(least, F.col("src"))).where("dst > src")
    return told.select(F.col("dst").alias("src"), F.col("_least").alias("dst")).where("src <> dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Reattach each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    joined = _with_least(down, lambda least: least)
    return (
        joined.select(F.col("dst").alias("src"), F.col("_least").alias("dst"))
        .unionByName(joined.select("src", F.col("_least").alias("dst")))
        .where("src <> dst")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node) for every node of ``edges`` (src, dst).

    An empty edge list has no components; loops and repeated edges don't matter; NULL ends are
    left out.
    """
    now = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    nodes = now.select(F.col("src").alias("node")).unionByName(now.select(F.col("dst").alias("node"))).distinct()
    last = None
    while True:
        now = materialize(_small_star(_large_star(now)), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if last == tuple(mark):
            break
        last = tuple(mark)
    return nodes.join(now.select(F.col("src").alias("node"), F.col("dst").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
