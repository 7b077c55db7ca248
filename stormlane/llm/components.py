"""Connected components of an edge table by alternating star contractions.

Each round replaces every node's links by links to the smallest neighbour, first for the larger neighbours, then for the
smaller ones, until every component is a star around its smallest node. Links are kept once, larger node first, so of a node's
neighbours only the smaller ones decide, and a round never has more rows than it began with. Small tables are scanned by few tasks. Only grouped minima
and equi-joins are used, so a node with very many links is pre-aggregated before the shuffle. Every round ends in a checkpoint,
so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlane.llm.common import checkpointed

MAX_ROUNDS = 60
#: Links that one task scans at least, and links up to which smallest neighbours are broadcast; beyond, both sides are shuffled. The
#: result is the same.
SCAN_ROWS, BROADCAST_ROWS = 10_000, 200_000


def _to_smallest(edges: DataFrame) -> DataFrame:
    """(node, low): the smallest neighbour of each node that has smaller ones."""
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))


def _state(edges: DataFrame) -> tuple[int, bool]:
    """The number of links, and whether they are stars: every node is either some nodes' only smaller neighbour or has just one itself."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("below")), F.struct(F.col("v").alias("node"), F.lit(0).alias("below")))))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.count("*").alias("n"))
    links, odd = nodes.agg(F.sum("below"), F.count_if(F.expr("below > 0 and n > 1"))).first()
    return links or 0, not odd


def _round(edges: DataFrame, sized: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """edges: distinct, u > v."""
    high = edges.join(sized(_to_smallest(edges)), F.col("v") == F.col("node"), "left").select("u", F.coalesce("low", "v").alias("v"))
    starred = high.join(sized(_to_smallest(high)), F.col("u") == F.col("node"))
    # The row with the smallest neighbour stands for the node's own link to it.
    return starred.select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node of its component.

    edges: columns u and v of one comparable type. Links to oneself, repeats, both directions and nulls are allowed; rows
    with a null are no links. An empty table gives an empty result.
    """
    edges = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        n, done = _state(edges)
        few = edges.coalesce(n // SCAN_ROWS + 1)
        if done:
            break
        edges = checkpointed(_round(few, F.broadcast if n <= BROADCAST_ROWS else lambda df: df))
    else:
        raise RuntimeError("the components did not settle")
    return few.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(few.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
