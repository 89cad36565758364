"""Connected components of a graph given by its edges, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

MAX_ROUNDS = 100


def _settled(e: DataFrame) -> bool:
    """Whether edges (u, v), v less than u, are stars: every u has one v, and no v is a u."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))
    nodes = e.select(F.explode(ends).alias("_x")).groupBy("_x.node").agg(F.sum("_x.up").alias("up"), F.min("_x.up").alias("least"))
    return nodes.where("up > 1 or up > 0 and least = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (u, v) touches; root is the least node of its component.

    Each round links larger neighbours to the least one (Kiveris et al., 2014), so a chain
    of n edges takes about log n rounds. Minima are summed before the shuffle, and every
    round is written to the shared folder. Rounds end when all edges go to a root, so none is
    made to see that it changes nothing.
    """
    e = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        if _settled(e):
            break
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("_x")).select("_x.*")
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("v"), F.least("u", "_m").alias("m"))
        large = e.join(least, "v").select("u", F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # A row that is its node's least edge stays; of any other, the smaller end goes to the least node.
        e = checkpoint(large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct())
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
