"""Connected components of a link table, by Spark joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import stored


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: bigint): root is the smallest node reachable.

    Alternating large-star and small-star rounds: a node's neighbours are pointed at its least
    neighbour. Each round is two aggregates of narrow rows, pre-aggregated before they are shuffled;
    no round gathers a node's neighbours in a list, so a node with very many links is no hot group.
    Rounds are written to the shared folder, which cuts the lineage. Stops when a round changes
    nothing; stops with an error after ``rounds``.

    Null ends, loops and repeated links are ignored. An empty table gives an empty table.
    """
    edges = stored(
        links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    state = _state(edges)
    for _ in range(rounds):
        if state[0] == 0:
            break
        edges = stored(_small_star(_large_star(edges)), "links")
        last, state = state, _state(edges)
        if state == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(
        edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Equal for equal edge sets: edges are distinct, and a changed set changes the sum of hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("node").agg(F.min("other").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour (or itself)."""
    both = edges.select(F.col("v").alias("node"), F.col("u").alias("other")).union(
        edges.select(F.col("u").alias("node"), F.col("v").alias("other")))
    least = _least(both).select("node", F.least("node", "least").alias("least"))
    larger = edges.select(F.col("u").alias("node"), F.col("v").alias("other"))
    return larger.join(least, "node").select(F.col("other").alias("v"), F.col("least").alias("u")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to its least neighbour."""
    least = _least(edges.select(F.col("v").alias("node"), F.col("u").alias("other")))
    moved = edges.select(F.col("v").alias("node"), F.col("u").alias("other")).join(least, "node")
    return (
        moved.where(F.col("other") != F.col("least")).select(F.col("other").alias("v"), F.col("least").alias("u"))
        .union(least.select(F.col("node").alias("v"), F.col("least").alias("u"))).distinct()
    )
