"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, removed, written

#: A node is hot if it has more than this many links, and more than 2 / HOT_NODES of them all: there are HOT_NODES such at most.
HOT_LINKS, HOT_NODES = 1000, 4096


def spread_join(rows: DataFrame, keys: DataFrame, key: str, hot: Column) -> DataFrame:
    """rows joined with keys, a table of one row for each value of ``key``. Those that are hot are broadcast, so that their rows
    stay where they are; the caller knows how many they are at most."""
    others = [c for c in keys.columns if c != key]
    few = F.broadcast(keys.where(hot).select(key, F.struct(*others).alias("few")))
    stay = rows.join(few, key).select(*rows.columns, "few.*")
    move = rows.join(few, key, "left").where("few IS NULL").drop("few").join(keys.where(~hot), key)
    return stay.unionByName(move)


def _star(edges: DataFrame, large: bool, hot: int | None) -> DataFrame:
    """edges: (a, b). Large: every node hands its least neighbour to its larger ones; small: to its smaller ones and itself."""
    sides = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*") if large else edges
    least = sides.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("links")).select("a", F.least("a", "least").alias("least"), "links")
    # A node with a third of all links is hot: its links don't meet in one task.
    met = (sides.join(least, "a") if hot is None else spread_join(sides, least, "a", F.col("links") > hot)).drop("links")
    if large:
        return met.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
    return met.select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple[int, int, bool]:
    """How many links there are, how many the node of most has, and whether every node hangs on a root alone."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("links"))
    # A node that hangs on two, or on one while others hang on it, isn't done.
    r = nodes.agg(F.sum("up").alias("n"), F.max("links").alias("most"), F.max((F.col("up") > 0) & (F.col("links") > 1)).alias("open")).first()
    return r.n or 0, r.most or 0, not r.open


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root): the least node reachable from each node of links (a, b), two long columns. Loops give no row."""
    spark = links.sparkSession
    path = new_path(spark, "links")
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", path)
    for _ in range(most_rounds):
        n, most, done = _state(edges)
        if done:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        hot = max(HOT_LINKS, 2 * n // HOT_NODES)
        hot = hot if most > hot else None
        old, path = path, new_path(spark, "stars")
        edges = written(_star(_star(edges, True, hot), False, hot), "stars", path)
        removed(spark, [old])
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def with_roots(found: DataFrame) -> DataFrame:
    """components with a row for each root, too."""
    return found.unionByName(found.select("root").distinct().select(F.col("root").alias("node"), "root"))
