"""Connected components of a graph of ids, by alternating stars over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.staging import Stage


def _state(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the edges; equal states mean that nothing changed."""
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node (u > v on every edge) and its smaller neighbours move to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame, stage: Stage, tag: str) -> DataFrame:
    """(node, component) for every node of links (a, b); the component is its least node. Rounds grow with the
    logarithm of a component's diameter; each ends in a written table."""
    pair = F.when(F.col("a") > F.col("b"), F.struct(F.col("a").alias("u"), F.col("b").alias("v"))).otherwise(F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = stage.write(links.filter("a <> b").select(pair.alias("p")).select("p.u", "p.v").distinct(), f"{tag}-0")
    state, k = _state(edges), 0
    while state[0]:
        k += 1
        edges = stage.write(_small_star(_large_star(edges)), f"{tag}-{k}")
        stage.drop(f"{tag}-{k - 1}")
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
