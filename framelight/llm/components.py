"""Connected components by large-star and small-star steps, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """node, root (the smallest node it is linked with, over any path) for each node of ``links`` (a, b).

    Steps go on until the edges are stable: about log2 of the longest path, squared at worst.  Every
    step's edges are written to the shared folder.  Hubs are safe: minima are combined before the
    shuffle and written, and AQE splits the joins on a hub, as nothing in their stage needs a key's rows
    together.
    """
    spread = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.save(spread, f"{name}-0")
    last, k = None, 0
    while True:
        k += 1
        # Large star: a node's larger neighbours move to its smallest neighbour (or itself).
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node's smaller neighbours, and the node, move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(least, F.col("u") == F.col("w"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()
        edges = scratch.save(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if last == mark:
            break
        last = mark
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
