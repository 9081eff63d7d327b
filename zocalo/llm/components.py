"""Connected components of a link table by hooking to the smallest neighbour and shortening paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zocalo.llm.frames import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b long); root is the smallest node of its component.

    Large-star and small-star in turn: each round points all neighbours of a node at the smallest of them, first the
    larger ones, then the smaller. Groups are only ever aggregated to their minimum, so a node with very many
    links is no hot task beyond its join rows, which Spark may split. Each round is written to the shared folder.
    """
    edges = stored(links.where(F.col("a") != F.col("b")), "links")
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = stored(small.select("e.a", "e.b").where("a <> b").distinct(), "links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("mark")).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
