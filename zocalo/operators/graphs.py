"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zocalo.session import run_dir


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that rounds do not pile up lineage."""
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); root is the least node that can be reached.

    Each round a node takes the least label among its own and its neighbours', and then the label of that label, so long
    chains shrink fast.  Labels only ever meet as minima, so a node with very many links is no hot group.
    """
    edges = kept(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = kept(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        known = labels.select(F.col("node").alias("b"), F.col("root").alias("_near"))
        least = edges.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("_near").alias("_near"))
        met = labels.join(least, "node").select("node", "root", F.least("root", "_near").alias("_to"))
        onward = labels.select(F.col("node").alias("_to"), F.col("root").alias("_on"))
        moved = kept(met.join(onward, "_to").select("node", F.col("root").alias("_was"), F.least("_to", "_on").alias("root")), "labels")
        done = moved.filter(F.col("_was") != F.col("root")).limit(1).count() == 0
        labels = moved.drop("_was")
        if done:
            return labels
