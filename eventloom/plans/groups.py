"""Groups of rows that are linked through shared keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.session import work_folder


def _written(df: DataFrame, name: str) -> DataFrame:
    """Put down in the shared folder, so that a lost executor costs one round at most."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def linked_groups(links: DataFrame, node: str, key: str) -> DataFrame:
    """(node, root) of every node of the links (node, key); root is the least node reached over shared keys.

    Nodes of one key are linked through its least label, never in pairs. Each round takes the least label
    over the keys of a node and then the label of that label, so the rounds grow with the logarithm of
    the longest chain. Keys of a single node drop out first; minima are aggregated before the shuffle, and
    joins on a key that very many nodes share have one row per key on the other side, so they can be split.
    """
    given = links.select(F.col(node).alias("node"), F.col(key).alias("key")).distinct()
    shared = given.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    pairs = _written(given.join(shared, "key"), "group-links")
    roots = _written(pairs.select("node", F.col("node").alias("root")).distinct(), "group-roots")
    before, now = None, (0, 0)
    while now != before:
        before = now
        least = pairs.join(roots, "node").groupBy("key").agg(F.min("root").alias("root"))
        lower = pairs.join(least, "key").groupBy("node").agg(F.min("root").alias("root"))
        of_root = roots.select(F.col("node").alias("root"), F.col("root").alias("further"))
        roots = _written(
            lower.join(of_root, "root", "left").select("node", F.least("root", "further").alias("root")), "group-roots"
        )
        row = roots.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")).alias("h")).first()
        now = (row["n"], row["h"])
    alone = given.select("node").distinct().join(roots.select("node"), "node", "left_anti")
    return roots.unionByName(alone.select("node", F.col("node").alias("root")))
