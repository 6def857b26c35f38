"""Connected components over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import scratch_path


def _settle(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that the links (a, b) name; the root is the smallest node reachable.

    A node hooks to its smallest neighbour if that is smaller; pointer jumping flattens the hooks, the
    links move to the roots, and so on until no link joins two roots. Every step is an aggregate
    or an equi-join, and each round at least halves the roots that still have links.
    """
    ends = F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")
    links = _settle(edges.where("a <> b").select(*ends).distinct(), "links")
    roots = None
    while not links.isEmpty():
        hooks = _settle(links.groupBy("src").agg(F.min("dst").alias("dst")), "hooks")
        moved = True
        while moved:
            up = hooks.select(F.col("src").alias("dst"), F.col("dst").alias("up"))
            hooks = _settle(hooks.join(up, "dst", "left").select("src", F.coalesce("up", "dst").alias("dst"), F.col("up").isNotNull().alias("moved")), "hooks")
            moved = not hooks.where("moved").isEmpty()
            hooks = hooks.drop("moved")
        up = hooks.select(F.col("src").alias("old"), F.col("dst").alias("new"))
        moved_on = lambda df, c: df.join(up, F.col(c) == F.col("old"), "left").withColumn(c, F.coalesce("new", c)).drop("old", "new")
        roots = hooks if roots is None else _settle(moved_on(roots, "dst").unionByName(hooks), "roots")
        links = moved_on(moved_on(links, "src"), "dst").where("src <> dst")
        links = _settle(links.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "links")
    if roots is None:
        roots = links
    found = roots.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
