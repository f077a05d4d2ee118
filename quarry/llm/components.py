"""Connected components of a link table by least labels with shortcuts, each round in a written table that goes when the
next one is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop, write


def components(links: DataFrame, tag: str = "labels") -> DataFrame:
    """node, component (the least node reachable) of every node that has a link. links: a, b (long).

    A round gives each node the least label among its neighbours' and its own, then the label of that label. Hubs are
    aggregated partially, and joins read written tables, so Spark can split a hub's rows.
    """
    both = links.select("a", "b").where("a <> b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct()
    spark = links.sparkSession
    edges, edges_path = write(both, f"{tag}-edges")
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    now, path = write(least.select(F.col("a").alias("node"), F.least("a", "m").alias("component")), tag)
    while True:
        of = now.select(F.col("node").alias("b"), F.col("component").alias("_c"))
        seen = edges.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("_c").alias("_m"))
        hooked = now.join(seen, "node").select("node", F.col("component").alias("_old"), F.least("component", "_m").alias("_new"))
        jump = now.select(F.col("node").alias("_new"), F.col("component").alias("_j"))
        after, next_path = write(hooked.join(jump, "_new", "left").select("node", "_old", F.least("_new", "_j").alias("component")), tag)
        drop(spark, path)
        now, path = after.select("node", "component"), next_path
        if after.where("_old <> component").isEmpty():
            drop(spark, edges_path)
            return now
