"""Connected components and reachability by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def materialised(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder that the cluster shares; reliable, so lost executors cost nothing."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        sc.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="tabloom-cp-"))
    return df.checkpoint()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest reachable id of each node.  nodes: id; links: a, b.

    Every round a label takes the smallest label next to it, and labels jump
    to their label's label; rounds grow with the logarithm of a chain.
    """
    labels = nodes.select("id", F.col("id").alias("label"))
    edges = links.select("a", "b").where("a <> b").distinct()
    edges = materialised(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    while not edges.isEmpty():
        low = edges.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("up"))
        jump = low.join(low.select(F.col("a").alias("up"), F.col("up").alias("top")), "up", "left").select("a", F.coalesce("top", "up").alias("up"))
        jump = materialised(jump)
        labels = materialised(labels.join(jump.withColumnRenamed("a", "label"), "label", "left").select("id", F.coalesce("up", "label").alias("label")))
        moved = edges.join(jump.withColumnRenamed("up", "ua"), "a").join(jump.select(F.col("a").alias("b"), F.col("up").alias("ub")), "b")
        edges = materialised(moved.select(F.col("ua").alias("a"), F.col("ub").alias("b")).where("a <> b").distinct())
    return labels


def reachable(seeds: DataFrame, links: DataFrame, most: int | None = None) -> DataFrame:
    """id, depth of everything reached from ``seeds`` (id) along links a -> b; shortest depth."""
    seen = materialised(seeds.select("id", F.lit(0).alias("depth")).distinct())
    front, depth = seen, 0
    while not front.isEmpty() and (most is None or depth < most):
        depth += 1
        step = front.join(links, front["id"] == links["a"]).select(F.col("b").alias("id")).distinct()
        front = materialised(step.join(seen, "id", "left_anti").select("id", F.lit(depth).alias("depth")))
        seen = materialised(seen.unionByName(front))
    return seen
