"""Connected components of a large edge table by alternating large and small stars.

Each round hangs neighbours on the smallest node they see; a graph of n nodes takes
about log n rounds. Minima are combined within each task before the shuffle, and the
join back to the edges is one whose skewed nodes Spark splits, so a node with very many
neighbours is no bottleneck. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_folder, materialise, run_folder


def _state(edges: DataFrame) -> tuple[int, int]:
    n, total = edges.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(u, v) as decimal(38, 0))"))).first()
    return n, int(total or 0)


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of edges: root is the smallest node it is connected with. Ids are long."""
    spark = edges.sparkSession
    current = edges.select(F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v")).where("u != v").distinct()
    path = run_folder(spark, "edges")
    current, state = materialise(current, path), None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = hung.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        fresh_path = run_folder(spark, "edges")
        fresh = materialise(small, fresh_path)
        new = _state(fresh)
        drop_folder(spark, path)
        current, path = fresh, fresh_path
        if new == state:
            break
        state = new
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
