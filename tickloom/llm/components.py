"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import drop_folder, work_folder


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node reachable, of every node of ``links`` (a, b).

    Alternates two steps until nothing changes: every node's larger neighbours, then its smaller
    ones, are linked to its least neighbour. Each step is a grouped minimum and a join, so a node
    with any number of neighbours is never gathered. Rounds grow with the logarithm of the size;
    each is written to the shared folder, which ends its lineage, and the one before is removed.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, path, state = _written(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = down.unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v")
        after = after.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        new, new_path, new_state = _written(after)
        drop_folder(spark, path)
        edges, path = new, new_path
        if new_state == state:
            break
        state = new_state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _written(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
    spark = edges.sparkSession
    path = work_folder(spark, "links")
    edges.distinct().write.parquet(path)
    kept = spark.read.schema(edges.schema).parquet(path)
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return kept, path, tuple(kept.agg(F.count(F.lit(1)), total).first())
