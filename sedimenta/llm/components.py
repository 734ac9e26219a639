"""Connected components by alternating large-star and small-star steps.

Every step is an aggregation with map-side combining and a join, over edges
only; nothing but one row of totals reaches the driver.  Each round is written
to the shared folder, so lineage stays short and a lost executor costs at most
one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.shared import drop, new_path


def _star(both: DataFrame, keep: str) -> DataFrame:
    """Edges (v, m) from each u's neighbours v to the least m of u and its neighbours."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges' first two columns; component is the least node reached."""
    spark = edges.sparkSession
    a, b = edges.columns[:2]
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    path, before = None, None
    while True:
        fresh = new_path(spark, "edges")
        now.write.parquet(fresh)
        if path:
            drop(spark, path)
        path = fresh
        now = spark.read.parquet(path)
        t = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"), F.max("u").alias("m")).first()
        if tuple(t) == before or not t["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = tuple(t)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "v > u").distinct()
        # small star: u keeps its smaller neighbours, all point to the least
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        now = small.union(least.select("u", F.col("m").alias("v"))).distinct()
