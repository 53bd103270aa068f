"""Connected components of a link table, by rounds of large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chronocohort.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back, which cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) to (node, component): the smallest node reachable. Nodes without links have no row."""
    both = lambda x: x.select("a", "b").union(x.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        # Large star: larger neighbours move to the smallest neighbour. Small star: smaller neighbours and the node do.
        whole = both(links)
        least = whole.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = whole.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("l"))
        links = stored(small.select("l.*").where("a <> b").distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    named = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return named.union(named.select(F.col("component").alias("node"), "component").distinct()).distinct()
