"""Connected components by large-star and small-star rounds, wholly in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenpage.llm.common import stored

#: Links for each task that writes a round, and tasks at least.
LINKS, TASKS = 100_000, 8


def components(links: DataFrame, folder: str) -> DataFrame:
    """Rows (id, component) of every id in ``links`` (a, b); the component is its smallest id.

    Rounds alternate: each node passes its smallest neighbour to its larger
    ones, then to its smaller ones. Stars are left when nothing changes. Every
    round is written to shared storage, by as many tasks as its links ask for.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), folder, "edges-0", small=True)
    tasks = max(TASKS, edges.count() // LINKS + 1)
    before, k = None, 0
    while True:
        k += 1
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a")
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a <> b").distinct().coalesce(tasks), folder, f"edges-{k}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.groupBy("a").agg(F.min("b").alias("component"))
    return stars.select(F.col("a").alias("id"), "component").union(edges.select("b", "b").distinct())
