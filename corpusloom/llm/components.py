"""Connected components of a link table, as rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import drop_table, write_table


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each linked id reaches. ``links`` has (a, b); ids without links aren't listed.

    Alternates large-star and small-star: every id hooks its larger neighbours,
    then its smaller ones and itself, to the smallest id it sees. The link table never grows, and it
    ends as stars around the components' smallest ids after about log(n) rounds.
    Grouped minima combine on the map side, and a hub's links are joined, not gathered.
    Raises an error if ``rounds`` don't finish, rather than return half of the work.
    """
    edges = write_table(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "links")

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = signature(edges)
    for _ in range(rounds):
        # large-star: for each id its larger neighbours go to the least of it and its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a > b").distinct()
        large = write_table(large, "large-star")
        # small-star: its smaller neighbours and itself go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        hooked = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        before, edges = edges, write_table(hooked.filter("a > b").distinct(), "small-star")
        drop_table(before), drop_table(large)
        now = signature(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components aren't finished after {rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
