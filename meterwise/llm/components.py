"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.session import settle


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def smallest_reachable(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node of ``links`` (``a``,
    ``b``) that is not its own root.

    Alternating large and small stars: each round ties every node's larger, then its
    smaller, neighbours to its smallest one, until nothing changes; rounds grow with the
    logarithm of the nodes. No neighbourhood is gathered: a round takes minima per node
    and joins them back, and writes its links to the shared folder.
    """
    links = settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(links)
    while True:
        both = links.union(links.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        tied = settle(large.distinct(), "links")
        low = tied.groupBy("a").agg(F.min("b").alias("low"))
        small = tied.join(low, "a").where("b <> low").select("b", "low").union(low.select("a", "low"))
        links = settle(small.toDF("a", "b").where("a <> b").distinct(), "links")
        before, state = state, _state(links)
        if state == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
