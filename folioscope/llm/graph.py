"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import cut, forget


def components(edges: DataFrame, what: str = "cc") -> DataFrame:
    """Rows (node, component) for all nodes of edges (a long, b long); component is the least node.

    Alternating large and small stars: each round hangs neighbours on the least node known, written
    to the shared folder. Null ends and loops are ignored; an empty table gives no rows.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), what)
    mark = None
    while True:
        # Large star: neighbours above a node go to the least of its neighbourhood.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: neighbours below a node, and itself, go to the least of them.
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = cut(small, what)
        forget(edges.sparkSession, now)
        # A round that changes nothing leaves the same rows: their number and the sum of their hashes.
        was, mark = mark, tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        now = after
        if not mark[0] or mark == was:
            return _with_roots(now)


def _with_roots(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
