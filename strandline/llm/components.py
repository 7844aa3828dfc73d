"""Connected components of a link table, by alternating large and small stars.

Each round replaces the links by links to smaller neighbours until every node links to the least
node of its component.  Rounds are joins and pre-aggregated minima; a node with very many links is
split by adaptive joins.  Every round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Stored


def _large(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a")
    return moved.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> Stored:
    """``links``: a, b (long, a != b).  Returns a stored table a -> b, b the least node of a's component.

    Only nodes that aren't their component's least appear as a.  An empty link table gives an empty one.
    """
    now = Stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    seen = None
    while True:
        sums = now.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == seen:
            return now
        seen = tuple(sums)
        if not sums[0]:
            return now
        after = Stored(_small(_large(now.df)), "links")
        now.drop()
        now = after
