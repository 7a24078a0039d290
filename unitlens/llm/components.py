"""Connected components of a link table, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitlens.llm.scratch import written


#: Links are few beside the corpus that they were found in.
MERGED = 8


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node it reaches.

    Each round takes the smallest label among the neighbours, then the label of that label, so
    chains shorten by doubling. Minima are combined before the shuffle; a node with very many
    links is one large key of a join, which adaptive execution splits. Each round is written to
    the shared folder. Null ends and loops are ignored, repeated links count once, no links give
    no rows.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    edges = written(both.distinct(), MERGED)
    labels = written(
        edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("low")).select(
            "node", F.least("node", "low").alias("component"), F.lit(True).alias("moved")
        ),
        MERGED,
    )
    while not labels.where("moved").isEmpty():
        told = edges.join(labels.select(F.col("node").alias("y"), "component"), "y").groupBy(F.col("x").alias("node")).agg(
            F.min("component").alias("heard")
        )
        near = labels.join(told, "node").select("node", "component", F.least("component", "heard").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("beyond"))
        labels = written(
            near.join(jump, "next").select(
                "node", F.col("beyond").alias("component"), (F.col("beyond") < F.col("component")).alias("moved")
            ),
            MERGED,
        )
    return labels.select("node", "component")
