"""Connected components of links between 64-bit keys, by hooking to the smallest neighbour and shortcutting.

Labels are a table in the shared folder after every round, so both sides of each join are plain exchanges
that adaptive execution may split when one node has very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """``links``: a, b. One row (node, label) per node with a link; label is the smallest node reachable."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where(F.col("a") != F.col("b")).distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hooked = materialize(hooked, "hooked")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = materialize(hooked.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        labels = after.select("node", "label")
        if after.where(F.col("old") != F.col("label")).isEmpty():
            return labels
