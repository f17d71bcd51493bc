"""Connected components of a graph of integers, as DataFrame rounds. Nothing reaches the driver but
the number of labels that changed in a round.

Labels start at the least neighbour; a round takes the least label among the neighbours and then jumps
to the label's own label, so paths shorten by more than half a round. Every round is written to the
shared folder. Hubs are pre-aggregated map-side and split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) to (node, label): the least node of each node's component, for nodes with an edge."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v")
    both = scratch.write(both.distinct())
    labels = scratch.write(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("v"), "label"), "v")
            .groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        )
        least = labels.join(near, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("least")
        )
        jump = labels.select(F.col("node").alias("least"), F.col("label").alias("further"))
        new = scratch.write(
            least.join(jump, "least", "left").select("node", "old", F.least("least", F.coalesce("further", "least")).alias("label"))
        )
        if new.where("label <> old").isEmpty():
            scratch.drop(both)
            return new.select("node", "label")
        scratch.drop(labels)
        labels = new
