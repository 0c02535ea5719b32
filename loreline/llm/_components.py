"""Connected components as an iterated join: smallest neighbouring label, then pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.llm._frames import checkpoint, discard


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id that stands in ``edges`` (a long, b long); component is the smallest id reachable.

    A round takes the smallest label among neighbours and then the label's own label, so labels travel twice as far each
    round. Every round is written to the checkpoint folder; only a count comes back to the driver. The label of a hot node
    is aggregated map-side before it is shuffled.
    """
    both = checkpoint(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    # first labels: the smallest of a node and its neighbours
    labels = checkpoint(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.least("component", "near").alias("next"), F.col("component").alias("was"))
        jump = step.join(labels.select(F.col("id").alias("next"), F.col("component").alias("far")), "next", "left")
        moved = checkpoint(jump.select("id", F.least("next", F.coalesce("far", "next")).alias("component"), (F.least("next", F.coalesce("far", "next")) < F.col("was")).alias("moved")))
        discard(labels)
        labels = moved.select("id", "component")
        labels.written_to = moved.written_to
        if moved.filter("moved").isEmpty():
            discard(both)
            return labels
