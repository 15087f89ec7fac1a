"""Connected components by alternating label minimisation and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolex.plans.materialize import drop_materialized, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component``: every node of ``edges`` with the least node of its component.

    Each round hooks every node to the least label around it and then follows
    that label's own label, so labels travel twice as far per round. Labels
    stay in tables; the driver learns only how many changed.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = materialize(both.union(both.select("y", "x")).filter("x <> y").distinct(), "component-edges")
    labels = both.groupBy(F.col("x").alias("id")).agg(F.least(F.col("id"), F.min("y")).alias("component"))
    labels = written = materialize(labels, "component-labels")
    while True:
        around = both.join(labels.withColumnRenamed("id", "y"), "y").groupBy(F.col("x").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(around, "id").select("id", F.least("component", "near").alias("c"), F.col("component").alias("old"))
        onward = labels.select(F.col("id").alias("c"), F.col("component").alias("further"))
        jumped = hooked.join(onward, "c", "left").select("id", F.least(F.col("c"), F.coalesce("further", "c")).alias("component"), "old")
        step = materialize(jumped, "component-labels")
        labels = step.select("id", "component")
        drop_materialized(written)
        written = step
        if step.filter("component <> old").isEmpty():
            return labels
