"""Connected components of a link table by smallest-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.base import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) of every node in links(a, b); the component is its smallest node.

    Each round gives a node the smallest label among its own and its neighbours'
    (aggregated before the shuffle), then the label of that label. Rounds are written
    to the shared folder; only the count of changes comes to the driver.
    """
    both = scratch.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}_edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{name}_0")
    step = 0
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lowered = labels.withColumnRenamed("component", "before").join(near, "node").select("node", "before", F.least("before", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("further"))
        after = scratch.save(lowered.join(jump, "to", "left").select("node", "before", F.least("to", F.coalesce("further", "to")).alias("component")), f"{name}_{step + 1}")
        changed = after.where("component < before").limit(1).count()
        scratch.drop(f"{name}_{step}")
        labels, step = after.select("node", "component"), step + 1
        if not changed:
            scratch.drop(f"{name}_edges")
            return labels


def contracted(labels: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """labels(node, component) after links(a, b) between their nodes have joined components.

    Only links between different components take part, each pair of components once,
    so the work follows what is new and not all links so far.
    """
    of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").where("of_a <> of_b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct()
    roots = connected_components(scratch.save(edges, f"{name}_links"), scratch, f"{name}_cc").select(F.col("node").alias("component"), F.col("component").alias("root"))
    return scratch.save(labels.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component")), name)
