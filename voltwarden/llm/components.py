"""Connected components by label spreading and pointer jumping, as joins of written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for each node of the edges (a, b).

    Labels spread to neighbours as a minimum, which tasks combine before the shuffle, and each round also takes the label
    of the label, so long chains shorten by half. Every round is a written table; the driver sees one count a round.
    """
    both = common.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = common.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("higher"))
        jumped = labels.join(up, F.col("label") == F.col("up")).select("node", "label", F.col("higher").alias("jumped"))
        near = both.join(jumped, F.col("b") == F.col("node")).groupBy("a").agg(F.min("jumped").alias("near"))
        step = jumped.join(near, F.col("node") == F.col("a")).select("node", F.least("jumped", "near").alias("next"), "label")
        step = common.written(step.select("node", F.col("next").alias("label"), (F.col("next") < F.col("label")).alias("moved")), "labels")
        labels = step.select("node", "label")
        if not step.where("moved").limit(1).count():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """node, label once more links (a, b) are known: only components that they join are gone through again."""
    ends = {x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l_{x}")) for x in "ab"}
    between = links.join(ends["a"], "a", "left").join(ends["b"], "b", "left").select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b")).where("a <> b").distinct()
    up = connected(between).withColumnRenamed("label", "higher")
    known = labels.join(up.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("higher", "label").alias("label"))
    # those that stood alone are nodes of `up` without a label of their own
    new = up.join(labels.select("node"), "node", "left_anti").join(labels.select(F.col("label").alias("node")), "node", "left_anti")
    return common.written(known.unionByName(new.select("node", F.col("higher").alias("label"))), "labels")
