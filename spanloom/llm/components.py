"""Connected components of an edge table, by hooking to the smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import Workspace


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes of the (a, b) edges; comp is the smallest node of the component.

    Each round a node takes the smallest label among its own and its neighbours', then its label's
    label; rounds are written tables, and their number grows with the logarithm of a component's width.
    """
    both = ws.table(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = ws.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("hook"))
        jump = labels.select(F.col("node").alias("hook"), F.col("comp").alias("further"))
        new = ws.table(hooked.join(jump, "hook").select("node", "old", F.least("hook", "further").alias("comp")), "labels")
        done = new.where("old <> comp").isEmpty()
        ws.drop(labels)
        labels = new.select("node", "comp")
        labels._spanloom_path = new._spanloom_path
        if done:
            ws.drop(both)
            return labels
