"""Connected components of a graph in DataFrames: least labels spread over edges, with hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triadic.llm.common import cut, without_estimates


#: What a node's label takes in a table to join with.
NODE_BYTES = 32


def _limit(df: DataFrame) -> int:
    """Bytes up to which the session broadcasts tables whose size it knows; -1: none."""
    return int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of integers, in any order, repeated or not -> (node, component): the least node that it reaches.

    In a round each node is offered the least label among its neighbours'; so is the node that its label names,
    which hooks whole trees to each other, and then each label becomes the label of its label. Rounds
    go on until no label changes: about the logarithm of a component's size, chains included. A
    round's labels are written to the shared folder. Nodes with very many edges, and labels that very many nodes
    have, only meet in partial aggregates and in equi-joins. No node or edge is gathered on the driver; it sees
    whether there are changes, and how many nodes there are: as the planner is not to guess sizes, labels are joined as it
    would if it knew theirs, by broadcast only below the session's own threshold.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = without_estimates(cut(both))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component"))
    labels = without_estimates(cut(labels))
    nodes = labels.count()
    small = lambda df: F.broadcast(df) if nodes * NODE_BYTES <= _limit(df) else df
    while True:
        offered = both.join(small(labels.select(F.col("node").alias("b"), "component")), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("offer"))
        nearer = offered.join(small(labels), "node").select("node", "component", F.least("component", "offer").alias("mid"))
        hooked = nearer.select("node", "mid", F.col("component").alias("was")).unionByName(nearer.where("mid < component").select(F.col("component").alias("node"), "mid", F.lit(None).cast("long").alias("was")))
        hooked = hooked.groupBy("node").agg(F.min("mid").alias("mid"), F.max("was").alias("was"))
        jumped = hooked.join(small(labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))), "mid", "left")
        jumped = without_estimates(cut(jumped.select("node", F.least("mid", F.coalesce("far", "mid")).alias("component"), "was")))
        changed = jumped.where("component <> was").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
