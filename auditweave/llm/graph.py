"""Connected components of an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.shared import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of edges (a, b); comp is the smallest node of the component.

    Each round hooks every node to its smallest neighbour if that is smaller, follows the pointers to their roots by doubling
    and contracts the graph to the roots; a round at least halves the nodes that still have edges."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    e, label = cut(both), None
    while True:
        up = cut(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")))
        while True:
            further = up.select(F.col("node").alias("at"), F.col("comp").alias("to"))
            up = cut(up.join(further, F.col("comp") == F.col("at")).select("node", F.col("to").alias("comp"), (F.col("to") != F.col("comp")).alias("moved")))
            moved = up.filter("moved").limit(1).count()
            up = up.select("node", "comp")
            if not moved:
                break
        if label is None:
            label = up
        else:
            step = up.select(F.col("node").alias("at"), F.col("comp").alias("to"))
            label = cut(label.join(step, F.col("comp") == F.col("at"), "left").select("node", F.coalesce("to", "comp").alias("comp")))
        ends = [up.select(F.col("node").alias(k), F.col("comp").alias(f"c{k}")) for k in ("a", "b")]
        e = cut(e.join(ends[0], "a").join(ends[1], "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        if e.limit(1).count() == 0:
            return label
