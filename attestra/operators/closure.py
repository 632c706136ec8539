"""What follows from what over a table of edges, to a fixed point: semi-naive rounds that only join what the round before found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Rows up to which a round's new nodes are broadcast to the edges; beyond, both are shuffled.
FEW = 1_000_000
#: Rounds after which the nodes found so far are written as one table.
TOGETHER = 8


def reached(roots: DataFrame, edges: DataFrame, keep: bool = True) -> DataFrame:
    """kind, id, cause and depth of every node that roots reach, each once: by the fewest steps, and of those the smallest cause.

    roots: kind, id, cause. edges: kind, id, to_kind, to_id: the second is void if the first is. Nodes are told apart by kind and id, so equal ids of two
    tables are two nodes. Cycles end where they meet what was found before. keep: with the roots themselves (depth 0). Each round's new nodes are
    written, so a long chain has no long lineage; a round reads the edges once and joins them with the new nodes alone. Null ids are no nodes.
    """
    key = ["kind", "id"]
    edges = written(edges.select("kind", "id", F.col("to_kind").alias("_k"), F.col("to_id").alias("_i")).where("id IS NOT NULL AND to_id IS NOT NULL").distinct(), "edges")
    new = written(roots.where("id IS NOT NULL").groupBy(*key).agg(F.min("cause").alias("cause")).withColumn("depth", F.lit(0)), "reached-0")
    found, depth = [new], 0
    while True:
        n = new.count()
        if not n:
            break
        depth += 1
        front = new.select(*key, "cause")
        met = edges.join(F.broadcast(front) if n <= FEW else front, key)
        step = met.groupBy(F.col("_k").alias("kind"), F.col("_i").alias("id")).agg(F.min("cause").alias("cause"))
        known = found[0]
        for f in found[1:]:
            known = known.unionByName(f)
        new = written(step.join(known.select(*key), key, "left_anti").withColumn("depth", F.lit(depth)), f"reached-{depth}")
        found = [written(known, "reached-so-far"), new] if len(found) >= TOGETHER else [*found, new]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out if keep else out.where("depth > 0")
