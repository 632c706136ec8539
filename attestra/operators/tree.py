"""Trees by parent pointers: preorder paths, prefix scopes and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def paths(nodes: DataFrame, key: str, parent: str, sequence: str) -> DataFrame:
    """key, level, path of every node that a root reaches, however deep; paths sort in preorder (sequence, then key). One join a level, each
    level written once. A node that would be its own ancestor (an id given twice) is not followed again."""
    own_id = F.concat(F.lit("~"), F.col(key).cast("string"), F.lit("/"))
    own = nodes.select(F.col(key), F.col(parent).alias("_p"), F.concat(F.lpad(F.col(sequence).cast("string"), 12, "0"), own_id).alias("_s"), own_id.alias("_id"))
    level = written(own.where("_p IS NULL").select(key, F.lit(0).alias("level"), F.col("_s").alias("path")), "level")
    out, depth = level, 0
    while not level.isEmpty():
        depth += 1
        step = own.join(level.select(F.col(key).alias("_p"), F.col("path").alias("_path")), "_p").where(~F.contains("_path", "_id"))
        level = written(step.select(key, F.lit(depth).alias("level"), F.concat("_path", "_s").alias("path")), "level")
        out = out.unionByName(level)
    return out


def allowed_prefix(placed: DataFrame, key: str, current) -> DataFrame:
    """Nodes up to and with the current node's whole subtree, in preorder."""
    here = placed.where(F.col(key) == current).select(F.col("path").alias("_at"))  # one row
    return placed.join(F.broadcast(here), (F.col("path") <= F.col("_at")) | F.startswith("path", F.col("_at"))).drop("_at")


def forest_problems(nodes: DataFrame, key: str, parent: str, sequence: str) -> DataFrame:
    """rule, node of every violation: duplicate ids, self references, missing parents, unordered and repeated sequences, cycles."""
    say = lambda df, rule, c=key: df.select(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("node"))
    ids = nodes.select(F.col(key).alias("_id")).distinct()
    reached = paths(nodes.where(F.col(sequence).isNotNull()), key, parent, sequence).select(F.col(key).alias("_id"))
    has_parent = nodes.where(F.col(parent).isNotNull())
    kept = has_parent.join(ids, F.col(parent) == F.col("_id"), "left_semi")
    siblings = nodes.groupBy(parent, sequence).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(parent).alias("_p"), F.col(sequence).alias("_q"))
    return (
        say(nodes.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "duplicate_node_id")
        .unionByName(say(nodes.where(F.col(key) == F.col(parent)), "self_referencing_node"))
        .unionByName(say(has_parent.join(ids, F.col(parent) == F.col("_id"), "left_anti"), "missing_parent"))
        .unionByName(say(nodes.where(F.coalesce(F.col(sequence) <= 0, F.lit(True))), "unordered_sequence"))
        .unionByName(say(nodes.join(siblings, F.col(parent).eqNullSafe(F.col("_p")) & F.col(sequence).eqNullSafe(F.col("_q")), "left_semi"), "ambiguous_sibling_sequence"))
        .unionByName(say(kept.where(F.col(key) != F.col(parent)).join(reached, F.col(key) == F.col("_id"), "left_anti"), "not_reached_from_a_root"))
    )
