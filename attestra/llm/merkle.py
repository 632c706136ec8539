"""Merkle manifest of a dataset by Pregel-style supersteps over RDDs.

Leaves are the digests of rows, in order within their tree (a language). Nodes are vertices: children send their digests to their parent, and a
parent that has all of them hashes them and sends its own on. 2**BLOCK_BITS leaves that lie side by side, and all nodes over them, are a block, and
blocks are what partitions hold. A superstep delivers the messages of the one before it, which a shuffle brings, then those within each block until
none is left there; what goes beyond, the digest of the block's top, is for the next superstep, where tops are the leaves of blocks of their own. When
each tree has one node, the trees' roots, in order, are the leaves of one more tree. Reverse supersteps then send each node's path of
siblings up to the root down to its children, and leaves check themselves by it. Partitions depend on places alone, so no tree, however large, gathers
in one task, and there are as many supersteps as the logarithm of the leaves by BLOCK_BITS.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import fresh_path, written

#: Leaves of a block: 2 to this power.
BLOCK_BITS = 10
#: Rows up to which a table of short columns is broadcast.
FEW_ROWS = 1_000_000


def field(c: Column) -> Column:
    """A value with its count of UTF-8 bytes; `-` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def join_digests(digests: Iterable[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def fold(leaf: str, path: tuple[str, ...]) -> str:
    """The root over a leaf; a path has `<` or `>` and the sibling on that side, or nothing for a node without one, from the leaf up."""
    for step in path:
        leaf = join_digests((step[1:], leaf) if step[:1] == "<" else (leaf, step[1:]))
    return leaf


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree: not null, ...) with index, the place within the tree by `order`, and n, the tree's rows. Sorted over ranges of (tree, order);
    places come from counts a tree and range, so a large tree is numbered by all its ranges at once."""
    cols = ["tree", *order]
    names = rows.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column(names.index("tree")).to_numpy(zero_copy_only=False)
            head = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
            at = np.arange(len(tree)) - np.repeat(head, np.diff(np.append(head, len(tree))))
            first = int(head[1]) if len(head) > 1 else len(tree)
            if tree[0] == last:
                at[:first] += seen
            last, seen = tree[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), part, np.int32)), pa.array(at)], names=[*names, "part", "at"])

    numbered = written(rows.repartitionByRange(*cols).sortWithinPartitions(*cols).mapInArrow(number, f"{schema}, part int, at long"), "ordered")
    counts = numbered.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("c"))  # a row a tree and range
    before = F.sum("c").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = written(counts.select("tree", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy("tree")).alias("n")), "ranges")
    side = F.broadcast(counts) if counts.count() <= FEW_ROWS else counts.hint("shuffle_hash")
    return numbered.join(side, ["tree", "part"]).select(*names, (F.col("before") + F.col("at")).alias("index"), "n")


def _where(key: tuple) -> int:
    """A block (tree, number) as a number."""
    return zlib.crc32(f"{key[0]}\0{key[1]}".encode())


def _levels(leaves: list[tuple], bits: int) -> tuple[list[list[str]], int]:
    """The digests of a block's nodes, level by level, and how many nodes of its tree the last level has. leaves: (index, n, digest, ...) in order."""
    first, n = leaves[0][:2]
    if len(leaves) != min(1 << bits, n - first) or first % (1 << bits) or leaves[-1][0] != first + len(leaves) - 1:
        raise ValueError(f"the block from leaf {first} on has {len(leaves)} of its leaves")
    levels = [[x[2] for x in leaves]]
    while n > 1 and len(levels) <= bits:
        inbox: dict[int, list[str]] = {}
        for k, digest in enumerate(levels[-1]):
            inbox.setdefault(k >> 1, []).append(digest)
        levels.append([join_digests(inbox[k]) for k in range(len(inbox))])
        n = (n + 1) >> 1
    return levels, n


def _paths(levels: list[list[str]], top: tuple[str, ...]) -> list[tuple[str, ...]]:
    """The path of each leaf of a block, from its top's one."""
    paths = [top]
    for nodes in reversed(levels[:-1]):
        sibling = [("<" + nodes[k ^ 1] if k & 1 else ">" + nodes[k ^ 1]) if k ^ 1 < len(nodes) else "" for k in range(len(nodes))]
        paths = [(x, *paths[k >> 1]) for k, x in enumerate(sibling)]
    return paths


class Forest:
    """Trees over leaves (tree, index, n, digest and further columns), built by up(); down() then brings every leaf its path."""

    def __init__(self, leaves: DataFrame, bits: int = BLOCK_BITS):
        self.spark, self.bits = leaves.sparkSession, bits
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        first = ["tree", "index", "n", "digest"]
        self.tiers = [leaves.select(*first, *(c for c in leaves.columns if c not in first))]

    def _blocks(self, tier: int) -> RDD:
        """((tree, block), (index, n, digest, further columns)) of a tier's leaves."""
        bits = self.bits
        return self.tiers[tier].rdd.map(lambda r: ((r[0], r[1] >> bits), tuple(r[1:])))

    def up(self) -> DataFrame:
        """tree, tier and digest of each tree's root."""
        bits, roots = self.bits, None

        def tops(blocks: Iterator[tuple]) -> Iterator[tuple]:
            for (tree, block), got in blocks:
                levels, n = _levels(sorted(got, key=lambda x: x[0]), bits)
                yield tree, block, n, levels[-1][0]

        while True:
            tier = len(self.tiers) - 1
            done = self._blocks(tier).mapValues(lambda v: v[:3]).groupByKey(self.parts, _where).mapPartitions(tops)
            done = written(self.spark.createDataFrame(done, "tree string, index long, n long, digest string", verifySchema=False), "block-tops")
            own = done.where("n = 1").select("tree", F.lit(tier).alias("tier"), "digest")
            roots = own if roots is None else roots.unionByName(own)
            left = done.where("n > 1")
            if left.isEmpty():
                return roots
            self.tiers.append(left)

    def down(self, paths: DataFrame) -> RDD:
        """(tree, leaf (index, n, digest, further columns), path) of every leaf; paths: tree, tier and path (array) of each root."""
        bits, above = self.bits, None

        def spread(blocks: Iterator[tuple]) -> Iterator[tuple]:
            for (tree, _), got in blocks:
                got = list(got)
                top = next(x[0] for x in got if len(x) == 1)
                leaves = sorted((x for x in got if len(x) > 1), key=lambda x: x[0])
                for leaf, path in zip(leaves, _paths(_levels(leaves, bits)[0], top), strict=True):
                    yield tree, leaf, path

        for tier in range(len(self.tiers) - 1, -1, -1):
            told = paths.where(F.col("tier") == tier).select("tree", F.lit(0).cast("long").alias("block"), "path")
            if above is not None:  # the leaves of the tier above are this one's tops
                rows = above.map(lambda x: (x[0], x[1][0], list(x[2])))
                told = told.unionByName(written(self.spark.createDataFrame(rows, "tree string, block long, path array<string>", verifySchema=False), "block-paths"))
            told = told.rdd.map(lambda r: ((r[0], r[1]), (tuple(r[2]),)))
            above = self._blocks(tier).union(told).groupByKey(self.parts, _where).mapPartitions(spread)
        return above


def merkle_manifest(docs: DataFrame, columns: list[str], tampered: Column, tree_col: str = "lang", id_col: str = "doc_id", count_col: str = "n_chars", bits: int = BLOCK_BITS) -> DataFrame:
    """id_col, leaf, subroot, root, proof_sha256, folded_root and verified of every row of docs.

    A leaf is the SHA-256 (lowercase hex) of the row's `columns`, each `-` if null, else its count of UTF-8 bytes, `:` and its value. The leaves
    of one tree_col ascend by id_col (nulls first, ties by leaf: equal leaves may take each other's place); every two consecutive nodes, of the last run perhaps one, become
    the hash of their digests, until one is left, the subroot. The subroots, by tree_col (null first), make the root likewise.
    proof_sha256 is the hash of the siblings from leaf to root. folded_root is worked out from the siblings and the row's leaf, which is taken with
    count_col one larger (nulls stay) where `tampered` holds (null: it does not); verified: it is the root.

    Very long texts are hashed where they are read and not shuffled. Empty tables give no rows. Columns other than these are ignored, whatever their names.
    """
    spark = docs.sparkSession
    own = [F.col(f"`{c}`") for c in columns]
    changed = [F.col(f"`{c}`") + 1 if c == count_col else F.col(f"`{c}`") for c in columns]
    seen = F.when(F.coalesce(tampered, F.lit(False)) & F.col(f"`{count_col}`").isNotNull(), row_digest(changed))  # null: the leaf itself
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree_col}`").cast("string")), F.lit("-"))  # null comes first
    rows = written(docs.select(tree.alias("tree"), F.col(f"`{id_col}`").alias("doc_id"), row_digest(own).alias("digest"), seen.alias("seen"), F.monotonically_increasing_id().alias("row")), "leaves")
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string"
    if rows.isEmpty():
        return spark.createDataFrame([], schema.replace("subroot string", "subroot string, root string") + ", verified boolean").withColumnRenamed("doc_id", id_col)
    forest = Forest(placed(rows, ["doc_id", "digest", "row"]).drop("row"), bits)
    subroots = written(forest.up(), "subroots")
    crown = Forest(placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"]), bits)
    top = written(crown.up(), "root")
    root = top.first()["digest"]
    # The paths of the subroots to the root go down on their own tree.
    above = crown.down(top.withColumn("path", F.array().cast("array<string>"))).map(lambda x: (x[1][3], list(x[2])))
    above = written(spark.createDataFrame(above, "tree string, path array<string>"), "paths")

    def told(rows: Iterator[tuple]) -> Iterator[tuple]:
        for tree, (_, _, leaf, doc_id, seen), path in rows:
            yield tree, doc_id, leaf, join_digests(s[1:] for s in path), fold(seen or leaf, path)

    path = fresh_path(spark, "manifest")
    schema = f"tree string, doc_id {kind}, leaf string, proof_sha256 string, folded_root string"
    spark.createDataFrame(forest.down(subroots.join(above, "tree")).mapPartitions(told), schema, verifySchema=False).write.parquet(path)
    out = spark.read.parquet(path)
    sub = subroots.select("tree", F.col("digest").alias("subroot"))
    out = out.join(F.broadcast(sub) if sub.count() <= FEW_ROWS else sub.hint("shuffle_hash"), "tree").withColumn("root", F.lit(root))
    return out.select(F.col("doc_id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
