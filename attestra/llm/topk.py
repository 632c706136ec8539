"""Exact top-k search by integer inner product, with block-at-a-time pruning.

Vectors are dealt evenly into shards by a hash of their id, once. Queries are written in files of a bounded number of rows, and the task
of a shard reads them one after the other. In a shard, vectors are ordered so that blocks of neighbours are alike, and each block keeps, per
dimension ("term"), the largest and smallest value. The sum over the query's terms of the larger product bounds
every score in the block. Each query visits blocks by falling bound, scores a block through its dense forward index,
and stops when the next bound lies below its kth score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written
from .warc import open_input

LEAST = np.iinfo(np.int64).min


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def finite(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: F.coalesce(F.isnan(x) | (F.abs(x.cast("double")) == float("inf")), F.lit(True)))


def _matrix(table: pa.Table, dim: int) -> np.ndarray:
    flat = table.column("v").combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(table), dim)


class Shard:
    """Vectors in blocks of neighbours that are alike."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, block: int = 256):
        n = len(vectors)
        self.block, self.most = block, int(max(abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0)))))
        pivots = vectors[np.linspace(0, n - 1, max(1, n // block)).astype(np.int64)].astype(np.float64)
        size = np.maximum((pivots**2).sum(1), 1) ** 0.5
        near = np.concatenate([np.argmax(vectors[i : i + 4096].astype(np.float64) @ (pivots / size[:, None]).T, axis=1) for i in range(0, n, 4096)])
        order = np.lexsort((ids, near))
        self.ids, self.vectors = ids[order], vectors[order]
        self.firsts = np.arange(0, n, block)
        self.kinds: dict[type, tuple] = {}

    def as_kind(self, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if kind not in self.kinds:
            x = self.vectors.astype(kind)
            self.kinds = {kind: (x, *(f.reduceat(x, self.firsts) for f in (np.maximum, np.minimum)))}
        return self.kinds[kind]


def search(shard: Shard, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, dict]:
    """(scores, ids), each queries x k, best first, ties by smaller id; LEAST fills up. Vectors whose id is the query's are left out."""
    dim, ids, firsts, block = shard.vectors.shape[1], shard.ids, shard.firsts, shard.block
    top = np.full((len(queries), k), LEAST)
    top_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
    # Exact in doubles while every sum stays below 2**53, in 64-bit integers below 2**63; else in Python's integers, clipped to 64 bits.
    most = shard.most * max(abs(int(queries.max(initial=0))), abs(int(queries.min(initial=0)))) * max(dim, 1)
    kind = np.float64 if most < 2**53 else np.int64 if most < 2**63 else object
    x, high, low = shard.as_kind(kind)
    q = queries.astype(kind)
    bound = _whole(np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T)
    turn = np.argsort(-np.maximum(bound, LEAST + 1), axis=1, kind="stable")
    alive, visited = np.arange(len(q)), 0
    for step in range(len(firsts)):
        alive = alive[bound[alive, turn[alive, step]] >= top[alive, k - 1]]
        if not len(alive):
            break
        blocks = turn[alive, step]
        by = np.argsort(blocks, kind="stable")
        for own in np.split(alive[by], np.flatnonzero(np.diff(blocks[by])) + 1):
            a = firsts[turn[own[0], step]]
            here = ids[a : a + block]
            got = _whole(q[own] @ x[a : a + block].T)
            got[here[None, :] == query_ids[own, None]] = LEAST
            visited += len(own)
            scores = np.concatenate([top[own], got], axis=1)
            named = np.concatenate([top_ids[own], np.broadcast_to(here, got.shape)], axis=1)
            best = np.lexsort((named, -np.maximum(scores, LEAST + 1)), axis=-1)[:, :k]
            top[own], top_ids[own] = np.take_along_axis(scores, best, 1), np.take_along_axis(named, best, 1)
    return top, top_ids, {"visited": visited, "blocks": len(firsts) * len(q)}


def _whole(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; those beyond count as the largest or smallest one."""
    return np.clip(scores, LEAST + 1, np.iinfo(np.int64).max).astype(np.int64) if scores.dtype == object else scores.astype(np.int64)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, shard_rows: int = 65536, query_rows: int = 16384, tasks: int = 24) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best vectors of each query; the vector of the query's own id is left out.

    Components become floor(scale * x), those beyond 64 bits the largest or smallest 64-bit integer, as do scores beyond. Rows whose vector is
    null, or holds a null or non-finite component, and rows with a null
    id take no part. Vectors meet queries of their own length only. Ties go to the smaller id; rows that repeat an id
    are each a candidate. A query with fewer candidates gets all of them. Empty tables give no rows. Other columns are ignored,
    whatever their names. Memory follows the shard and one file of queries, and the dimension.

    No side is broadcast or copied: a vector is shuffled once, to its shard (shard_rows vectors at most on average); the shard's task reads
    the queries' files (query_rows rows on average) in turn; equal vectors spread over all shards.
    """
    pick = lambda df: df.where(F.col(id_col).isNotNull() & finite(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vec_col), scale).alias("v"))
    x, q = pick(vectors), pick(queries)
    n, m = x.count(), q.count()
    shards = max(1, -(-n // shard_rows), min(tasks, n // 2048))
    files = sorted(written(q.repartition(max(1, -(-m // query_rows)), "id"), "queries").inputFiles()) if n and m else []
    dealt = x.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def meet(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        shard, out = Shard(table.column("id").to_numpy(), _matrix(table, dim)), []
        for uri in files:
            with open_input(uri) as file:
                asked = pq.read_table(file, columns=["id", "v"])
            asked = asked.filter(pc.equal(pc.list_value_length(asked.column("v")), dim))
            if len(asked):
                qid = asked.column("id").to_numpy()
                scores, ids, _ = search(shard, qid, _matrix(asked, dim), k)
                real = scores != LEAST
                out.append(pa.table([np.broadcast_to(qid[:, None], scores.shape)[real], ids[real], scores[real]], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    found = dealt.groupBy("dim", "shard").applyInArrow(meet, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
