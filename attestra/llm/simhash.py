"""SimHash near-dedup by the generalised pigeonhole principle, and connected components of its links.

A text's fingerprint has 64 bits, each the majority of that bit over the XXH64 of the text's word shingles. Equal fingerprints are one
class. Bits that vary together over the classes are grouped into the same partition, so that what repeats much gathers in few
partitions and the others tell more. If the thresholds of m partitions sum to `most` - m + 1 (-1: not looked at), two fingerprints that differ
in `most` bits or fewer differ in some partition by no more than its threshold. Each fingerprint gets thresholds of its own: a
dynamic program over the partitions minimises the candidates it is expected to meet (from histograms of the partitions' values) and the
probes it sends: all values within the threshold, looked up among all fingerprints' values of the partition. What meets is verified on all bits.

Values that many fingerprints have are compared in blocks inside tasks, which return the links that connect and not all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import components
from .quality import words_of
from .shared import chunks, met, small_batches, utf8, written

SEED = 42
#: Fingerprints with one value of a partition beyond which they are compared in blocks.
FEW = 256
#: Fingerprints in a block.
BLOCK = 4096
#: What a probe costs, in candidates.
PROBE = 4.0
#: Shingles whose bits are counted at once.
_STEP = 1 << 15
#: Bits of a partition whose values are counted together.
_HISTOGRAM = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints_of(data: np.ndarray, offs: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of each text; data and offs hold their UTF-8, offs begin at 0."""
    data = _LOWER[data]
    starts, ends = words_of(data, offs)
    size = ends - starts
    # All words, one space behind each.
    at = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int((size + 1).sum()), 32, np.uint8)
    joined[np.repeat(at - np.cumsum(size) + size, size) + np.arange(int(size.sum()))] = data[np.repeat(starts - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
    first = np.searchsorted(starts, offs)
    many = np.diff(first)
    grams = np.where(many >= n, many - n + 1, np.minimum(many, 1))
    of = np.repeat(np.arange(len(many)), grams)
    word = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(grams) - grams, grams)
    last = np.minimum(word + n, first[of + 1]) - 1
    text, counts = joined.tobytes(), np.zeros((len(many), 64), np.int64)
    begin, end = at[word], at[last] + size[last]
    for a in range(0, len(of), _STEP):
        z = min(a + _STEP, len(of))
        h = np.fromiter((xxhash.xxh64_intdigest(text[i:j], SEED) for i, j in zip(begin[a:z].tolist(), end[a:z].tolist(), strict=True)), np.uint64, z - a)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cuts = np.flatnonzero(np.append(True, of[a + 1 : z] != of[a : z - 1]))
        counts[of[a + cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > grams[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, n: int) -> DataFrame:
    """doc_id and fp (a long of the 64 bits) of columns doc_id and text."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(1))
            found = [fingerprints_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n) for i, j in chunks(offs)]
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def co_occurrence(distinct: DataFrame) -> np.ndarray:
    """How often two bits are both set, over column fp: 64 x 64, partial sums a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), np.int64)
        for batch in batches:
            fp = np.ascontiguousarray(batch.column(0).to_numpy()).astype("<i8")
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096, dtype=np.int32)), pa.array(total.reshape(-1))], names=["cell", "n"])

    rows = distinct.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4,096
    out = np.zeros(4096, np.int64)
    for r in rows:
        out[r["cell"]] = r["n"]
    return out.reshape(64, 64)


def grouped_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The 64 bits in `parts` groups of about equal size: a group begins with the two free bits of greatest correlation, and takes the free bit
    most correlated with it until it is full."""
    share = both / max(1, n)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    tied = np.abs(share - np.outer(p, p)) / spread
    np.fill_diagonal(tied, 0.0)
    free, out = list(range(64)), []
    for k in range(parts):
        size = (64 + parts - 1 - k) // parts
        if size == len(free):
            out.append(sorted(free))
            break
        own = list(divmod(int(tied[np.ix_(free, free)].argmax()), len(free)))
        own = [free[i] for i in own] if own[0] != own[1] else free[:2]
        while len(own) < size:
            rest = [b for b in free if b not in own]
            own.append(rest[int(tied[np.ix_(rest, own)].sum(1).argmax())])
        out.append(sorted(own))
        free = [b for b in free if b not in own]
    return out


def parts_for(n: int) -> int:
    """How many partitions cost least for n fingerprints if bits were independent."""

    def cost(m: int) -> float:
        widths = [(64 + m - 1 - k) // m for k in range(m)]
        probes = [sum(math.comb(widths[k], d) for d in range((4 - m if k == 0 else 0) + 1)) for k in range(m)]
        return sum(p * (PROBE + n / 2**w) for p, w in zip(probes, widths, strict=True))

    return min((2, 3, 4), key=cost)


class Partitions:
    """Where the partitions lie in the permuted fingerprint, and how many fingerprints are within each distance of each value."""

    def __init__(self, widths: list[int], most: int):
        self.widths, self.most = widths, most
        self.low = np.cumsum([0, *widths])[:-1].tolist()
        self.pieces: list[tuple[int, int, int]] = []  # (partition, low bit, width) of what is counted together
        for k, w in enumerate(widths):
            many = -(-w // _HISTOGRAM)
            cuts = [w * i // many for i in range(many + 1)]
            self.pieces += [(k, self.low[k] + a, z - a) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        self.total, self.near = 0, [np.zeros((most + 1, 1 << w)) for _, _, w in self.pieces]

    def count(self, rows: list[tuple[int, int, int]], total: int) -> None:
        """rows: (piece, value, fingerprints)."""
        self.total = total
        hist = [np.zeros(1 << w) for _, _, w in self.pieces]
        for piece, value, n in rows:
            hist[piece][value] = n
        self.near = []
        for (_, _, w), h in zip(self.pieces, hist, strict=True):
            at = np.zeros((self.most + 1, 1 << w))  # by exact distance
            at[0] = h
            for b in range(w):
                flipped = at.reshape(self.most + 1, -1, 2, 1 << b)[:, :, ::-1].reshape(self.most + 1, -1)
                at[1:] += flipped[:-1]
            self.near.append(at)

    def values(self, x: np.ndarray, low: int, width: int) -> np.ndarray:
        return x >> np.uint64(low) & np.uint64((1 << width) - 1)

    def expected(self, x: np.ndarray) -> np.ndarray:
        """(partition, threshold from 0 on, fingerprint): the cost of probing; pieces of one partition count as independent."""
        out = np.zeros((len(self.widths), self.most + 1, len(x)))
        for k, w in enumerate(self.widths):
            exact = None
            for (part, low, width), near in zip(self.pieces, self.near, strict=True):
                if part == k:
                    own = near[:, self.values(x, low, width).astype(np.int64)]
                    exact = own if exact is None else np.stack([sum(exact[a] * own[d - a] for a in range(d + 1)) / max(1, self.total) for d in range(self.most + 1)])
            balls = np.cumsum([math.comb(w, d) for d in range(self.most + 1)])
            out[k] = np.cumsum(exact, axis=0) + PROBE * balls[:, None]
        return out

    def thresholds(self, x: np.ndarray) -> np.ndarray:
        """(fingerprint, partition): the thresholds, from -1 on and summing to most - m + 1, of least expected cost."""
        m, cost = len(self.widths), self.expected(x)
        sums = self.most + 2  # thresholds count from -1, so choices from 0 and their sum to most + 1
        best = np.full((sums, len(x)), np.inf)
        best[0] = 0
        took = []
        for k in range(m):
            after, how = np.full((sums, len(x)), np.inf), np.zeros((sums, len(x)), np.int8)
            for t in range(self.most + 2):
                own = cost[k][t - 1] if t else 0.0
                for s in range(sums - t):
                    better = best[s] + own < after[s + t]
                    after[s + t] = np.where(better, best[s] + own, after[s + t])
                    how[s + t][better] = t
            best = after
            took.append(how)
        out, left = np.empty((len(x), m), np.int64), np.full(len(x), self.most + 1)
        for k in range(m - 1, -1, -1):
            t = took[k][left, np.arange(len(x))].astype(np.int64)
            out[:, k] = t - 1
            left = left - t
        return out


def permuted(distinct: DataFrame, order: list[int], schema: str) -> DataFrame:
    """distinct with fp's bits in another order: bit k of the result is bit order[k]."""
    names = distinct.columns
    at = names.index("fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, x = batch.column(at).to_numpy().view(np.uint64), np.zeros(batch.num_rows, np.uint64)
            for k, b in enumerate(order):
                x |= (fp >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x.view(np.int64))], names=[*names, "x"])

    return distinct.mapInArrow(run, f"{schema}, x long")


def _probes(x: DataFrame, parts: Partitions) -> DataFrame:
    """part, value, q: each fingerprint's probes."""
    masks = []
    for w in parts.widths:
        by = [np.array([sum(1 << b for b in c) for c in combinations(range(w), d)], np.uint64) for d in range(parts.most + 1 if w <= 16 else 3)]
        masks.append([np.concatenate(by[: d + 1]) for d in range(len(by))])

    def ball(k: int, t: int) -> np.ndarray:
        while len(masks[k]) <= t:
            d = len(masks[k])
            masks[k].append(np.concatenate([masks[k][-1], np.array([sum(1 << b for b in c) for c in combinations(range(parts.widths[k]), d)], np.uint64)]))
        return masks[k][t]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for a in range(0, len(every), 2000):
                own = every[a : a + 2000]
                chosen = parts.thresholds(own)
                for k in range(len(parts.widths)):
                    value = parts.values(own, parts.low[k], parts.widths[k])
                    for t in range(parts.most + 1):
                        at = np.flatnonzero(chosen[:, k] == t)
                        step = max(1, (1 << 18) // len(ball(k, t))) if len(at) else 1
                        for i in range(0, len(at), step):
                            who = at[i : i + step]
                            values = (value[who][:, None] ^ ball(k, t)).reshape(-1)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(values.view(np.int64)), pa.array(np.repeat(own[who], len(ball(k, t))).view(np.int64))], names=["part", "value", "q"])

    return x.select("x").mapInArrow(run, "part int, value long, q long")


def _within(table: pa.Table, most: int) -> pa.Table:
    """Links between a block of probing fingerprints and one of those with the value probed; only those that connect what earlier ones do not."""
    side, every = table.column("side").to_numpy(), table.column("x").to_numpy().view(np.uint64)
    q, x = np.unique(every[side == 0]), np.unique(every[side == 1])
    nodes = np.unique(np.concatenate([q, x]))
    label = np.arange(len(nodes))
    at_q, at_x, a, b = np.searchsorted(nodes, q), np.searchsorted(nodes, x), [], []
    for i in range(0, len(q), 256):
        near = np.bitwise_count(q[i : i + 256, None] ^ x[None, :]) <= most
        for k, row in enumerate(near):
            hit = at_x[np.flatnonzero(row)]
            own = at_q[i + k]
            other = hit[label[hit] != label[own]]
            if len(other):
                found, first = np.unique(label[other], return_index=True)
                a += [nodes[own]] * len(first)
                b += nodes[other[first]].tolist()
                label[np.isin(label, found)] = label[own]
    return pa.table({"a": pa.array(np.array(a, np.uint64).view(np.int64)), "b": pa.array(np.array(b, np.uint64).view(np.int64))})


def links(x: DataFrame, parts: Partitions) -> DataFrame:
    """a, b: pairs of column x that differ in `most` bits or fewer; of values with many fingerprints only the pairs that connect."""
    most = parts.most
    probes = _probes(x, parts)
    value = lambda k: F.shiftrightunsigned("x", parts.low[k]).bitwiseAND(F.lit((1 << parts.widths[k]) - 1))
    data = x.select("x", F.explode(F.array(*(F.struct(F.lit(k).alias("part"), value(k).alias("value")) for k in range(len(parts.widths))))).alias("v")).select("v.part", "v.value", "x")
    hot = written(data.groupBy("part", "value").agg(F.count(F.lit(1)).alias("nx")).where(F.col("nx") > FEW), "hot-values")
    differ = lambda p, q: F.bit_count(F.col(p).bitwiseXOR(F.col(q))) <= most
    if hot.isEmpty():
        return probes.join(data, ["part", "value"]).where((F.col("q") < F.col("x")) & differ("q", "x")).select(F.col("q").alias("a"), F.col("x").alias("b"))
    probes = written(probes, "probes")
    small = hot.count() <= 1_000_000
    marks = F.broadcast(hot.select("part", "value")) if small else hot.select("part", "value").hint("shuffle_hash")
    cold = probes.join(marks, ["part", "value"], "left_anti").join(data.join(marks, ["part", "value"], "left_anti"), ["part", "value"]).where((F.col("q") < F.col("x")) & differ("q", "x"))
    asked = probes.join(marks, ["part", "value"], "left_semi").groupBy("part", "value").agg(F.count(F.lit(1)).alias("nq"))
    grid = written(hot.join(asked, ["part", "value"]).select("part", "value", F.ceil(F.col("nq") / BLOCK).cast("int").alias("i"), F.ceil(F.col("nx") / BLOCK).cast("int").alias("j")), "grid")
    grid_ = F.broadcast(grid) if small else grid.hint("shuffle_hash")
    dealt = lambda c, own: F.pmod(F.xxhash64(c), F.col(own)).cast("int")
    rows = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = probes.join(grid_, ["part", "value"]).select("part", "value", dealt("q", "i").alias("i"), rows("j").alias("j"), F.lit(0).alias("side"), F.col("q").alias("x"))
    right = data.join(grid_, ["part", "value"]).select("part", "value", rows("i").alias("i"), dealt("x", "j").alias("j"), F.lit(1).alias("side"), "x")
    cells = left.unionByName(right).withColumn("cell", F.concat_ws(":", "part", "value", "i", "j")).select("cell", "side", "x")
    return cold.select(F.col("q").alias("a"), F.col("x").alias("b")).unionByName(cells.groupBy("cell").applyInArrow(lambda t: _within(t, most), "a long, b long"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, most: int = 3, parts: int | None = None) -> DataFrame:
    """id_col, fingerprint (16 lowercase hex digits), component_id: the smallest id reachable over links, the row's own included.

    Words lie between ASCII white space, A-Z in lower case; a bit is set if it is in over half the XXH64 (seed 42) of the text's n-word shingles,
    repeats included, space-joined. Fewer words are one shingle. Null, empty and wordless texts have fingerprint zero, which links like
    any other. Two rows link if their fingerprints differ in `most` bits or fewer. Rows that repeat an id are rows like others; those with a
    null id get the smallest id they reach, null if there is none. Very long texts are taken whole: a task holds about 60 bytes a word of its longest one.
    Empty tables give no rows. Columns other than these two are ignored, whatever their names.

    parts: how many partitions; None: as many as cost least for the number of different fingerprints. The result is the same.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    known = written(fingerprints(rows, n), "fingerprints")
    distinct = written(known.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    total = distinct.count()
    groups = grouped_bits(co_occurrence(distinct), total, parts or parts_for(total))
    plan = Partitions([len(g) for g in groups], most)
    x = written(permuted(distinct, [b for g in groups for b in g], f"fp long, rep {kind}"), "permuted")
    pieces = F.array(*(F.struct(F.lit(i).alias("piece"), F.shiftrightunsigned("x", low).bitwiseAND(F.lit((1 << w) - 1)).cast("int").alias("value")) for i, (_, low, w) in enumerate(plan.pieces)))
    counts = x.select(F.explode(pieces).alias("v")).groupBy("v.piece", "v.value").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 4 * 2**16 rows
    plan.count([(r["piece"], r["value"], r["n"]) for r in counts], total)
    label = components(written(links(x, plan), "links"))
    named = x.select("x", "fp", "rep").join(label.withColumnRenamed("id", "x"), "x", "left").withColumn("label", F.coalesce("label", "x"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    of = written(named.join(smallest, "label").select("fp", "component_id"), "components-of")
    return met(known, of, "fp").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
