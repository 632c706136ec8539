"""Exact substring dedup: bytes inside any string of `length` bytes that starts at another place too are removed.

Every window of `length` bytes names, by content alone, one gram in it (the smallest hash, leftmost on ties): its anchor. Equal
windows have equal anchors, so windows only need to be compared within an anchor. Consecutive windows with one anchor
travel as one context. Anchors at one place in the whole corpus end there; contexts that occur as a whole elsewhere are
settled by 128 bits of hash (of the anchor and of the context). Where many contexts are left of one anchor, they are cut into halves by how far before it
their windows begin, again and again, and each part is named by all the bytes that its windows share. What is left is sorted per anchor by the suffix that starts at the anchor: a mergesort in
which two suffixes meet by the binary search of their common extension on prefix polynomial hashes, so a comparison
takes logarithmic time. Neighbours' extensions are then checked byte by byte. Windows are equal if their suffixes share enough,
by the sorted order, and the bytes before the anchor are equal, which is checked byte by byte too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Rolling, chunks, drop_written, met, mix, release, small_batches, utf8, written

GRAM = 50
#: Distinct contexts of one anchor up to which one task sorts them; beyond, they are cut into parts with more bytes in common.
SORTED = 8192
#: Contexts that one task sorts, about.
BUCKET = 6000
#: Bytes of texts handled at once, and of a longer text's segments; about 100 bytes of memory go with each.
PART, SEGMENT = 1 << 18, 1 << 20
_one = Rolling(41)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first window start, last window start, anchor place - first start, anchor hash) per context; places count from the text's begin."""
    size = np.diff(offs)
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    long = np.flatnonzero(size >= length)
    if not len(long) or len(data) < length:
        return none
    at = np.arange(len(data) - gram + 1)
    grams = mix(_one.between(_one.prefix(data), at, at + gram))
    least, k, w = grams & ~_PLACE | at.astype(np.uint64), 1, length - gram + 1
    while 2 * k <= w:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if w > k:
        least = np.minimum(least[: len(least) - (w - k)], least[w - k :])
    place = (least & _PLACE).astype(np.int64)
    valid = np.zeros(len(place) + 1, np.int64)
    np.add.at(valid, offs[long], 1)
    np.add.at(valid, offs[long] + size[long] - length + 1, -1)
    valid = np.cumsum(valid)[:-1] > 0
    change = np.append(True, place[1:] != place[:-1])
    change[1:] |= ~valid[:-1]
    first = np.flatnonzero(valid & change)
    ends = np.append(change[1:] | ~valid[1:], True)
    last = np.flatnonzero(valid & ends)
    doc = np.searchsorted(offs, first, "right") - 1
    return doc, first - offs[doc], last - offs[doc], place[first] - first, grams[place[first]]


class _Suffixes:
    """Contexts side by side, and comparisons of what starts at their anchors."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray):
        self.data, self.begin, self.end, self.at = data, begin, end, at
        self.hashed = _one.prefix(data)

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        return _one.between(self.hashed, a, a + n) == _one.between(self.hashed, b, b + n)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the suffixes of contexts i and j agree: a binary search over hashes."""
        a, b = self.at[i], self.at[j]
        low = np.zeros(len(i), np.int64)
        high = np.minimum(self.end[i] - a, self.end[j] - b)
        while (live := low < high).any():
            mid = (low + high + 1) // 2
            ok = self.same(a, b, mid)
            low, high = np.where(live & ok, mid, low), np.where(live & ~ok, mid - 1, high)
        return low

    def less(self, i: np.ndarray, j: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether i's suffix sorts before j's; equal ones as `ties` says."""
        n = self.common(i, j)
        a, b = self.at[i] + n, self.at[j] + n
        done_a, done_b = a >= self.end[i], b >= self.end[j]
        top = len(self.data) - 1
        return np.where(done_a & done_b, ties, np.where(done_a | done_b, done_a, self.data[np.minimum(a, top)] < self.data[np.minimum(b, top)]))

    def sort(self, group_begin: np.ndarray, group_size: np.ndarray) -> np.ndarray:
        """Contexts in order within their groups (each group's contexts lie side by side): bottom-up merges."""
        n = len(self.at)
        order = np.arange(n)
        begin, size = np.repeat(group_begin, group_size), np.repeat(group_size, group_size)
        rank = np.arange(n) - begin
        width = 1
        while len(own := np.flatnonzero(size > width)):
            j, run = rank[own], rank[own] // width
            low = (run ^ 1) * width
            end = np.minimum(low + width, size[own])
            lo, hi = np.minimum(low, end), end.copy()
            left = run % 2 == 0
            base = lo.copy()
            while (live := np.flatnonzero(lo < hi)).size:
                mid = (lo[live] + hi[live]) // 2
                # An element of the left run goes before equal ones of the right run.
                before = self.less(order[begin[own[live]] + mid], order[own[live]], ~left[live])
                lo[live], hi[live] = np.where(before, mid + 1, lo[live]), np.where(before, hi[live], mid)
            place = begin[own] + (run // 2) * 2 * width + (j - run * width) + (lo - base)
            after = order.copy()
            after[place] = order[own]
            order = after
            width *= 2
        return order

    def extensions(self, order: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """What each context in order shares with the one before it, checked on the bytes; 0 where a group begins."""
        out = np.zeros(len(order), np.int64)
        i = np.flatnonzero(inner)
        out[i] = self.common(order[i - 1], order[i])
        for a in range(0, len(i), 1000):
            own = i[a : a + 1000]
            n = out[own]
            step = np.arange(int(n.max(initial=0)))
            x, y = self.at[order[own - 1]], self.at[order[own]]
            top = len(self.data) - 1
            differ = (self.data[np.minimum(x[:, None] + step, top)] != self.data[np.minimum(y[:, None] + step, top)]) & (step < n[:, None])
            wrong = differ.any(1)
            out[own[wrong]] = differ[wrong].argmax(1)
        return out


def _equal(data: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> bool:
    """Whether the n bytes from each x on are those from its y on."""
    if not n:
        return True
    every = np.lib.stride_tricks.sliding_window_view(data, n)
    return all((every[x[i : i + 4096]] == every[y[i : i + 4096]]).all() for i in range(0, len(x), 4096))


def repeats(anchor: np.ndarray, off: np.ndarray, starts: np.ndarray, data: np.ndarray, bounds: np.ndarray, length: int) -> np.ndarray:
    """Which windows occur twice or more: a flag per window, contexts side by side. Contexts are sorted by anchor; bounds are theirs in data;
    starts: windows of each; off: where its anchor lies in it."""
    n = len(anchor)
    flag_at = np.concatenate([[0], np.cumsum(starts)])
    flags = np.zeros(flag_at[-1], bool)
    s = _Suffixes(data, bounds[:-1], bounds[1:], bounds[:-1] + off)
    head = np.append(True, anchor[1:] != anchor[:-1])
    begin = np.flatnonzero(head)
    order = s.sort(begin, np.diff(np.append(begin, n)))
    shared = s.extensions(order, ~head)
    off_, starts_, at_ = off[order], starts[order], s.at[order]
    for back in range(int(off.max(initial=-1)) + 1):
        own = np.flatnonzero((off_ >= back) & (off_ - back < starts_))
        if len(own) < 2:
            continue
        group = np.cumsum(head | (shared < length - back))[own]
        a, z = at_[own] - back, at_[own]
        key = mix(_one.between(s.hashed, a, z) + group.astype(np.uint64) * _ODD)
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        if not _equal(data, a[by[1:][same]], a[by[:-1][same]], back) or (group[by[1:][same]] != group[by[:-1][same]]).any():
            named: dict[tuple[int, bytes], int] = {}  # a collision: by the bytes themselves
            key = np.array([named.setdefault((int(g), data[x : x + back].tobytes()), len(named)) for g, x in zip(group, a, strict=True)])
            by = np.argsort(key, kind="stable")
            same = key[by][1:] == key[by][:-1]
        hit = np.unique(np.concatenate([own[by[1:][same]], own[by[:-1][same]]]))
        flags[flag_at[order[hit]] + off_[hit] - back] = True
    return flags


def runs(flags: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, last + 1) of consecutive flags, which never cross contexts; at: where each context's flags begin."""
    head = np.zeros(len(flags) + 1, bool)
    head[at] = True
    first = np.flatnonzero(flags & (head[:-1] | ~np.append(False, flags[:-1])))
    last = np.flatnonzero(flags & (head[1:] | ~np.append(flags[1:], False))) + 1
    who = np.searchsorted(at, first, "right") - 1
    return who, first - at[who], last - at[who]


_CONTEXT = "anchor long, k long, lo long, n int, off int, body binary"


def narrower(length: int, gram: int, width: int):
    """Cuts contexts by how far before the anchor their windows begin, in ranges of `width`. A part's anchor is the hash of all bytes that any
    window of its range covers; ctx that of the whole part."""
    most = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "k", "lo", "n", "off", "body", "ctx"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
        for batch in batches:
            out, held = [], 0
            for _, k, lo, n, off, body in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                for r in range(max(0, off - n + 1) // width, off // width + 1):
                    near, far = r * width, min(r * width + width - 1, most)
                    first, last = max(0, off - far), min(n - 1, off - near)
                    if first > last:
                        continue
                    part = body[first : last + length]
                    anchor = xxhash.xxh3_64_intdigest(body[off - near : off - far + length], seed=width << 16 | r)
                    out.append((_signed(anchor), k, lo + first, last - first + 1, off - first, part, _signed(xxhash.xxh3_64_intdigest(part, seed=1))))
                    held += len(part) + 64
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = GRAM) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans and kept (binary): each text's UTF-8 without the bytes covered by any string of `length` bytes that
    starts anywhere else too, in its own or another row. Strings are judged on the input; overlaps count. Very long texts are cut into
    segments of SEGMENT bytes that overlap by length - 1, so their windows are all there and memory stays bounded.

    Null and empty texts have no bytes; texts shorter than `length` lose none. Rows with equal texts, repeated ids or null ids are
    rows like others: a text of `length` bytes or more with a copy goes as a whole. Empty tables give no rows.
    Columns other than these two are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("k", F.xxhash64("text", F.hash("text"), F.octet_length("text")))
    long = rows.where(F.octet_length("text") >= length)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            key = batch.column(0).to_numpy()
            data, offs = utf8(batch.column(1))
            for i, j in chunks(offs, PART):
                own = []
                for x in range(i, j):
                    if int(key[x]) not in seen:
                        seen.add(int(key[x]))
                        own += [(x, a, min(a + SEGMENT + length - 1, int(offs[x + 1]))) for a in range(int(offs[x]), int(offs[x + 1]), SEGMENT)]
                if len(seen) > 1 << 20:
                    seen.clear()
                if not own:
                    continue
                parts = [own] if own[-1][2] - own[0][1] <= SEGMENT else [[o] for o in own]  # one long text alone
                for part in parts:
                    body = np.concatenate([data[a:z] for _, a, z in part])
                    ends = np.concatenate([[0], np.cumsum([z - a for _, a, z in part])])
                    doc, lo, hi, off, anchor = anchors(body, ends, length, gram)
                    view = memoryview(body)
                    ctx = np.fromiter((xxhash.xxh3_64_intdigest(view[a:z]) for a, z in zip((ends[doc] + lo).tolist(), (ends[doc] + hi + length).tolist(), strict=True)), np.uint64, len(doc))
                    k = key[[x for x, _, _ in part]][doc]
                    lo = lo + np.array([a - offs[x] for x, a, _ in part])[doc]
                    p = mix(k.view(np.uint64) + (lo.astype(np.uint64) + np.uint64(1)) * _ODD)
                    n = hi - lo + np.array([a - offs[x] for x, a, _ in part])[doc] + 1
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(p.view(np.int64)), pa.array(k), pa.array(lo), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32))], names=["anchor", "ctx", "p", "k", "lo", "n", "off"])

    every = written(long.select("k", "text").mapInArrow(contexts, "anchor long, ctx long, p long, k long, lo long, n int, off int"), "contexts")
    # Written, as an aggregation in the join's own stage would keep Spark from splitting a frequent anchor's rows.
    again = written(every.groupBy("anchor").agg(F.min("p").alias("x"), F.max("p").alias("y")).where("x <> y").select("anchor"), "again")
    some = written(every.join(again, "anchor"), "repeated-anchors")
    drop_written(every)
    release(spark)

    # Contexts that occur as a whole elsewhere are settled; one of each stays to be compared with.
    one = some.groupBy("anchor", "ctx").agg(F.min("p").alias("x"), F.max("p").alias("y"), F.min(F.struct("p", "k", "lo", "n", "off")).alias("at"))
    one = written(one.select("anchor", "ctx", (F.col("x") != F.col("y")).alias("whole"), "at.k", "at.lo", "at.n", "at.off"), "distinct-contexts")
    settled = some.join(one.where("whole").select("anchor", "ctx"), ["anchor", "ctx"]).select("k", F.col("lo").alias("s"), (F.col("lo") + F.col("n") + (length - 1)).alias("e"))
    copied = long.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.max(F.octet_length("text")).cast("long").alias("e")).where("c > 1").select("k", F.lit(0).cast("long").alias("s"), "e")

    count = written(one.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "counts")
    open_ = one.join(count, "anchor")
    sizes = count.agg(F.sum("c").alias("all"), F.max("c").alias("most")).first()
    ranges = settled.unionByName(copied)
    if sizes["all"]:
        want = open_.groupBy("k").agg(F.collect_list(F.struct("anchor", "lo", "n", "off", (F.col("c") > SORTED).alias("hot"))).alias("want"))
        # Only texts with such contexts are shuffled; which ones is a table of keys.
        keys = written(open_.select("k").distinct(), "wanted")
        texts = met(rows, keys, "k").join(want.hint("shuffle_hash"), "k").select("doc_id", "text", "k", "want")

        def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                key, lists, lines = batch.column(2).to_pylist(), batch.column(3), batch.column(1)
                out: list[tuple] = []
                held = 0
                for i, k in enumerate(key):
                    if k in seen:
                        continue
                    seen.add(k)
                    text = lines[i].as_py().encode()
                    for w in lists[i].as_py():
                        body = text[w["lo"] : w["lo"] + w["n"] + length - 1]
                        out.append((w["anchor"], k, w["lo"], w["n"], w["off"], body, w["hot"]))
                        held += len(body) + 64
                    if held > 4 << 20:
                        yield _contexts_batch(out)
                        out, held = [], 0
                if out:
                    yield _contexts_batch(out)

        found = written(texts.mapInArrow(bodies, _CONTEXT + ", hot boolean"), "bodies")
        del texts
        release(spark)
        buckets = max(24, -(-sizes["all"] // BUCKET))

        def compare(table: pa.Table) -> pa.Table:
            table = table.take(np.lexsort(tuple(table.column(c).to_numpy() for c in ("lo", "k", "anchor"))))
            k, lo, anchor = (table.column(c).to_numpy() for c in ("k", "lo", "anchor"))
            if len(k):  # a text that came twice
                table = table.filter(pa.array(np.append(True, (k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (anchor[1:] != anchor[:-1]))))
            k, lo, anchor, n, off = (table.column(c).to_numpy() for c in ("k", "lo", "anchor", "n", "off"))
            ends = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor))
            found, begin = [], 0
            while begin < len(anchor):  # whole anchors, a bounded number of contexts at once
                end = int(ends[max(np.searchsorted(ends, begin, "right"), np.searchsorted(ends, begin + BUCKET, "right") - 1)])
                own = n[begin:end].astype(np.int64)
                joined = b"".join(table.column("body").slice(begin, end - begin).to_pylist())
                flags = repeats(anchor[begin:end], off[begin:end].astype(np.int64), own, np.frombuffer(joined, np.uint8), np.concatenate([[0], np.cumsum(own + length - 1)]), length)
                who, first, last = runs(flags, np.cumsum(own) - own)
                found.append((k[begin + who], lo[begin + who] + first, lo[begin + who] + last + length - 1))
                begin = end
            return pa.table([np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ()))], names=["k", "s", "e"])

        def compared(some: DataFrame, contexts: int) -> DataFrame:
            bucket = F.pmod("anchor", F.lit(max(24, -(-contexts // BUCKET))))
            return some.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(compare, "k long, s long, e long")

        ranges = ranges.unionByName(compared(found.where("NOT hot").drop("hot"), sizes["all"]))
        hot, level = (found.where("hot").drop("hot"), 1) if sizes["most"] > SORTED else (None, 0)
        while hot is not None:
            release(spark)
            width = -(-(length - gram + 1) >> level)
            parts = written(hot.mapInArrow(narrower(length, gram, max(1, width)), _CONTEXT + ", ctx long"), f"parts-{level}")
            same = written(parts.groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("k", "lo")).alias("one")).where("c > 1"), f"same-{level}")
            ranges = ranges.unionByName(parts.join(same, ["anchor", "ctx"]).select("k", F.col("lo").alias("s"), (F.col("lo") + F.col("n") + (length - 1)).alias("e")))
            if width <= 1:
                break  # a part is one window by now, and equal parts are equal windows
            parts = parts.join(same, ["anchor", "ctx"], "left").where(F.col("c").isNull() | (F.struct("k", "lo") == F.col("one"))).drop("c", "one", "ctx")
            count = written(parts.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), f"counts-{level}")
            sizes = count.agg(F.sum("c").alias("all"), F.max("c").alias("most")).first()
            if sizes["all"]:
                parts = parts.join(count, "anchor")
                ranges = ranges.unionByName(compared(parts.where(F.col("c") <= SORTED).drop("c"), sizes["all"]))
            hot, level = (parts.where(F.col("c") > SORTED).drop("c"), level + 1) if (sizes["most"] or 0) > SORTED else (None, 0)

    lists = ranges.groupBy("k").agg(F.collect_list(F.struct("s", "e")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            removed, many, kept = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), []
            size = np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(1).to_pylist()):
                body = text.encode()
                size[i] = len(body)
                if spans[i].is_valid:
                    flat = spans[i].values
                    s, e = flat.field("s").to_numpy(), flat.field("e").to_numpy()
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate(e[order])
                    new = np.append(True, s[1:] > e[:-1])
                    first, last = s[new], e[np.append(new[1:], True)]
                    many[i], removed[i] = len(first), int((last - first).sum())
                    body = b"".join(body[a:z] for a, z in zip([0, *last.tolist()], [*first.tolist(), len(body)], strict=True))
                kept.append(body)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(removed), pa.array(many), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = dict(rows.dtypes)["doc_id"]
    joined = rows.join(lists.hint("shuffle_hash"), "k", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("doc_id", id_col)


def _contexts_batch(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["anchor", "k", "lo", "n", "off", "body", "hot"])
