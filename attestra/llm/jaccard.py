"""Exact n-gram Jaccard self join by universe partition, and connected components of its links.

Documents are sets of hashed word shingles. Sets of one size band are cut at the same places of the hash range into
segments. Two sets that link differ in H elements at most, so out of e exact segments and d segments that are also
indexed with each one element deleted (e + 2d = H + 1 + slack, allocated per band by expected cost) they share keys worth
1 + slack. A set may therefore leave out its `slack` most frequent exact keys: copies and common passages are met in rarer
segments. Keys are packed by bucket in numpy as 40 bits each beside 40 bits of their set's digest; digests that meet in these bits
are candidates of each other. Keys that are frequent within one task's pack leave it by other, salted buckets.

Copies are one class from the start (equal 128-bit set digests). Keys shared by few classes give their pairs. The others
give, first, a pair of each member with the leader it shares most keys with. A pair's parity sketches, about 1.4 bits a shingle,
differ in no more cells than the sets differ in elements: pairs whose sketches differ in too many cannot link. All others are verified on
whole texts. Only where verified links have not connected all members of a key by then, its cluster is compared block by
block, first on sketches, then, inside tasks that count shared shingles and return connecting links alone, on the texts of what is left.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quality import words_of
from .shared import Rolling, chunks, drop_written, met, mix, release, small_batches, utf8, word_hashes, written

#: Classes on a key up to which all pairs are candidates at once.
FEW = 8
#: Index entries in one bucket, about. A set's 40 bits are sent once a bucket, so fewer buckets take less room.
BUCKET = 3 << 20
#: Index entries that a task packs at once, about.
PACK = 1 << 19
#: Classes in a block of those that frequent keys bring together.
BLOCK = 8192
#: Shingles in such a block, about.
BLOCK_SHINGLES = 1 << 21
_BAND = 1.5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_words = Rolling(32)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a digest that the index carries.
REF = (1 << 40) - 1


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = _LOWER[data]
    starts, ends = words_of(data, offs)
    rolled = _words.prefix(word_hashes(data, starts, ends, 31))
    first = np.searchsorted(starts, offs)
    k = len(starts)
    grams = _words.of(rolled, np.arange(max(0, k - n + 1)), np.arange(n, k + 1) if k >= n else np.zeros(0, np.int64))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            h = np.sort(grams[a : b - n + 1])
            out.append(h[np.append(True, h[1:] != h[:-1])])
        elif b > a:
            out.append(_words.of(rolled, np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    return int(mix(s).sum(dtype=np.uint64).view(np.int64)), int(mix(s * _ODD + np.uint64(7)).sum(dtype=np.uint64).view(np.int64))


def sketch(s: np.ndarray) -> bytes:
    """Of each cell of a table of one to two cells a shingle (64 at least, a power of 2), whether an odd number of elements falls into it."""
    cells = 1 << max(6, (len(s) - 1).bit_length())
    odd = np.bincount((mix(s + _ODD) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(words: np.ndarray, n: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) as they would be with n words."""
    while words.shape[-1] > n:
        words = words[..., : words.shape[-1] // 2] ^ words[..., words.shape[-1] // 2 :]
    return words


def may_link(differ: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of x and y elements that differ in `differ` or more may link."""
    return (differ * (100 + percent) <= (x + y) * (100 - percent)) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))


class Bands:
    """Size bands for a threshold in percent, and each band's segments."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * _BAND)))

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.low, size, "right")) - 1

    def wanted(self, size: int) -> range:
        """The bands in which the larger set of a link with this one may be."""
        return range(self.of(size), self.of(size * 100 // self.percent) + 1)

    def differ(self, band: int) -> int:
        """The most elements in which two linked sets differ, the larger of which is in this band."""
        return 2 * (self.low[band + 1] - 1) * (100 - self.percent) // (100 + self.percent)

    def slack(self, band: int) -> int:
        return 0 if self.differ(band) == 0 else 1 + self.differ(band) // 10

    @functools.cache
    def layout(self, band: int) -> tuple[int, int, int, np.ndarray]:
        """(exact segments, segments with deletions, where segments begin in the hash range)."""
        high = self.low[band + 1] - 1
        need = self.differ(band) + 1 + self.slack(band)

        size = (self.low[band] + high) / 2

        def cost(d: int) -> float:
            """Keys of a set, and how often a segment holds so few elements that its keys tell little."""
            e = need - 2 * d
            one = size / (e + 2 * d)
            return e + d * (2 * one + 1) + 20 * (e * math.exp(-one) + d * math.exp(-2 * one) * (1 + 2 * one))

        d = min(range(min(need // 2, 8) + 1), key=cost)
        e = need - 2 * d
        return e, d, np.array([(i << 64) // need for i in [*range(0, 2 * d, 2), *range(2 * d, need)]], np.uint64)  # those with deletions are twice as wide

    def keys(self, s: np.ndarray, band: int) -> np.ndarray:
        """The index keys of a sorted set; the lowest byte is the band, plus 128 for segments with deletions."""
        _, d, begins = self.layout(band)
        at = np.append(np.searchsorted(s, begins), len(s))
        x = mix(s ^ _ODD)
        total = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(x, out=total[1:])
        segment = np.arange(len(begins), dtype=np.uint64)
        tag = (segment + np.uint64(band << 32) + np.uint64(1)) * _ODD
        whole = total[at[1:]] - total[at[:-1]]
        out = mix(whole + tag) & ~np.uint64(255) | np.uint64(band)
        out[:d] |= np.uint64(128)
        if not d:
            return out
        of = np.repeat(np.arange(d), np.diff(at[: d + 1]))
        return np.concatenate([out, mix(whole[of] - x[: at[d]] + tag[of]) & ~np.uint64(255) | np.uint64(band | 128)])


def _rows(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    data, offs = utf8(column)
    for i, j in chunks(offs):
        for k, s in enumerate(shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n)):
            yield i + k, s


def classes(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, th, n_shingles, the set's digest (d1, d2) and its sketch, of columns doc_id, th and text."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), *digest(s), sketch(s) if len(s) else b"") for _, s in _rows(batch.column(2), n)]
            size, d1, d2, bits = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, pa.int64()) for x in (size, d1, d2)), pa.array(bits, pa.binary())], names=["doc_id", "th", "n_shingles", "d1", "d2", "bits"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, f"doc_id {kind}, th long, n_shingles long, d1 long, d2 long, bits binary")


_PACKED = "bucket int, keys binary, tags binary, refs binary, bands binary, many binary"


def _short(x: np.ndarray) -> bytes:
    """The low five bytes of each word."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _long(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def _named(keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """A key as it is named outside its bucket: 40 bits of it, 16 of the bucket, the tag."""
    return keys >> np.uint64(24) << np.uint64(24) | (bucket & np.uint64(0xFFFF)) << np.uint64(8) | keys & np.uint64(255)


def _index(docs: DataFrame, n: int, bands: Bands, buckets: int) -> DataFrame:
    """Packed keys by bucket (40 bits and the tag), of each set that has some there (40 bits of its digest, its band) one after the other; many:
    how many keys each has. A task gives a set once. Keys that more than FEW sets of a pack share go to a bucket from `buckets` on, by
    the pack, under their names; the key's own bucket gets, for those, their number in place of a set (band 255)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(bucket: int, keys: np.ndarray, who: np.ndarray, refs: np.ndarray, own: np.ndarray) -> tuple:
            first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            return bucket, _short(keys >> np.uint64(24)), (keys & np.uint64(255)).astype(np.uint8).tobytes(), _short(refs[who[first]]), own[who[first]].tobytes(), np.diff(np.append(first, len(who))).astype(np.uint32).tobytes()

        def pack() -> pa.RecordBatch:
            keys, who = np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held])
            refs, own = np.array(ids, np.uint64), np.array(sizes, np.uint8)
            bucket = (keys >> np.uint64(8)) % np.uint64(buckets)
            rows = []
            by = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.append(True, keys[by][1:] != keys[by][:-1]))
            size = np.diff(np.append(first, len(by)))
            if (size > FEW).any():
                frequent = np.zeros(len(keys), bool)
                frequent[by[np.repeat(size > FEW, size)]] = True
                hot = np.flatnonzero(frequent)
                named = _named(keys[hot], bucket[hot])
                rows.append((buckets + int(refs[0] % np.uint64(buckets)), named.tobytes(), b"", refs[who[hot]].tobytes(), b"", b""))
                at = by[first[size > FEW]]  # one entry a frequent key: its number instead of a set
                stay = np.flatnonzero(~frequent)
                keys, bucket = np.concatenate([keys[stay], keys[at]]), np.concatenate([bucket[stay], bucket[at]])
                who = np.concatenate([who[stay], len(refs) + np.arange(len(at))])
                refs, own = np.concatenate([refs, size[size > FEW].astype(np.uint64)]), np.concatenate([own, np.full(len(at), 255, np.uint8)])
            order = np.argsort(bucket, kind="stable")
            keys, who, bucket = keys[order], who[order], bucket[order]
            at = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            rows += [row(int(bucket[a]), keys[a:b], who[a:b], refs, own) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[c] for r in rows], pa.binary()) for c in range(1, 6))], names=["bucket", "keys", "tags", "refs", "bands", "many"])

        held, ids, sizes, seen, many = [], [], [], set(), 0
        for batch in batches:
            for _, s in _rows(batch.column(0), n):
                if not len(s) or (d := digest(s)) in seen:
                    continue
                if len(seen) >= 1 << 20:
                    seen.clear()
                seen.add(d)
                keys = np.concatenate([bands.keys(s, b) for b in bands.wanted(len(s)) if bands.differ(b)] or [np.zeros(0, np.uint64)])
                if len(keys):
                    held.append(keys)
                    ids.append(d[0] & REF)
                    sizes.append(bands.of(len(s)))
                    many += len(keys)
                if many >= PACK:
                    yield pack()
                    held, ids, sizes, many = [], [], [], 0
        if held:
            yield pack()

    return docs.select("text").mapInArrow(run, _PACKED)


_PAIR, _HOT, _COUNT = 0, 1, 2
_FOUND = "kind int, a long, b long, hot long, worth int, band int"


def _candidates(table: pa.Table, buckets: int) -> pa.Table:
    """Of one bucket: pairs (a, b: sets; worth: what the keys they share are worth); frequent keys' sets (a: set, b: key, hot: how many sets have it,
    0 if that is counted elsewhere); numbers of frequent keys (b: key, hot: how many sets have it)."""
    at = table.column("bucket")[0].as_py()
    names, columns = ["kind", "a", "b", "hot", "worth", "band"], {"keys": [], "ref": [], "own": []}

    def rows(kind: int, a: np.ndarray, b: np.ndarray, hot: np.ndarray, worth: np.ndarray, band: np.ndarray) -> pa.Table:
        return pa.table([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(hot.astype(np.int64)), pa.array(worth.astype(np.int32)), pa.array(band.astype(np.int32))], names=names)

    band_of = lambda key: (key & np.uint64(127)).astype(np.int64)
    if at >= buckets:
        key = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")])
        ref = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("refs")])
        zero = np.zeros(len(key), np.int64)
        return rows(_HOT, ref, key.view(np.int64), zero, zero, band_of(key))
    for keys, tags, refs, own, many in zip(*(table.column(c) for c in ("keys", "tags", "refs", "bands", "many")), strict=True):
        many = np.frombuffer(many.as_py(), np.uint32)
        columns["keys"].append(_long(keys.as_py()) << np.uint64(8) | np.frombuffer(tags.as_py(), np.uint8).astype(np.uint64))
        columns["ref"].append(np.repeat(_long(refs.as_py()), many))
        columns["own"].append(np.repeat(np.frombuffer(own.as_py(), np.uint8), many))
    key, who, own = (np.concatenate(x) for x in columns.values())
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    order = order[np.append(same, False) | np.append(False, same) | (own[order] == 255)]  # most keys have one set
    order = order[np.lexsort((who[order], own[order] == 255, key[order]))]
    key, who, own = key[order], who[order], own[order]
    number = own == 255
    new = np.append(True, (key[1:] != key[:-1]) | (who[1:] != who[:-1]) | number[1:]) if len(key) else np.zeros(0, bool)
    key, who, own, number = key[new], who[new], own[new], number[new]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    each = np.diff(np.append(first, len(key)))
    more = np.add.reduceat(np.where(number, who, 0).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    some = np.add.reduceat(number.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    total = each - some + more
    name = _named(key >> np.uint64(8) << np.uint64(24) | key & np.uint64(255), np.full(len(key), at, np.uint64)).view(np.int64)
    counted = first[some > 0]
    group, count = np.repeat(np.arange(len(first)), each)[~number], np.repeat(total, each)[~number]
    numbers = rows(_COUNT, np.zeros(len(counted)), name[counted], total[some > 0], np.zeros(len(counted)), band_of(key[counted]))
    key, who, own, name = key[~number], who[~number], own[~number], name[~number]
    kept = {c: [np.zeros(0, np.int64)] for c in ("a", "b", "worth", "band")}
    few, band, worth = count <= FEW, band_of(key), 1 + (key >> np.uint64(7) & np.uint64(1)).astype(np.int64)
    for step in range(1, FEW):
        n = max(0, len(key) - step)
        i = np.flatnonzero(few[:n] & (group[:n] == group[step:]))
        i = i[np.maximum(own[i], own[i + step]) == band[i]]
        for c, x in (("a", who[i]), ("b", who[i + step]), ("worth", worth[i]), ("band", band[i])):
            kept[c].append(x.astype(np.int64))
    kept = {c: np.concatenate(x) for c, x in kept.items()}
    pairs, at, back = np.unique(np.stack([kept["a"], kept["b"]], 1), axis=0, return_index=True, return_inverse=True)
    shared = np.bincount(back.reshape(-1), kept["worth"], len(pairs))
    hot = np.flatnonzero(~few)
    return pa.concat_tables([numbers, rows(_PAIR, pairs[:, 0], pairs[:, 1], np.zeros(len(pairs)), shared, kept["band"][at]), rows(_HOT, who[hot], name[hot], count[hot], np.zeros(len(hot)), band[hot])])


def near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b: class ids) whose sketches do not rule a link out; sets: cid, n_shingles, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_numpy() for c in (2, 3))
            differ = np.zeros(batch.num_rows, np.int64)
            for k, (p, q) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                p, q = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
                n = min(len(p), len(q))
                differ[k] = np.bitwise_count(folded(p, n) ^ folded(q, n)).sum()
            good = pa.array(np.flatnonzero(may_link(differ, x, y, percent)))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(good) for c in (0, 1)], names=["a", "b"])

    side = lambda c: sets.select(F.col("cid").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))
    met_ = pairs.join(side("b"), "b").join(side("a"), "a")
    return met_.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b: class ids) whose sets link; texts: cid, d1 (of its set), text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            a, good = batch.column(0).to_pylist(), []
            da, db = (batch.column(c).to_numpy() for c in (4, 5))
            right = dict(_rows(batch.column(3), n))
            fresh = [i for i in range(len(a)) if a[i] != (a[i - 1] if i else last)]
            lefts = dict(zip(fresh, (s for _, s in _rows(batch.column(2).take(pa.array(fresh, pa.int64())), n)), strict=True))
            for i in range(len(a)):
                left = lefts.get(i, left)
                r = right[i]
                both = len(np.intersect1d(left, r, assume_unique=True)) if 100 * min(len(left), len(r)) >= percent * max(len(left), len(r)) else 0
                if both and 100 * both >= percent * (len(left) + len(r) - both) and digest(left)[0] == da[i] and digest(r)[0] == db[i]:
                    good.append(i)
            last = a[-1] if a else last
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good, pa.int64())) for c in (0, 1)], names=["a", "b"])

    side = lambda c: texts.select(F.col("cid").alias(c), F.col("text").alias(f"t{c}"), F.col("d1").alias(f"d{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb", "da", "db").mapInArrow(run, "a long, b long")


def _alike(table: pa.Table, percent: int) -> pa.Table:
    """Of two blocks (or one): the members whose sketch does not rule out a link with one of the other block that has another label."""
    label, size, block = (table.column(c).to_numpy() for c in ("label", "n_shingles", "block"))
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    bits = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("bits")]
    n = min(len(x) for x in bits)
    words = np.stack([folded(x, n) for x in bits])
    x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
    y = y[np.argsort(size[y], kind="stable")]
    wy, sy, ly, wanted = words[y], size[y], label[y], np.zeros(len(size), bool)
    for k in x.tolist():
        a, b = np.searchsorted(sy, -(-size[k] * percent // 100), "left"), np.searchsorted(sy, size[k] * 100 // percent, "right")
        a = max(0, a)
        other = np.flatnonzero(ly[a:b] != label[k]) + a
        if not len(other):
            continue
        differ = np.zeros(len(other), np.int64)
        for at in range(0, n, 64):  # 64 words of each at once
            differ += np.bitwise_count(wy[other, at : at + 64] ^ words[k, at : at + 64]).sum(1, dtype=np.int64)
        hit = other[may_link(differ, size[k], sy[other], percent)]
        if len(hit):
            wanted[k] = True
            wanted[y[hit]] = True
    return table.select(["id", "cluster", "label", "block", "i", "j"]).filter(pa.array(wanted))


def _within(table: pa.Table, n: int, percent: int) -> pa.Table:
    """Links between two blocks (or in one), by counting shared shingles through an inverted index; only those that connect what
    labels and earlier links of this call do not."""
    who, label, block, d1 = (table.column(c).to_numpy() for c in ("id", "label", "block", "d1"))
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    sets = [s if digest(s)[0] == d else s[:0] for (_, s), d in zip(_rows(table.column("text").combine_chunks(), n), d1.tolist(), strict=True)]
    size = np.array([len(s) for s in sets], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(every, kind="stable")
    owner = owner[order]
    new = np.append(True, every[order][1:] != every[order][:-1])
    begin = np.flatnonzero(new)
    run = np.empty(len(every), np.int64)
    run[order] = np.cumsum(new) - 1
    begin = np.append(begin, len(every))
    parent = {x: x for x in label.tolist()}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = [], []
    for x in np.flatnonzero(block == i).tolist():
        runs = run[at[x] : at[x + 1]]
        first, many = begin[runs], begin[runs + 1] - begin[runs]
        post = owner[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())]
        both = np.bincount(post, minlength=len(sets))
        good = (100 * both >= percent * (size[x] + size - both)) & (block == j)
        for y in np.flatnonzero(good).tolist():
            if (rx := root(int(label[x]))) != (ry := root(int(label[y]))):
                parent[max(rx, ry)] = min(rx, ry)
                a.append(who[x])
                b.append(who[y])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """id, label: the smallest id reachable over edges (a, b), for each id on an edge. Rounds of neighbours' minima and jumps to the label's
    label, so long chains take few rounds; each round's table is written, none is collected."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{what}-edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), what)
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("label").alias("over"))
        after = written(step.join(jump, "to", "left").select("id", "was", F.least("to", "over").alias("label")), what)
        moved = not after.where("label <> was").isEmpty()
        drop_written(labels)
        labels = after.drop("was")
        if not moved:
            return labels


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """id_col, n_shingles, component_id: the smallest id reachable over links, the row's own included.

    A text's set is its distinct n-word shingles, of words between ASCII white space with A-Z in lower case; a text of fewer words is one
    shingle. Two texts link when 100 * |intersection| >= percent * |union|. Null, empty and wordless texts have empty
    sets and link with nothing. Rows that repeat an id are nodes of their own, as are rows with a null id; these get the smallest id
    they reach, null if there is none. Very long texts are taken whole: a task holds about 100 bytes a word of the longest pair. Empty
    tables give no rows. Columns other than these two are ignored, whatever their names.
    """
    return text_components(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), n, percent).drop("th").withColumnRenamed("doc_id", id_col)


def text_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, th (xxhash64 of the text, which tells rows that repeat an id apart), n_shingles, component_id of columns doc_id and text."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text").withColumn("th", F.xxhash64("text"))
    bands = Bands(percent)
    known = written(classes(docs, n), "sets")
    # One class a digest: its smallest id, and one row's id and text hash, by which its text is found again.
    group = known.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "th", "bits")).alias("at"))
    group = written(group.select(F.monotonically_increasing_id().alias("cid"), "d1", "d2", "n_shingles", "rep", F.col("at.doc_id").alias("src"), F.col("at.th").alias("th"), F.col("at.bits").alias("bits")), "classes")
    refs = group.select("cid", F.col("d1").bitwiseAND(F.lit(REF)).alias("ref"))
    total = known.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(24, math.ceil(0.5 * total / BUCKET))
    packed = _index(docs, n, bands, buckets)
    found = written(packed.groupBy("bucket").applyInArrow(lambda t: _candidates(t, buckets), _FOUND), "candidates")
    del packed
    release(spark)

    # Of the exact keys of a set in a band, its most frequent may stay out, as many as the band has slack.
    slack = F.element_at(F.array(*(F.lit(bands.slack(i)) for i in range(len(bands.low) - 1))), F.col("band") + 1)
    exact = F.col("b").bitwiseAND(F.lit(128)) == 0
    frequent = found.where(F.col("kind") == _HOT).select("a", "b", "hot", "band")
    numbers = written(found.where(F.col("kind") == _COUNT).select("b", F.col("hot").alias("number")), "numbers")
    frequent = frequent.where("hot > 0").unionByName(met(frequent.where("hot = 0").drop("hot"), numbers, "b").withColumnRenamed("number", "hot"))
    # Copies in several tasks' packs are equal rows here, of one rank.
    ranked = frequent.withColumn("exact", exact).withColumn("place", F.dense_rank().over(Window.partitionBy("a", "band", "exact").orderBy(F.desc("hot"), "b")))
    hot = ranked.where(~F.col("exact") | (F.col("place") > slack)).select(F.col("a").alias("ref"), F.col("b").alias("key"), "hot", "band").distinct()
    # Pairs must share keys worth 1 + slack; of those, frequent keys (not counted so far) can be no more than either has.
    has = frequent.groupBy("a", "band").agg(F.sum(F.when(exact, 1).otherwise(2)).alias("frequent"))
    pairs = found.where(F.col("kind") == _PAIR).groupBy("a", "b", "band").agg(F.sum("worth").alias("worth"))
    missing = 1 + slack - F.col("worth")
    open_ = pairs.join(has.select("a", "band", F.col("frequent").alias("fa")), ["a", "band"], "left").join(has.select(F.col("a").alias("b"), "band", F.col("frequent").alias("fb")), ["b", "band"], "left")
    pairs = open_.where(missing <= F.least(F.coalesce("fa", F.lit(0)), F.coalesce("fb", F.lit(0)))).select("a", "b")
    pairs = pairs.join(refs.select(F.col("cid").alias("x"), F.col("ref").alias("a")), "a").join(refs.select(F.col("cid").alias("y"), F.col("ref").alias("b")), "b").select("x", "y")
    same = refs.join(refs.groupBy("ref").count().where("count > 1").select("ref"), "ref")  # digests that agree in the index
    pairs = pairs.unionByName(same.select(F.col("cid").alias("x"), "ref").join(same.select(F.col("cid").alias("y"), "ref"), "ref").where("x < y").select("x", "y"))
    # Copies that were edited at different places are nearest to what they were made from: it has the most frequent keys.
    hot = written(hot.join(refs, "ref").select(F.col("cid").alias("id"), "key", "hot", "band"), "frequent")
    score = hot.groupBy("id").agg(F.sum("hot").alias("score"))
    leaders = hot.join(score, "id").groupBy("key").agg(F.max_by("id", F.struct("score", "id")).alias("leader"))
    led = written(hot.join(leaders, "key").where("id <> leader").select("key", "band", "id", "leader"), "led")
    # One leader of a member is tried: the one it shares most frequent keys with. What that leaves open is settled below.
    best = led.groupBy("id", "leader").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.max_by("leader", F.struct("n", "leader")).alias("y"))
    pairs = pairs.unionByName(best.select(F.col("id").alias("x"), "y")).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def texts(ids: DataFrame, what: str) -> DataFrame:
        """cid, d1 and whole text of these classes (cid): documents are only shuffled for it if there are many."""
        want = written(group.join(ids, "cid").select("cid", "d1", "src", F.col("th").alias("_th")), f"wanted-{what}")
        rows = want.count()
        found = docs.join(F.broadcast(want) if rows <= 1_000_000 else want.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("src")) & (F.col("th") == F.col("_th")))
        found = written(found.select("cid", "d1", "text"), what)
        return found if found.count() == rows else found.dropDuplicates(["cid"])  # rows that repeat id and text

    candidates = written(near(pairs.distinct(), group, percent), "pairs")
    ids = candidates.select(F.col("a").alias("cid")).unionByName(candidates.select(F.col("b").alias("cid"))).distinct()
    links = written(verify(candidates, texts(ids, "texts"), n, percent), "links")
    label = components(links)
    release(spark)
    # What frequent keys still have to tell: members of one key that no chain of links connects yet.
    member = hot.join(label, "id", "left").select("key", "id", "band", F.coalesce("label", "id").alias("label"))
    still = member.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    member = written(member.join(still, "key"), "open")
    if not member.isEmpty():
        # Sets of one band that such keys chain together, compared block by block.
        node = lambda c: F.xxhash64(c, "band")
        chained = components(led.join(still, "key").select(node("leader").alias("a"), node("id").alias("b")), "clusters").select(F.col("id").alias("node"), F.col("label").alias("cluster"))
        member = member.select("id", "label", "band").distinct().withColumn("node", node("id")).join(chained, "node").select("cluster", "id", "label")
        member = member.join(group.select(F.col("cid").alias("id"), "n_shingles", "bits"), "id")
        blocks = member.groupBy("cluster").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("cluster", "blocks")
        member = member.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        member = member.select("id", "cluster", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "n_shingles", "bits")
        # One column as the key, or Spark would leave all of a cluster's block pairs in the task that its members met in.
        alike = written(member.groupBy(F.concat_ws(":", "cluster", "i", "j").alias("cell")).applyInArrow(lambda t: _alike(t, percent), "id long, cluster long, label long, block int, i int, j int"), "alike")
        own = texts(alike.select(F.col("id").alias("cid")).distinct(), "more-texts").withColumnRenamed("cid", "id")
        more = written(alike.join(own, "id").groupBy("cluster", "i", "j").applyInArrow(lambda t: _within(t, n, percent), "a long, b long"), "more-links")
        if not more.isEmpty():
            label = components(links.unionByName(more), "linked")
        release(spark)

    named = group.select("cid", "d1", "d2", "n_shingles", "rep").join(label.withColumnRenamed("id", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    of = named.join(smallest, "label").select("d1", "d2", "n_shingles", "component_id")
    out = known.select("doc_id", "th", "n_shingles", "d1", "d2").join(of, ["d1", "d2", "n_shingles"], "left")
    return out.select("doc_id", "th", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
