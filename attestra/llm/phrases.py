"""Phrase collocation mining over vertical positional inverted lists.

Texts are dealt to shards of about SHARD words. A shard holds, for each word of a language, the ascending list of its positions; behind
a piece's last word a position stays free, so phrases never cross pieces. A phrase's list holds where it ends. It is extended by
merging its positions, one on, with the postings of the words that are frequent: what meets is the longer phrase's list, and its length
the exact frequency within the shard. A phrase is extended only where the phrase of its last words and the new one may be frequent too.

Which phrases may be frequent is found out length by length: shards send 40 bits of each phrase's hash with the list's length, packed by
bucket, buckets add lengths up, and each shard gets back a bit a phrase. Hashes that meet only let more phrases through. What is left at the
end is counted under its text, so results rest on no hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import chunks, drop_written, met, mix, release, small_batches, utf8, word_hashes, written

#: Words of a shard, about.
SHARD = 1 << 20
#: Phrases that one bucket adds up, about.
BUCKET = 3 << 20
#: Parts of a language's candidates that are ranked before the language is.
PARTS = 64

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


def words_of_pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, whether a piece begins) of the words of texts side by side."""
    kind = _KIND[data]
    word = kind == 0
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    piece = np.cumsum(kind == 2)
    edge = np.zeros(len(data) + 1, np.int64)
    edge[inner] = 1
    piece = piece + np.cumsum(edge[:-1])
    return starts, ends, np.append(True, np.diff(piece[starts]) != 0)[: len(starts)]


_SHARD = "shard long, lang string, words binary, counts binary, positions binary"


def _packed(positions: np.ndarray) -> bytes:
    """Positions as differences, all first bytes before all second ones, compressed."""
    steps = np.diff(positions, prepend=0).astype("<i4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(steps.T).view("<i4").reshape(-1), dtype=np.int64)


def _shards(docs: DataFrame) -> DataFrame:
    """One row a shard and language: its words (a space between them), how many positions each has, and the positions, word after word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        many = 0

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang, parts in held.items():
                data = np.concatenate([d for d, _, _ in parts])
                size = np.concatenate([s for _, s, _ in parts])
                begins = np.concatenate([b for _, _, b in parts])
                offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                every = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offs), pa.py_buffer(data)).dictionary_encode()
                code = every.indices.to_numpy().astype(np.int64)
                position = (np.arange(len(code)) + np.cumsum(begins))[np.argsort(code, kind="stable")]
                counts = np.bincount(code, minlength=len(every.dictionary)).astype("<i4")
                words = " ".join(every.dictionary.to_pylist()).encode()
                yield pa.RecordBatch.from_arrays([pa.array([task << 32 | made], pa.int64()), pa.array([lang]), *(pa.array([x], pa.binary()) for x in (words, counts.tobytes(), _packed(position)))], names=["shard", "lang", "words", "counts", "positions"])
                made += 1

        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, offs = utf8(batch.column(1))
            for i, j in chunks(offs):
                body, own = _LOWER[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i]
                starts, ends, begins = words_of_pieces(body, own)
                at = np.searchsorted(starts, own)
                for k in np.flatnonzero(np.diff(at)).tolist():
                    a, z = at[k], at[k + 1]
                    text = body[own[k] : own[k + 1]]
                    held.setdefault(langs[i + k] or "und", []).append((text[_KIND[text] == 0], ends[a:z] - starts[a:z], np.append(True, begins[a + 1 : z])))
                many += len(starts)
                if many >= SHARD:
                    yield from rows()
                    held, many = {}, 0
        yield from rows()

    return docs.select("lang", "text").mapInArrow(run, _SHARD)


def _pairs_of(ends: np.ndarray, phrase: np.ndarray, positions: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, word, position) where a phrase's end, one on, is a word's position: a merge of two lists by position."""
    by, to = np.argsort(ends), np.argsort(positions)
    at = np.searchsorted(positions[to], ends[by] + 1)
    hit = at < len(positions)
    hit[hit] = positions[to][at[hit]] == ends[by][hit] + 1
    return phrase[by][hit], word[to][at[hit]], ends[by][hit] + 1


class _Shard:
    """A shard's postings and its phrases' lists, of one length after the other."""

    def __init__(self, lang: str, words: bytes, counts: bytes, positions: bytes, buckets: int):
        self.lang, self.buckets = lang, buckets
        data = np.frombuffer(words, np.uint8)
        ends = np.append(np.flatnonzero(data == 0x20), len(data))
        starts = np.append(0, ends[:-1] + 1)
        self.offs, self.data = np.append(starts, len(data) + 1), data
        self.hashes = word_hashes(data, starts, ends, zlib.crc32(lang.encode()))
        counts = np.frombuffer(counts, "<i4")
        self.ends, self.phrase = _unpacked(positions), np.repeat(np.arange(len(counts)), counts)
        self.position, self.word = self.ends, self.phrase
        self.terms, self.n = np.arange(len(counts))[:, None], counts.astype(np.int64)  # the words of each phrase, and how many positions it has
        self.known: list[tuple[np.ndarray, np.ndarray]] = []
        self._order()

    def _order(self) -> None:
        h = np.zeros(len(self.terms), np.uint64)
        for c in range(self.terms.shape[1]):
            h = mix((h ^ self.hashes[self.terms[:, c]]) * _ODD)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.hash = (h >> np.uint64(24))[self.order]
        at = bucket[self.order]
        self.first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
        self.last, self.bucket = np.append(self.first, len(at))[1:], at[self.first]

    def packs(self) -> list[tuple[int, bytes, bytes]]:
        """(bucket, 40 bits of each phrase's hash there, how many positions each has)."""
        short = np.ascontiguousarray(self.hash.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
        n = self.n[self.order].astype("<u4")
        return [(b, short[a:z].tobytes(), n[a:z].tobytes()) for b, a, z in zip(self.bucket.tolist(), self.first.tolist(), self.last.tolist(), strict=True)]

    def keep(self, marks: list[dict]) -> None:
        """Leaves what the buckets let through: a bit a phrase, as packs() had them."""
        good = np.zeros(len(self.terms), bool)
        where = dict(zip(self.bucket.tolist(), zip(self.first.tolist(), self.last.tolist(), strict=True), strict=True))
        for m in marks:
            a, z = where[m["bucket"]]
            good[self.order[a:z]] = np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=z - a).astype(bool)
        own = good[self.phrase]
        self.ends, self.phrase = self.ends[own], self.phrase[own]
        if self.terms.shape[1] == 1:
            self.position, self.word = self.ends, self.phrase
        self.known.append((self.terms[good], self.n[good]))

    def extend(self) -> None:
        """Makes the lists one word longer. The phrase of the last words, as many as now, has to be left too."""
        phrase, word, at = _pairs_of(self.ends, self.phrase, self.position, self.word)
        if self.terms.shape[1] > 1:
            ok = np.isin(at, self.ends)
            phrase, word, at = phrase[ok], word[ok], at[ok]
        step = len(self.hashes)
        found, back, self.n = np.unique(phrase * step + word, return_inverse=True, return_counts=True)
        self.terms = np.column_stack([self.terms[found // step], found % step])
        self.ends, self.phrase = at, back.reshape(-1)
        self._order()

    def texts(self) -> Iterator[tuple[pa.Array, np.ndarray, int]]:
        """(phrases, how many positions each has, words) of what was kept."""
        words = pa.LargeStringArray.from_buffers(len(self.offs) - 1, pa.py_buffer(self.offs), pa.py_buffer(np.append(self.data, np.uint8(0x20))))
        for terms, n in self.known:
            for a in range(0, len(terms), 50_000):
                own = terms[a : a + 50_000]
                parts = [pc.utf8_rtrim(words.take(pa.array(own[:, c])), " ") for c in range(own.shape[1])]
                yield pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())).cast(pa.string()), n[a : a + len(own)], own.shape[1]


def _read(batch: pa.RecordBatch, buckets: int) -> Iterator[tuple[int, _Shard]]:
    """Each shard of a batch, as far as its marks tell."""
    for r in range(batch.num_rows):
        shard = _Shard(batch.column(1)[r].as_py(), *(batch.column(c)[r].as_py() for c in (2, 3, 4)), buckets)
        for c in range(5, batch.num_columns):
            if c > 5:
                shard.extend()
            shard.keep(batch.column(c)[r].as_py() or [])
        yield batch.column(0)[r].as_py(), shard


def _summed(table: pa.Table, least: int) -> pa.Table:
    """Of one bucket: for each shard with some phrase whose hash is found `least` times or more in all, a bit a phrase."""
    shards, hashes, counts = (table.column(c).to_pylist() for c in ("shard", "hashes", "counts"))
    size = np.array([len(h) // 5 for h in hashes])
    wide = np.zeros((int(size.sum()), 8), np.uint8)
    wide[:, :5] = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 5)
    key, n = wide.view("<u8").reshape(-1), np.frombuffer(b"".join(counts), "<u4").astype(np.int64)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    good = np.zeros(len(key), bool)
    good[order] = np.repeat(np.add.reduceat(n[order], first) >= least, np.diff(np.append(first, len(order))))
    ends = np.cumsum(size)
    out = [(s, np.packbits(good[z - k : z]).tobytes()) for s, k, z in zip(shards, size.tolist(), ends.tolist(), strict=True) if good[z - k : z].any()]
    bucket = table.column("bucket")[0].as_py()
    return pa.table([pa.array([s for s, _ in out], pa.int64()), pa.array([bucket] * len(out), pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["shard", "bucket", "bits"])


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a: its frequency if `least` or more, of 1 to `most` words; lang and n: its words in all)."""
    spark = docs.sparkSession
    small_batches(spark)
    shards = written(_shards(docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))), "postings")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(np.frombuffer(x.as_py(), "<i4").sum(dtype=np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["lang", "n"])

    totals = written(shards.select("lang", "counts").mapInArrow(sizes, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    buckets = max(24, -(-(totals.agg(F.sum("n")).first()[0] or 0) // BUCKET))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, own in _read(batch, buckets):
                if batch.num_columns > 5:
                    own.extend()
                rows = own.packs()
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in rows], pa.int32()), pa.array([shard] * len(rows), pa.int64()), *(pa.array([r[c] for r in rows], pa.binary()) for c in (1, 2))], names=["bucket", "shard", "hashes", "counts"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, (_, own) in enumerate(_read(batch, buckets)):
                for phrase, n, words in own.texts():
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(1)[r].as_py()] * len(n), pa.string()), phrase, pa.array(np.full(len(n), words, np.int32)), pa.array(n)], names=["lang", "phrase", "words", "a"])

    read = shards
    for words in range(1, most + 1):
        found = read.mapInArrow(packed, "bucket int, shard long, hashes binary, counts binary")
        bits = found.groupBy("bucket").applyInArrow(lambda t: _summed(t, least), "shard long, bucket int, bits binary")
        marks = bits.groupBy("shard").agg(F.collect_list(F.struct("bucket", "bits")).alias(f"m{words}"))  # a bit a phrase of the shard
        # Shards without any word left have no longer phrases either.
        known = written(marks if words == 1 else known.join(marks, "shard", "left"), f"marks-{words}")
        del found, bits, marks
        release(spark)
        read = shards.join(known.hint("shuffle_hash"), "shard").select(*shards.columns, *(f"m{k}" for k in range(1, words + 1)))
    every = read.mapInArrow(counted, "lang string, phrase string, words int, a long").groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    every = written(every, "frequent")
    drop_written(shards)
    release(spark)
    return every, totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = 3, least: int = 10, first: int = 2000, share: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `first` best phrases of 2 to `most` words found `least` times or more.

    A-Z in lower case; texts are cut at `[.,;:!?\\x0A-\\x0D]` into pieces and those at spaces and tabs into words. a counts a phrase's occurrences
    within pieces, overlaps included; n all words of the language. A phrase's score is the lowest floor(1000000 * a * a / (l * r)) over its
    cuts into a first part of frequency l and a rest of r (ties: the shortest first part). Phrases inside a longer candidate of at least `share` percent of their
    frequency are left out. Ranked by score and a, descending, then the phrase by its bytes.

    Null languages are `und`; null, empty and wordless texts have no phrases. Rows that repeat count as often. Very long texts are taken whole, in
    lists of their own shard. Empty tables give no rows. Columns other than these two are ignored, whatever their names. Products are exact up to
    38 digits: frequencies to 10**15.
    """
    every, totals = phrase_counts(docs, lang_col, text_col, most, least)
    split = F.split("phrase", " ", -1)
    join = lambda a, n: F.array_join(F.slice("ws", a, n), " ")
    longer = written(every.where("words > 1").withColumn("ws", split), "candidates")
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    # Each candidate's cuts, with the frequencies of both parts.
    cuts = longer.select("lang", "phrase", "a", "ws", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", join(1, F.col("k")).alias("left"), join(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    known = lambda part, f: every.select("lang", F.col("phrase").alias(part), F.col("a").alias(f))
    cuts = cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"])
    exact = F.expr("CAST(CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0)) AS DECIMAL(31,0)) * CAST(1000000 AS DECIMAL(7,0)) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
    scored = cuts.select("lang", "phrase", "a", "l", "r", "k", exact.cast("long").alias("score"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("x")).select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")
    # What lies inside a longer candidate: the greatest frequency of those.
    inside = longer.where("words > 2").select("lang", "a", "ws", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inside = inside.select("lang", "a", "ws", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at")).select("lang", "a", join(F.col("at"), F.col("size")).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    left = lowest.join(inside, ["lang", "phrase"], "left").where(F.col("over").isNull() | (whole("over") * 100 < whole("a") * share)).drop("over")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*best)
    some = written(left.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= first).drop("_r"), "best-of-parts")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= first)
    return met(ranked, totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
