"""Best-fit packing of tokenised documents by a configuration linear program.

Only the histogram of piece lengths (below the capacity: full pieces fill a sequence each) reaches the driver. A
configuration is a multiset of lengths that fits into one sequence. The program "fewest configurations that cover every
length's count" is solved by multiplicative weights: lengths that are covered least weigh most, and a knapsack dynamic program
prices the best configuration under the weights, until all but a thousandth of the tokens is covered. Multiplicities are
rounded down, then up by their fractions where the counts allow; what is left over goes best-fit decreasing into the room that configurations leave. Every piece then finds its place from its
length and its rank within that length alone.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import chunks, small_batches, utf8, written

CAPACITY = 1024
#: The share of tokens that the program may leave uncovered. As full configurations waste nothing and tokens / capacity bounds the sequences
#: from below, this is also the duality gap of the part that is covered by full ones.
GAP = 1e-3


def price(lengths: np.ndarray, values: np.ndarray, capacity: int, slack: float = 0.005, most: int = 16) -> list[np.ndarray]:
    """The multiset (as counts) of greatest value whose lengths sum to capacity at most, and up to most - 1 others that are worth no less than
    1 - slack of it: best ones that hold a given length. lengths ascend."""
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if m := fits[c]:
            got = best[c - lengths[:m]] + values[:m]
            i = int(got.argmax())
            if got[i] > best[c]:
                best[c], take[c] = got[i], i
    worth = values + best[capacity - lengths]
    out: dict[bytes, np.ndarray] = {}
    for i in np.argsort(-worth, kind="stable").tolist():
        if worth[i] < (1 - slack) * best[capacity] or len(out) == most:
            break
        counts, c = np.zeros(len(lengths), np.int64), int(capacity - lengths[i])
        counts[i] = 1
        while c > 0:
            if take[c] < 0:
                c -= 1
            else:
                counts[take[c]] += 1
                c -= lengths[take[c]]
        out.setdefault(counts.tobytes(), counts)
    return list(out.values())


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = GAP, eta: float = 1.0) -> list[tuple[np.ndarray, float]]:
    """(configuration, multiplicity) pairs that cover all but `gap` of the counts' tokens. Each configuration covers a length or halves one, so
    there are at most about 31 a length (2.5 to 5 in practice); one pricing finds several of about the same worth."""
    left, out = counts.astype(float), []
    while left @ lengths > gap * (counts @ lengths):
        live = np.flatnonzero(left > 1e-9 * counts)
        if not len(live):
            break
        share = left[live] / counts[live]
        values = lengths[live] * np.exp(eta * (share - share.max()))
        for k, own in enumerate(price(lengths[live], values, capacity)):
            used = np.flatnonzero(own)
            times = (left[live[used]] / own[used]).min()
            if k and times < 2.0:
                continue  # hardly once: what is left has its own prices
            times = max(times * 0.5, min(times, 1.0))
            config = np.zeros(len(lengths), np.int64)
            config[live] = own
            out.append((config, float(times)))
            left -= config * times
    return out


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """The program's configurations and how often each is used, rounded within the counts."""
    merged: dict[bytes, float] = {}
    for config, times in fractional(lengths, counts, capacity, gap):
        merged[config.tobytes()] = merged.get(config.tobytes(), 0.0) + times
    down = [(key, int(times)) for key, times in merged.items()]
    full = lambda key: np.frombuffer(key, np.int64) @ lengths == capacity
    up = [(key, 1) for key, times in sorted(merged.items(), key=lambda x: int(x[1]) - x[1]) if times > int(times) and full(key)]  # largest fractions first
    left, out = counts.copy(), []
    for key, times in down + up:
        config = np.frombuffer(key, np.int64)
        used = np.flatnonzero(config)
        times = min(times, int((left[used] // config[used]).min()))
        if times > 0:
            left -= config * times
            out.append((config, times))
    return out


def plan(histogram: dict[int, int], capacity: int, gap: float = GAP) -> tuple[np.ndarray, int]:
    """Slots (length, first rank, last rank + 1, first sequence, offset), by length and rank, and the number of sequences.

    The piece of rank r in [first, last) of a length goes to sequence first sequence + r - first, at offset. A length's ranks
    run from 0 on. The size of the result depends on the capacity and the rounds, with the logarithm of the counts.
    """
    lengths = np.array(sorted(n for n in histogram if histogram[n]), np.int64)
    counts = np.array([histogram[n] for n in lengths], np.int64)
    done, slots, sequences = np.zeros(len(lengths), np.int64), [], 0
    rooms: dict[int, list[list[int]]] = {}  # free tokens: [first sequence, how many sequences]
    order: list[int] = []

    def room_left(room: int, first: int, many: int) -> None:
        if room > 0 and many > 0:
            if not rooms.get(room):
                insort(order, room)
            rooms.setdefault(room, []).append([first, many])

    for config, times in configurations(lengths, counts, capacity, gap):
        offset = 0
        for i in np.flatnonzero(config)[::-1].tolist():
            for _ in range(config[i]):
                slots.append((lengths[i], done[i], done[i] + times, sequences, offset))
                done[i] += times
                offset += int(lengths[i])
        room_left(capacity - offset, sequences, times)
        sequences += times

    for i in range(len(lengths) - 1, -1, -1):
        size = int(lengths[i])
        while (left := int(counts[i] - done[i])) > 0:
            at = bisect_left(order, size)
            if at == len(order):  # new sequences, with as many of this length as fit
                most = capacity // size
                for each, many in ((most, left // most), (left % most, 1)):
                    if each and many:
                        for k in range(each):
                            slots.append((size, done[i], done[i] + many, sequences, k * size))
                            done[i] += many
                        room_left(capacity - each * size, sequences, many)
                        sequences += many
                continue
            room = order[at]
            first, many = rooms[room].pop()
            times = min(many, left)
            slots.append((size, done[i], done[i] + times, first, capacity - room))
            done[i] += times
            if many > times:
                rooms[room].append([first + times, many - times])
            if not rooms[room]:
                order.pop(at)
            room_left(room - size, first, times)
    return np.array(sorted(slots), np.int64).reshape(-1, 5), sequences


def tokenised_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and (part, k): the piece's rank among those of its length from one task."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import Tokenizer

        task = TaskContext.get()
        part, tokenizer, seen = task.partitionId() if task else 0, Tokenizer(vocabulary), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            _, offs = utf8(batch.column(1))
            for i, j in chunks(offs, 1 << 20):  # few calls, as each sorts new words into the cache
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                ids, bounds = tokenizer.encode(texts)
                rows, docs_of = [], []
                for n in range(len(texts)):
                    own = np.append(ids[bounds[n] : bounds[n + 1]], end_id).astype("<u4")
                    first = len(own) % capacity or capacity
                    at = 0
                    for piece, end in enumerate(range(first, len(own) + 1, capacity)):
                        rows.append((piece, at, end - at, zlib.crc32(own[at:end].tobytes())))
                        docs_of.append(i + n)
                        at = end
                table = np.array(rows, np.int64).reshape(-1, 4)
                length = table[:, 2]
                order = np.argsort(length, kind="stable")
                place = np.arange(len(order)) - np.searchsorted(length[order], length[order])
                rank = np.empty(len(order), np.int64)
                rank[order] = place + seen[length[order]]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(docs_of, pa.int64())), pa.array(table[:, 0].astype(np.int32)), *(pa.array(table[:, c]) for c in (1, 2, 3)), pa.array(np.full(len(rank), part, np.int32)), pa.array(rank)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "k"],
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, k long")


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 2, gap: float = GAP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every document's ids and an end id, in sequences of at most `capacity` ids.

    Only documents of more than capacity ids are cut, into full pieces after a first, perhaps shorter one. Null and empty texts
    are the end id alone. Repeated rows and null ids are packed row by row. Very long texts are tokenised whole, at about 60 bytes of memory
    a character. Empty tables give no rows. Columns other than the id and the text are ignored, whatever their names. sequence_id is any
    number; a sequence's offsets are gapless from 0. Ids are those of the tokenizer, its added tokens' strings in a text included.

    Pieces are written once to the shared folder, so ranks stay what they are when executors are lost.
    """
    pieces = written(tokenised_pieces(docs, vocabulary, id_col, text_col, capacity, end_id), "pieces")
    short = pieces.where(F.col("length") < capacity)
    by_part = short.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots, _ = plan(histogram, capacity, gap)
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "length", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = short.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("k")).alias("rank"))
    shift = np.int64(1 << 44)
    slot_keys = slots[:, 0] * shift + slots[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            slot = slots[np.searchsorted(slot_keys, length * shift + rank, "right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(slot[:, 3] + rank - slot[:, 1]), pa.array(slot[:, 4])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = dict(pieces.dtypes)["doc_id"]
    placed = ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    # Full pieces have their sequence to themselves: numbers from 2**62 on, by task and rank.
    whole = pieces.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (F.lit(1 << 62) + F.shiftleft(F.col("part").cast("long"), 38) + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(whole)
