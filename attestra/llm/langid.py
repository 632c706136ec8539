"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the byte n-grams (n = 2, 3, 4) of a text with A-Z in lower case and other ASCII non-letters as spaces, hashed
into buckets. A text is the mean of its buckets' embeddings; embeddings and softmax are trained together by stochastic
gradient descent in numpy on a bounded sample. As both layers are linear, a bucket's share of every
language's logit is one table row, and prediction is a mean of rows over the whole text. A temperature fitted on a
part of the sample that is kept apart calibrates scores. A softmax alone is sure of texts in no language it knows, so the row also holds how
familiar the bucket is, the logarithm of its share in training. Both limits for rejection, of the score and of the mean familiarity, come from the
part kept apart: each lies below all its rightly predicted texts, by half of the distance from the lowest of them to their median, or higher, where
that rejects so many wrongly predicted texts that it outweighs the right ones it costs (RIGHT wrong ones for each).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import chunks, small_batches, unused, utf8

GRAMS = (2, 3, 4)
BITS = 15
#: The sample that a model is fitted on: rows in all, characters of a row (of a longer text one piece, at a place by its id's hash).
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000
#: How far below the lowest rightly predicted text of the calibration part the limits lie, in distances from it to the median.
BELOW = 0.5
#: As how many wrong answers let through a right one that is rejected counts.
RIGHT = 5.0

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def buckets(data: np.ndarray) -> list[np.ndarray]:
    """For each n, the bucket of the n-gram that starts at each byte."""
    b = _FOLD[data].astype(np.uint32)
    out, code = [], b
    for n in range(2, max(GRAMS) + 1):
        code = code[:-1] | (b[n - 1 :] << np.uint32(8 * (n - 1))) if len(code) > 0 else code
        if n in GRAMS:
            out.append((((code ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def _features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.concatenate(buckets(np.frombuffer(text, np.uint8)))
    ids, counts = np.unique(found, return_counts=True)
    return ids, (counts / max(1, counts.sum())).astype(np.float32)


class Model:
    """langs, rows: a bucket's part of every logit and its familiarity, bias, temperature; threshold and least: the limits of score and familiarity.
    false_rejections and caught: of the calibration part, the shares of right predictions and of wrong ones that these reject."""

    def __init__(self, langs: list[str], rows: np.ndarray, bias: np.ndarray):
        self.langs, self.rows, self.bias = langs, rows, bias
        self.temperature, self.threshold, self.least = 1.0, 0.0, -np.inf
        self.false_rejections, self.caught = 0.0, 0.0

    def logits(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logits of each text, and its mean familiarity (-inf without any n-gram)."""
        n = len(offs) - 1
        total, count = np.zeros((n, len(self.langs) + 1), np.float64), np.zeros(n, np.int64)
        for k, found in zip(GRAMS, buckets(data), strict=True):
            own = np.maximum(np.diff(offs) - k + 1, 0)
            some = np.flatnonzero(own)
            if not len(some):
                continue
            # Sums from one text's first n-gram to its last; those that cross into the next text lie between.
            cuts = np.stack([offs[some], np.minimum(offs[some] + own[some], len(found))], 1).reshape(-1)
            values = self.rows[found]
            values = np.concatenate([values, np.zeros((1, values.shape[1]), values.dtype)])
            total[some] += np.add.reduceat(values, cuts, axis=0, dtype=np.float64)[::2]
            count += own
        mean = total / np.maximum(count, 1)[:, None]
        return mean[:, :-1] + self.bias, np.where(count > 0, mean[:, -1], -np.inf)

    def scores(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The calibrated probabilities of each text, and whether it is rejected."""
        z, familiar = self.logits(data, offs)
        z = np.exp((z - z.max(1, keepdims=True)) / self.temperature)
        z /= z.sum(1, keepdims=True)
        return z, self.rejects(z.max(1), familiar)

    def rejects(self, score: np.ndarray, familiar: np.ndarray) -> np.ndarray:
        return (score < self.threshold) | (familiar < self.least)


def train(texts: list[str], langs: list[str], dim: int = 16, epochs: int = 8, rate: float = 4.0, batch: int = 64, seed: int = 7) -> Model:
    """A model of the languages given; every fifth text is kept apart for calibration, but for those whose language has no other text. Without any
    left, the temperature is 1 and nothing is rejected by score or familiarity: texts in training never calibrate."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], np.int64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held = np.zeros(len(texts), bool)
    held[order[::5]] = True
    known = np.zeros(len(names), bool)
    known[y[~held]] = True
    held &= known[y]
    held, used = np.flatnonzero(held), np.flatnonzero(~held)
    embed = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (dim, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    data = [t.encode() for t in texts]
    examples = []
    for i in used.tolist():
        examples.append((*_features(data[i]), y[i]))
        if len(data[i]) > 80:  # short texts are scored too
            size = int(rng.integers(20, 200))
            at = int(rng.integers(0, max(1, len(data[i]) - size)))
            examples.append((*_features(data[i][at : at + size]), y[i]))
    steps, done = epochs * -(-len(examples) // batch), 0
    for _ in range(epochs if len(names) > 1 else 0):
        turn = rng.permutation(len(examples))
        for a in range(0, len(turn), batch):
            own = [examples[i] for i in turn[a : a + batch] if len(examples[i][0])]
            if not own:
                continue
            ids, weight = np.concatenate([e[0] for e in own]), np.concatenate([e[1] for e in own])[:, None]
            size = np.array([len(e[0]) for e in own])
            starts = np.cumsum(size) - size
            hidden = np.add.reduceat(embed[ids] * weight, starts, axis=0)
            z = hidden @ out + bias
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(own)), [e[2] for e in own]] -= 1
            step = rate * (1 - done / steps)
            back = z @ out.T
            out -= step / len(own) * hidden.T @ z
            bias -= step / len(own) * z.mean(0)
            np.subtract.at(embed, ids, step * weight * np.repeat(back, size, axis=0) * 4)
            done += 1
    share = np.zeros(1 << BITS)
    for ids, weight, _ in examples:
        share[ids] += weight
    familiar = np.log((share + 0.1 * len(examples) / len(share)) / max(1, len(examples)) * len(share))
    model = Model(names, np.column_stack([embed @ out, familiar.astype(np.float32)]), bias.astype(np.float64))
    if not len(held):
        return model
    offs = np.concatenate([[0], np.cumsum([len(data[i]) for i in held])]).astype(np.int64)
    joined = np.frombuffer(b"".join(data[i] for i in held), np.uint8)
    parts = [model.logits(joined[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in chunks(offs, 1 << 18)]  # a row of the model a byte
    z, familiar = (np.concatenate(x) for x in zip(*parts, strict=True))
    truth = y[held]

    def loss(t: float) -> float:
        p = z / t - (z / t).max(1, keepdims=True)
        return float((np.log(np.exp(p).sum(1)) - p[np.arange(len(p)), truth]).mean())

    model.temperature = min((0.1 * 1.15**k for k in range(40)), key=loss)
    p = np.exp((z - z.max(1, keepdims=True)) / model.temperature)
    top = p.max(1) / p.sum(1)
    right = (p.argmax(1) == truth) & np.isfinite(familiar)
    if right.any():
        finite = np.where(np.isfinite(familiar), familiar, -1e9)
        model.threshold, model.least = limit(top, right), limit(finite, right)
        gone = model.rejects(top, familiar)
        model.false_rejections, model.caught = float(gone[right].mean()), float(gone[~right].mean()) if (~right).any() else 0.0
    return model


def limit(x: np.ndarray, right: np.ndarray) -> float:
    """The limit below which an answer of measure x is rejected: of the one below all right answers and those just above each wrong one, that of least
    cost (wrong answers let through, and RIGHT for each right one rejected), the lowest on ties."""
    low = float(x[right].min() - BELOW * (np.median(x[right]) - x[right].min()))
    wrong = np.sort(x[~right])
    at = np.concatenate([[low], np.nextafter(wrong[wrong >= low], np.inf)])
    cost = RIGHT * np.searchsorted(np.sort(x[right]), at, "left") - np.searchsorted(wrong, at, "left")
    return float(at[int(cost.argmin())])


def shares(counts: dict[str, int], rows: int) -> dict[str, int]:
    """How many of each language's rows fit into `rows` when all get alike, none more than it has, and each at least one."""
    out, room = {}, rows
    for k, lang in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[lang] = min(counts[lang], max(1, room // (len(counts) - k)))
        room = max(0, room - out[lang])
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model | None:
    """A model from at most `rows` texts (of at most `chars` characters each: of a longer text a piece, at a place by its id's hash) of the rows of docs whose
    crc32(id as text) mod 3 is not 1 and whose text and language are not null. Room is shared evenly over languages, what a rare one leaves goes to the others, and each
    gets its first rows by a hash of the id; one text a language where there are more languages than rows. None without such rows."""
    pool = docs.where((F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) != 1) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in pool.groupBy(F.col(lang_col)).count().collect()}
    if not counts:
        return None
    wanted = shares(counts, rows)
    most = max(wanted.values())
    draw = F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(1 << 30))
    # A language's first rows lie below this bound but for a tiny chance; ranks need not be worked out beyond.
    bounds = [(lang, int(min(1.0, (n + 6 * n**0.5 + 20) / counts[lang]) * (1 << 30)), n) for lang, n in wanted.items()]
    to = F.broadcast(docs.sparkSession.createDataFrame(bounds, f"_l {dict(docs.dtypes)[lang_col]}, _to long, _n long"))
    begin = F.pmod(F.xxhash64(F.lit(29), F.col(id_col)), F.greatest(F.length(text_col) - chars, F.lit(0)) + 1).cast("int") + 1
    drawn = pool.select(F.when(F.length(text_col) > chars, F.substring(F.col(text_col), begin, F.lit(chars))).otherwise(F.col(text_col)).alias("t"), F.col(lang_col).alias("l"), draw.alias("d"), F.col(id_col).cast("string").alias("i")).join(to, F.col("l") == F.col("_l")).where("d < _to")
    rank = F.row_number().over(Window.partitionBy("l").orderBy("d", "i", "t"))
    sample = drawn.withColumn("_r", rank).where((F.col("_r") <= most) & (F.col("_r") <= F.col("_n"))).select("d", "i", "t", "l").collect()
    sample = sorted((r["d"], str(r["i"]), r["t"], r["l"]) for r in sample)
    return train([r[2] for r in sample], [r[3] for r in sample]) if sample else None


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Every row of docs and its columns, with lang_pred, lang_score and lang_rejected.

    lang_pred is `und` (score 0, rejected) where the text is null or has no letter, and everywhere without a model; else the
    most probable of the model's languages. lang_rejected: the calibrated score or the text's familiarity is below the model's limit. Columns of
    docs with these three names are replaced, any others are free. Very long texts are scored whole: a task holds a row of the model a byte of its
    longest one. Empty tables give no rows; repeated rows are scored alike.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("lang_pred", "lang_score", "lang_rejected")))
    names = docs.columns
    at = names.index(text_col)
    letter_, = unused(docs, "letter")
    most = max(1 << 16, (1 << 18) // max(1, len(model.langs) // 8)) if model else 1 << 18

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            pred, score, low = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
            letter = batch.column(len(names)).to_numpy(zero_copy_only=False)
            if model is not None and n:
                data, offs = utf8(batch.column(at))
                langs = np.array(model.langs, object)
                for i, j in chunks(offs, most):
                    p, low[i:j] = model.scores(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    pred[i:j], score[i:j] = langs[p.argmax(1)], p.max(1)
                pred[~letter], score[~letter] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(pred, pa.string()), pa.array(score), pa.array(low | ~letter)], names=[*names, "lang_pred", "lang_score", "lang_rejected"])

    schema = docs.schema.add("lang_pred", "string").add("lang_score", "double").add("lang_rejected", "boolean")
    return docs.withColumn(letter_, F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, schema)
