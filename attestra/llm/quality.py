"""Quality rules: repetition coverage.

Rolling polynomial hashes of word n-grams of several lengths, in numpy, measure how many of a text's
characters lie inside n-grams that occur twice or more in that text, and inside repeated lines. A longer
n-gram can only be repeated where the three-word windows it is made of are, so the longer lengths are hashed at
those places alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WS, Rolling, chunks, mix, small_batches, utf8, word_hashes

#: Largest share of a text's word characters inside repeated n-grams (first occurrence included), by n.
COVERAGE = {5: 0.50, 6: 0.48, 7: 0.46, 8: 0.44, 9: 0.42, 10: 0.40}
#: Largest share of a text's characters in lines that repeat an earlier line.
LINE_CHARS = 0.30
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_IS_WS = np.zeros(256, bool)
_IS_WS[[ord(c) for c in WS]] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_words = Rolling(12)


def _prefixed(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=out[1:])
    return out


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-space bytes; no word crosses a text's end. offs begin at 0."""
    word = ~_IS_WS[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def measure(data: np.ndarray, offs: np.ndarray, texts: list[str | None], lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """The measures of a few texts at once; data and offs hold their UTF-8."""
    n = len(offs) - 1
    starts, ends = words_of(data, offs)
    doc = np.searchsorted(offs, starts, "right") - 1
    lead = _prefixed((data & 0xC0) != 0x80)
    chars = lead[ends] - lead[starts]
    symbols = _prefixed(_IS_SYMBOL[data])
    by_doc = lambda w: np.bincount(doc, w, n).astype(np.int64)
    out = {"n_words": np.bincount(doc, minlength=n).astype(np.int64), "word_chars": by_doc(chars), "n_symbols": symbols[offs[1:]] - symbols[offs[:-1]]}

    rolled = _words.prefix(word_hashes(data, starts, ends))
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))

    def windows(at: np.ndarray, k: int) -> np.ndarray:
        return _repeated(_words.of(rolled, at, at + k) ^ salt[doc[at]])

    def covered(at: np.ndarray, k: int) -> np.ndarray:
        step = np.zeros(len(doc) + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + k, -1)
        return np.cumsum(step[:-1]) > 0

    at = np.flatnonzero(doc[: max(0, len(doc) - 2)] == doc[2:]) if len(doc) > 2 else np.zeros(0, np.int64)
    at = at[windows(at, 3)]
    out["n_repeat_words"] = by_doc(covered(at, 3))
    run = np.zeros(len(doc) + 1, np.int64)  # of consecutive repeated windows, from each place on
    if len(at):
        last = np.flatnonzero(np.append((np.diff(at) != 1) | (doc[at[1:]] != doc[at[:-1]]), True))
        run[at] = at[last[np.searchsorted(last, np.arange(len(at)))]] - at + 1
    for k in lengths:
        here = np.flatnonzero(run[:-1] >= k - 2)
        here = here[here + k <= len(doc)]
        here = here[doc[here] == doc[here + k - 1]]
        here = here[windows(here, k)]
        out[f"dup_{k}gram_chars"] = by_doc(chars * covered(here, k))

    dup, dup_chars = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, text in enumerate(texts):
        if text and "\n" in text:
            seen: set[str] = set()
            for line in text.split("\n"):
                if line in seen:
                    dup[i] += 1
                    dup_chars[i] += len(line)
                elif line.strip(WS):
                    seen.add(line)
    out |= {"n_dup_lines": dup, "dup_line_chars": dup_chars, "n_chars_all": lead[offs[1:]] - lead[offs[:-1]]}
    return out


def repetition_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: Mapping[int, float] = COVERAGE, line_chars: float = LINE_CHARS, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT
) -> DataFrame:
    """One row per row of docs: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    dup_line_chars and dup_<n>gram_chars.

    kept is false if base_failed, if more than `coverage[n]` of the word characters lie in n-grams that occur twice
    or more, or if more than `line_chars` of the characters lie in lines equal to an earlier one.

    Null and empty texts have no words: every count is 0, base_failed is true. Repeated rows and null ids are measured
    like any other row. Empty tables give no rows. Other columns of docs are not read, whatever their names. Work is a map
    over rows without any shuffle; memory follows the longest single text.
    """
    small_batches(docs.sparkSession)
    lengths = tuple(sorted(coverage))
    if lengths and lengths[0] < 3:
        raise ValueError("n-grams of three words or more are measured")
    kind = dict(docs.dtypes)[id_col]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = ["dup_line_chars", *(f"dup_{k}gram_chars" for k in lengths)]
    limits = dict(coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(1))
            for i, j in chunks(offs):
                own = offs[i : j + 1] - offs[i]
                m = measure(data[offs[i] : offs[j]], own, batch.column(1).slice(i, j - i).to_pylist(), lengths)
                failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"])
                bad = failed | (m["dup_line_chars"] > line_chars * m["n_chars_all"])
                for k, most in limits.items():
                    bad |= m[f"dup_{k}gram_chars"] > most * m["word_chars"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *(pa.array(m[c]) for c in counts), pa.array(failed), pa.array(~bad), *(pa.array(m[c]) for c in more)],
                    names=["id", *counts, "base_failed", "kept", *more],
                )

    schema = ", ".join([f"id {kind}", *(f"{c} long" for c in counts), "base_failed boolean", "kept boolean", *(f"{c} long" for c in more)])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
