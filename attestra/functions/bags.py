"""Texts as bags of characters: which of two blocks of texts share enough of them, and the first that is similar."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd

#: Fixed value: columns that are multiplied at a time.
COLUMNS = 1 << 12


def blocks(most: int, characters: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows _s, _p, _t (scope, place, text) in order to one row a block of texts of a scope (so many at most, of so many characters if they are several):
    _s, _low, _high (its first and last place), _places, _texts."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scope, places, texts, size = None, [], [], 0
        told = lambda: pd.DataFrame({"_s": [scope], "_low": [places[0]], "_high": [places[-1]], "_places": [places], "_texts": [texts]})
        for batch in batches:
            for s, p, t in zip(batch["_s"], batch["_p"].tolist(), batch["_t"], strict=True):
                if texts and (s != scope or p < places[-1] or len(texts) == most or size + len(t) > characters):
                    yield told()
                    places, texts, size = [], [], 0
                scope, size = s, size + len(t)
                places.append(p)
                texts.append(t)
        if texts:
            yield told()

    return cut


class Bags:
    """How often each text of a block has each of its characters, where it has it: row, character and count, by character."""

    def __init__(self, texts: Sequence[str]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        both, self.count = np.unique(points * len(texts) + np.repeat(np.arange(len(texts)), self.sizes), return_counts=True)
        self.char, self.row = np.divmod(both, len(texts))

    def columns(self, chars: np.ndarray, of: np.ndarray, least: np.ndarray) -> np.ndarray:
        """A row a text: whether it has the character chars[of] at least so often."""
        a, z = np.searchsorted(self.char, chars[0]), np.searchsorted(self.char, chars[-1], "right")
        at = np.searchsorted(chars, self.char[a:z])
        known = chars[at] == self.char[a:z]
        counts = np.zeros((len(self.sizes), len(chars)), np.int64)
        counts[self.row[a:z][known], at[known]] = self.count[a:z][known]
        return (counts[:, of] >= least).astype(np.float32)


def shared(x: Bags, y: Bags) -> np.ndarray:
    """How many characters each text of x shares with each of y, each as often as in both."""
    out = np.zeros((len(x.sizes), len(y.sizes)), np.float32)
    if not len(x.char):
        return out
    chars, begin = np.unique(x.char, return_index=True)
    most = np.maximum.reduceat(x.count, begin)
    of = np.repeat(np.arange(len(chars)), most)
    least = np.arange(len(of)) - np.repeat(np.cumsum(most) - most, most) + 1
    for f in range(0, len(of), COLUMNS):
        some, l = of[f : f + COLUMNS], least[f : f + COLUMNS]
        part = chars[some[0] : some[-1] + 1], some - some[0], l
        out += x.columns(*part) @ y.columns(*part).T
    return out


def first_similar(ratio: Callable[[pd.Series, pd.Series], pd.Series], least: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows _j, _places, _texts in order (a block's own row, whose _j is -1, then blocks of earlier texts) to _p, _o, _r, a row for each text of the block:
    the place and ratio of the first earlier text as similar, else -1. A text meets others until one is found, and ratio only those that share enough characters."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told = lambda: pd.DataFrame({"_p": own, "_o": other, "_r": value})
        own = None
        for batch in batches:
            for j, places, texts in zip(batch["_j"], batch["_places"], batch["_texts"], strict=True):
                places, texts = np.asarray(places, np.int64), np.asarray(texts, object)
                if j < 0:
                    if own is not None:
                        yield told()
                    own, other, value = places, np.full(len(places), -1), np.full(len(places), np.nan)
                    mine, left, bags = texts, np.arange(len(texts)), Bags(texts)
                elif len(left):
                    theirs = Bags(texts)
                    near = 2.0 * shared(bags, theirs) >= least * (bags.sizes[:, None] + theirs.sizes) - 1e-9
                    row, col = np.nonzero(near & (places < own[left][:, None]))
                    at, end = (np.searchsorted(row, np.arange(len(left)), side) for side in ("left", "right"))
                    while len(going := np.flatnonzero(at < end)):
                        i = at[going]
                        r = ratio(pd.Series(mine[left[row[i]]]), pd.Series(texts[col[i]])).to_numpy(np.float64)
                        hit = r >= least
                        found = left[row[i[hit]]]
                        other[found], value[found] = places[col[i[hit]]], r[hit]
                        at[going] = np.where(hit, end[going], i + 1)
                    if len(lacking := left[other[left] < 0]) < len(left):
                        left, bags = lacking, Bags(mine[lacking])
        if own is not None:
            yield told()

    return search
