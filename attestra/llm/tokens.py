"""Byte-level BPE ids at numpy speed, equal to those of the vocabulary's own tokenizer.

Texts are cut into the vocabulary's pre-tokens by a few vector passes over their code points. Most pre-tokens of a corpus
have been seen before: their ids come out of a cache by hash, compared letter by letter with what is cached, and only new ones go through the tokenizer. Texts that
hold one of its added tokens go through it whole.
"""

from __future__ import annotations

import functools
import os
import unicodedata

import numpy as np

from .shared import word_hashes

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
#: Pre-tokens that a worker's cache holds before it starts anew.
CACHE_ENTRIES = 1_000_000


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _encoder(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


@functools.cache
def _kinds() -> np.ndarray:
    """Space, letter, number or other, by code point."""
    first = {"L": _LETTER, "N": _NUMBER}
    out = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        out[c] = first.get(unicodedata.category(chr(c))[0], _OTHER)
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return out


def cut(chars: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in concatenated code points; ends: where each (non-empty) text ends."""
    n = len(chars)
    kind = _kinds()[chars]
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start[ends[:-1]] = True
    space = kind == _SPACE
    last = np.zeros(n, bool)  # of a text
    last[ends - 1] = True
    before_word = np.zeros(n, bool)  # the last space before something else
    before_word[:-1] = space[:-1] & ~space[1:]
    before_word &= ~last
    start |= before_word
    joins = np.zeros(n, bool)  # what a plain space before it is part of
    joins[1:] = before_word[:-1] & (chars[:-1] == 0x20)
    start &= ~joins
    # Contractions: an apostrophe where a pre-token starts, alone in its run, before s t m d or re ve ll.
    at = np.flatnonzero((chars == 0x27) & start & ~last)
    if len(at):
        after = chars[at + 1]
        two = np.where(~last[at + 1], chars[np.minimum(at + 2, n - 1)], 0)
        short = np.isin(after, np.frombuffer(b"stmd", np.uint8))
        long = ((after == ord("r")) & (two == ord("e"))) | ((after == ord("v")) & (two == ord("e"))) | ((after == ord("l")) & (two == ord("l")))
        for which, size in ((short, 2), (long & ~short, 3)):
            hit = at[which]
            start[hit + 1] = False
            after_it = hit + size
            inside = ~last[after_it - 1]
            start[after_it[inside]] = True
    return np.flatnonzero(start)


class Tokenizer:
    """Ids of many texts at once; keeps its cache between calls."""

    def __init__(self, path: str):
        self.bpe = _encoder(path)
        self.added = [t.content for t in self.bpe.get_added_tokens_decoder().values()]
        self.width = np.zeros(self.bpe.get_vocab_size(), np.int64)
        for token, i in self.bpe.get_vocab().items():
            self.width[i] = len(token)  # a character a byte
        self.clear()

    def plain(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text by the tokenizer alone."""
        return [e.ids for e in self.bpe.encode_batch_fast(texts, add_special_tokens=False)]

    def hashes(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return word_hashes(chars.view(np.uint8), 4 * start, 4 * end, 21)

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.chars = np.zeros(0, np.uint32)  # of all cached pre-tokens
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # where each one's lie there
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        if len(self.keys) > CACHE_ENTRIES:
            self.clear()
        # Pre-tokens without white space, but for a space before them, are cut the same way when joined, those without that space behind a
        # line feed, which is a pre-token and an id of its own: one call for all.
        spaced = np.fromiter((w[0] == " " for w in words), bool, len(words))
        joins = np.fromiter((not w[w[0] == " " :].isspace() and len(w) > (w[0] == " ") for w in words), bool, len(words))
        parts = [w if s_ else "\n" + w for w, s_, j in zip(words, spaced.tolist(), joins.tolist(), strict=True) if j]
        flat = np.asarray(self.plain(["".join(parts)])[0], np.uint32)
        size = np.fromiter((len(w.encode()) for w in parts), np.int64, len(parts))
        ends = np.searchsorted(np.cumsum(self.width[flat]), np.cumsum(size), "left") + 1
        skip = ~spaced[joins]  # the line feed
        rest = self.plain([w for w, j in zip(words, joins.tolist(), strict=True) if not j])
        count, first = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        count[joins] = np.diff(ends, prepend=0) - skip
        first[joins] = len(self.ids) + ends - count[joins]
        count[~joins] = np.fromiter(map(len, rest), np.int64, len(rest))
        first[~joins] = len(self.ids) + len(flat) + np.cumsum(count[~joins]) - count[~joins]
        self.ids = np.concatenate([self.ids, flat, np.fromiter((i for x in rest for i in x), np.uint32, int(count[~joins].sum()))])
        own = np.fromiter(map(len, words), np.int64, len(words))
        own_at = len(self.chars) + np.cumsum(own) - own
        self.chars = np.concatenate([self.chars, np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)])
        at = np.searchsorted(self.keys, keys)  # keys are sorted
        self.keys, self.at, self.size, self.first, self.count = (np.insert(old, at, new) for old, new in ((self.keys, keys), (self.at, own_at), (self.size, own), (self.first, first), (self.count, count)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text in them)."""
        whole = {i for i, t in enumerate(texts) if any(a in t for a in self.added)}
        ids, bounds = self._encode([t if i not in whole else "" for i, t in enumerate(texts)])
        if whole:
            own = dict(zip(sorted(whole), self.plain([texts[i] for i in sorted(whole)]), strict=True))
            lists = [own.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
            return np.concatenate([np.asarray(x, np.uint32) for x in lists]), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        return ids, bounds

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        if not len(chars):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        start = cut(chars, ends[sizes > 0])
        end = np.append(start[1:], len(chars))
        key = self.hashes(chars, start, end)
        seen, which, back = np.unique(key, return_index=True, return_inverse=True)
        known = self._find(seen)
        new = np.flatnonzero(known < 0)
        if len(new):
            at = which[new]
            self._learn(seen[new], [joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            known = self._find(seen)
            if (known < 0).any():  # the cache was started anew
                at = which[known < 0]
                self._learn(seen[known < 0], [joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
                known = self._find(seen)
        entry = known[back]
        size = end - start
        if (self.size[entry] != size).any() or (self.chars[np.repeat(self.at[entry] - start, size) + np.arange(len(chars))] != chars).any():  # two pre-tokens of one key: these texts take the plain way
            lists = self.plain(texts)
            count = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter((i for x in lists for i in x), np.uint32, int(count.sum())), np.concatenate([[0], np.cumsum(count)])
        count = self.count[entry]
        total = np.concatenate([[0], np.cumsum(count)])
        place = np.repeat(self.first[entry] - total[:-1], count) + np.arange(total[-1])
        bounds = np.searchsorted(start, np.concatenate([[0], ends]), "left")
        return self.ids[place], total[bounds]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)
