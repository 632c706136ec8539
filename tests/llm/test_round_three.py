"""Phrase mining, Merkle manifest and SimHash dedup against brute force, on nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from attestra.llm import merkle, phrases, simhash

WS = " \t\n\x0b\x0c\r"


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def told(rng, n, alphabet="abcé"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 2))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    body = [None, "", " \t", "\n.\n", "one", "one two", "A b. C", "x" * 70_000, told(rng, 40_000), "Ab ab AB ab ab, ab ab\nab ab ab"]
    body += [told(rng, rng.choice([2, 9, 60])) + rng.choice([".", ";", "\n"]) + told(rng, 20) for _ in range(40)]
    long = [f"w{rng.randrange(400)}" for _ in range(300)]
    for i in range(14):  # near copies
        own = list(long)
        for _ in range(i % 4):
            own[rng.randrange(300)] = f"e{i}"
        body.append(" ".join(own))
    out = [(i, t, rng.choice(["en", "de", None, "und", "é"]), f"s{i % 3}" if i % 7 else None, None if i % 11 == 0 else len(t or "")) for i, t in enumerate(body)]
    return [*out, out[12], (12, "other text of one id", "en", "s", 3), (None, "no id", None, None, None), (None, body[11], "solo", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns that have the names of the operators' own."""
    more = "tree string, index long, n long, fp long, x int, rep int, phrase string, a int, shard string"
    return spark.createDataFrame([(*r, "t", 1, 2, 3, 4, 5, "p", 6, "s") for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {more}").repartition(3)


def simhash_of(t, n=3):
    w = [x for x in re.split(f"[{WS}]+", lowered(t)) if x]
    grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def joined(nodes, most=3):
    """node -> representative, over links of `most` bits."""
    label = {x: x for x in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in label:
        for b in label:
            if a < b and (a ^ b).bit_count() <= most:
                label[root(a)] = root(b)
    return {x: root(x) for x in label}


@pytest.mark.parametrize("parts", [None, 2, 3])
def test_simhash(docs, rows, parts):
    fp = [simhash_of(t) for _, t, *_ in rows]
    of, least = joined(set(fp)), {}
    for (i, *_), f in zip(rows, fp, strict=True):
        if i is not None:
            least[of[f]] = min(i, least.get(of[f], i))
    want = Counter((i, f"{f:016x}", least.get(of[f])) for (i, *_), f in zip(rows, fp, strict=True))
    assert Counter(tuple(r) for r in simhash.simhash_components(docs, parts=parts).collect()) == want
    assert len({c for _, _, c in want}) < len(want) - 10  # near copies link
    assert simhash.simhash_components(docs.where("false"), parts=parts).count() == 0


@pytest.mark.parametrize(("parts", "few"), [(2, 256), (3, 256), (4, 256), (2, 2), (3, 2), (4, 2)])
def test_every_link_of_skewed_fingerprints_is_found(spark, monkeypatch, parts, few):
    """Clusters around centres, with bits that hardly vary; few = 2: most values are compared in blocks of 16."""
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(parts)
    own = {0}
    for _ in range(12):
        centre = rng.getrandbits(64) & ~0xFFFFF0000
        own |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(25)}
    x = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in own], "x long").repartition(3)
    plan = simhash.Partitions([(64 + parts - 1 - k) // parts for k in range(parts)], 3)
    values = np.array(list(own), np.uint64)
    counted = [(i, int(v), int(n)) for i, (_, low, w) in enumerate(plan.pieces) for v, n in zip(*np.unique(plan.values(values, low, w), return_counts=True), strict=True)]
    plan.count(counted, len(own))
    assert (plan.thresholds(values).sum(1) == 4 - parts).all()
    found = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(x, plan).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in found)
    label = {v: v for v in own}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for a, b in found:
        label[root(a)] = root(b)
    want = joined(own)
    assert len({(root(v), want[v]) for v in own}) == len(set(want.values())) == len({root(v) for v in own})


def test_expected_candidates_and_thresholds_are_the_least():
    rng = np.random.default_rng(2)
    p = simhash.Partitions([6, 5], 3)
    x = rng.integers(0, 1 << 8, 300, dtype=np.uint64)
    p.count([(i, int(v), int(n)) for i, (_, low, w) in enumerate(p.pieces) for v, n in zip(*np.unique(p.values(x, low, w), return_counts=True), strict=True)], len(x))
    cost = p.expected(x)
    for k, (low, w) in enumerate([(0, 6), (6, 5)]):
        v = p.values(x, low, w)
        for t in range(4):
            near = (np.bitwise_count(v[:, None] ^ v[None, :]) <= t).sum(1)
            balls = sum(np.bitwise_count(np.arange(1 << w)) <= t)
            assert np.allclose(cost[k, t], near + simhash.PROBE * balls)
    for i, (a, b) in enumerate(p.thresholds(x).tolist()):
        price = lambda a, b, i=i: sum(cost[k, t, i] if t >= 0 else 0 for k, t in enumerate((a, b)))
        assert a + b == 2 and price(a, b) <= min(price(t, 2 - t) for t in range(-1, 4)) + 1e-9


def test_bits_that_vary_together_are_grouped():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (4000, 64))
    for b in range(1, 20):
        bits[:, 3 * b] = bits[:, 0] ^ (rng.random(4000) < 0.1)
    groups = simhash.grouped_bits((bits.T @ bits).astype(np.int64), 4000, 4)
    assert sorted(b for g in groups for b in g) == list(range(64)) and [len(g) for g in groups] == [16] * 4
    assert max(sum(b % 3 == 0 and b < 60 for b in g) for g in groups) == 16
    assert simhash.grouped_bits(np.zeros((64, 64), np.int64), 0, 3)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_merkle(spark, docs, rows, bits):
    def leaf(r, change=0):
        i, t, lang, source, n = r
        return h(*map(field, (i, source, lang, None if n is None else n + change, t)))

    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0], leaf(r), leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))))

    def grown(nodes):
        """(root, the siblings of each leaf with their side)."""
        level, at, paths = list(nodes), list(range(len(nodes))), [[] for _ in nodes]
        while len(level) > 1:
            for k, i in enumerate(at):
                s = i ^ 1
                paths[k].append(None if s >= len(level) else (s < i, level[s]))
            level, at = [h(*level[i : i + 2]) for i in range(0, len(level), 2)], [i // 2 for i in at]
        return level[0], paths

    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    own = {t: grown([d for _, d, _ in sorted(trees[t], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for t in order}
    root, tops = grown([own[t][0] for t in order])
    want = Counter()
    for t, top in zip(order, tops, strict=True):
        for (i, d, seen), path in zip(sorted(trees[t], key=lambda x: (x[0] is not None, x[0] or 0, x[1])), own[t][1], strict=True):
            x = seen
            for step in path + top:
                x = h(x) if step is None else h(step[1], x) if step[0] else h(x, step[1])
            want[(i, d, own[t][0], root, h(*(s[1] for s in path + top if s)), x, x == root)] += 1
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    assert Counter(tuple(r) for r in merkle.merkle_manifest(docs, columns, tampered, bits=bits).collect()) == want
    assert {v for *_, v in want} == {True, False}
    assert merkle.merkle_manifest(docs.where("false"), columns, tampered).count() == 0
    one = merkle.merkle_manifest(docs.where("lang = 'solo'"), columns, tampered).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == h() and one["verified"]


@pytest.mark.parametrize(("shard", "least", "share"), [(1 << 19, 10, 50), (50, 3, 80)])
def test_collocations(docs, rows, monkeypatch, shard, least, share):
    monkeypatch.setattr(phrases, "SHARD", shard)
    f, n = Counter(), Counter()
    for _, t, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f.update((lang or "und", *w[i : i + k]) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    want = []
    for lang in n:
        ranked = []
        for p, a in candidates.items():
            if p[0] != lang or any(q[0] == lang and len(q) > len(p) and 100 * b >= share * a and p[1:] in (q[1:3], q[2:4]) for q, b in candidates.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[: 1 + k]] * f[(lang, *p[1 + k :])]), k, f[p[: 1 + k]], f[(lang, *p[1 + k :])]) for k in range(1, len(p) - 1))
            ranked.append((-score, -a, " ".join(p[1:]).encode(), left, right))
        want += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(ranked)[:100])]
    assert Counter(tuple(r) for r in phrases.collocations(docs, least=least, first=100, share=share).collect()) == Counter(want)
    assert len(want) > 20 and phrases.collocations(docs.where("false")).count() == 0


def test_collocations_of_four_words(spark):
    """One length more than the query asks for."""
    text = "a b c d. " * 12 + "b c. " * 40
    got = {r["phrase"]: (r["a"], r["l"], r["r"], r["score"]) for r in phrases.collocations(spark.createDataFrame([("en", text)], "lang string, text string"), most=4).collect()}
    assert got == {"a b c d": (12, 12, 12, 1_000_000), "b c": (52, 52, 52, 1_000_000)}


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    a, l, r = 9_999_999_999, 10_000_000_019, 10_000_000_033  # noqa: E741
    every = spark.createDataFrame([("en", "x", 1, l), ("en", "y", 1, r), ("en", "x y", 2, a)], "lang string, phrase string, words int, a long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *_: (every, spark.createDataFrame([("en", 5)], "lang string, n long")))
    assert phrases.collocations(every, "lang", "phrase").first()["score"] == 1_000_000 * a * a // (l * r)
