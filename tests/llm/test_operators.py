"""The training-data operators against brute force, on rows with nulls, empty and long texts, repeats and clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from attestra.llm import jaccard, langid, lines, mixing, packing, quality, queries, secrets, shared, substrings, tokens, topk, warc

WS = " \t\n\x0b\x0c\r"


def texts(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    say = lambda n: " ".join(word() for _ in range(n))
    passage, line = say(90), "a license line that many documents share"
    base = [say(rng.choice([3, 40, 120])) for _ in range(14)]
    out = [None, "", " ", "\n\n", "one two", "a b c d e", base[0], base[0], base[1], base[1] + " x", say(60) + " " + passage + " " + say(50), passage + "\n" + line, line.upper() + "  \nother", "\t" + line, line + "\n" + line, "ab" * 4000, "x y z " * 300]
    edited = base[2].split() + base[3].split() + base[4].split()
    for i in range(6):
        copy = list(edited)
        copy[rng.randrange(len(copy))] = f"edit{i}"
        out.append(" ".join(copy))
    return out + base[5:]


@pytest.fixture(scope="module")
def docs(spark):
    body = texts()
    rows = [(i, t, "en", f"s{i % 3}", "k", 1, True) for i, t in enumerate(body)] + [(None, "null id text", None, None, "k", 1, True), (3, body[6], "en", "s0", "k", 1, True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id string, n_words int, kept boolean").repartition(3)


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words(t):
    return [w for w in re.split(f"[{WS}]+", t or "") if w]


def test_quality(docs, plain, empty):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["dup_5gram_chars"]) for r in quality.repetition_quality(docs).collect())

    def repeated(w, n):
        grams = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        return {i + j for i in range(len(w) - n + 1) if grams[tuple(w[i : i + n])] > 1 for j in range(n)}

    want = Counter()
    for i, t in plain:
        w, seen, dup = words(t), set(), 0
        for x in (t or "").split("\n"):
            if x.strip(WS):
                dup += x in seen
                seen.add(x)
        r = len(repeated(w, 3))
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, r, len(w) < 50 or 100 * r > 50 * len(w), sum(len(w[k]) for k in repeated(w, 5)))] += 1
    assert got == want
    assert quality.repetition_quality(empty).count() == 0


def thue_morse(n, a="a", b="b"):
    """A string and its complement, which polynomial hashes modulo 2**64 cannot tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


def test_structured_strings_do_not_meet(spark, monkeypatch):
    """Words of 1,024 letters, texts of 4,096 and sequences of 1,024 words, each beside its complement."""
    x, y = thue_morse(1024)
    rows = spark.createDataFrame([(0, f"{x} p q r s"), (1, f"{y} p q r s"), (2, f"{x} q w {y} q w")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(rows).collect()} == {0: 0, 1: 1, 2: 2}
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality.repetition_quality(rows).collect()} == {0: 0, 1: 0, 2: 0}
    t, plain = tokens.Tokenizer(tokens.vocabulary()), tokenizers.Tokenizer.from_file(tokens.vocabulary())
    own = [x, y, f"{x} {y}"]
    ids, at = t.encode(own)
    assert [ids[a:z].tolist() for a, z in zip(at, at[1:], strict=False)] == [plain.encode(w, add_special_tokens=False).ids for w in own]
    monkeypatch.setattr(tokens.Tokenizer, "hashes", lambda self, chars, start, end: np.full(len(start), 7, np.uint64))  # all pre-tokens meet
    t.clear()
    ids, at = t.encode(["one two", "two one one"])
    assert [ids[a:z].tolist() for a, z in zip(at, at[1:], strict=False)] == [plain.encode(w, add_special_tokens=False).ids for w in ("one two", "two one one")]
    long, other = thue_morse(4096)
    got = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(spark.createDataFrame([(0, long[:1024] + "0" * 60), (1, other[:1024] + "1" * 60)], "doc_id long, text string"), length=900).collect()}
    assert got == {0: 0, 1: 0}


def test_rolling_hashes_are_those_of_the_polynomial():
    p, rng = (1 << 61) - 1, np.random.default_rng(3)
    r = shared.Rolling(5)
    for symbols in (rng.integers(0, 256, 3000).astype(np.uint8), rng.integers(0, 1 << 64, 3000, dtype=np.uint64)):
        prefix = r.prefix(symbols)
        values = [int(v) + 1 if symbols.dtype == np.uint8 else int(v) % p for v in symbols]
        start, end = rng.integers(0, 1500, 50), rng.integers(1500, 3001, 50)
        assert r.between(prefix, start, end).tolist() == [sum(values[i] * pow(r.base, i - a, p) for i in range(a, z)) % p for a, z in zip(start.tolist(), end.tolist(), strict=True)]


def test_windows_before_an_anchor_are_compared_on_their_bytes(monkeypatch):
    monkeypatch.setattr(substrings._one, "between", lambda prefix, start, end: np.zeros(len(start), np.uint64))  # all hashes meet
    data = np.frombuffer(b"abXXcdXXabXX", np.uint8)
    flags = substrings.repeats(np.zeros(3, np.int64), np.full(3, 2), np.ones(3, np.int64), data, np.array([0, 4, 8, 12]), 4)
    assert flags.tolist() == [True, False, True]


def _tail(z):
    z = max(-12.0, min(12.0, z))
    return 1 / (1 + math.exp(1.5976 * z + 0.07056 * z**3))


def _randomness(token):
    bare = token.rstrip("=").translate(str.maketrans("-_=", "+/+"))
    alphabet = next((chars for pattern, chars in secrets.ENCODINGS if re.match(pattern, bare)), secrets._BASE64)
    x = np.array([alphabet.index(c) for c in bare], float)
    n, k = len(x), len(alphabet)
    chi = k / n * sum(c * c for c in Counter(bare).values()) - n
    z1 = (np.cbrt(max(chi, 0.0) / (k - 1)) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    high = x * 2 >= k
    ab, runs = 2 * high.sum() * (n - high.sum()), 1 + (high[1:] != high[:-1]).sum()
    z2 = 12.0 if ab <= n else abs(runs - ab / n - 1) / math.sqrt(max(ab * (ab - n) / (n * n * (n - 1)), 1e-9))
    d = x - x.mean()
    z3 = 12.0 if (d * d).sum() <= 0 else abs((d[1:] * d[:-1]).sum() / (d * d).sum() + 1 / n) * math.sqrt(n)
    logs = math.log(_tail(z1)) + math.log(min(1.0, 2 * _tail(z2))) + math.log(min(1.0, 2 * _tail(z3)))
    return math.exp(logs) * (1 - logs + logs * logs / 2)


def _secret_spans(bodies, fdr=0.05, floor=1e-3):
    """Every text's (start, kind, end), worked out plainly."""
    assign = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    base, tokens = [], []
    for i, t in enumerate(bodies):
        t = t or ""
        own = [(m.start(), "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base.append(own)
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t):
            if not any(a < m.end() and z > m.start() for a, _, z in own):
                digit, letter = re.search("[0-9]", m[0]), re.search("[A-Za-z]", m[0])
                candidate = bool((digit and letter) or len(m[0]) >= 48)
                if candidate or not digit:
                    x = math.log(max(-math.log(max(_randomness(m[0]), 1e-300)), 0.01))
                    tokens.append((i, m.start(), m.end(), sum(len(m[0]) > b for b in secrets.BANDS), candidate, x))
    out = [list(own) for own in base]
    words_of_ = [sorted({x for *_, b, c, x in tokens if b == band and not c}) for band in range(4)]
    prior, all_ = secrets.PRIOR, sum(map(len, words_of_))
    shift = sum(len(w) * (np.mean(w) - secrets.DEFAULT[b][0]) for b, w in enumerate(words_of_) if w) / (all_ + prior)
    squares = sum(len(w) * np.var(w) for w in words_of_ if w)
    for band in range(4):
        words, (m0, d0) = words_of_[band], secrets.DEFAULT[band]
        n = len(words)
        mean = ((np.sum(words) if n else 0) + prior * (m0 + shift)) / (n + prior)
        spread = (squares + prior * d0 * d0) / (all_ + prior)
        dev = math.sqrt(((n * np.var(words) if n else 0) + prior * spread) / (n + prior))
        bins = [math.ceil(x * secrets.BINS) for *_, b, c, x in tokens if b == band and c]
        cut = max((k for k in bins if _tail((mean - k / secrets.BINS) / dev) <= fdr * sum(o <= k for o in bins) / len(bins)), default=-(10**9))
        for i, start, end, b, c, x in tokens:
            if b == band and c and math.ceil(x * secrets.BINS) <= cut and x <= math.log(-math.log(floor)):
                out[i].append((start, "random", end))
    return [sorted(own, key=lambda m: (m[0], secrets.KINDS.index(m[1]))) for own in out]


def _secret_texts():
    rng = random.Random(5)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    key = draw(secrets._BASE64[:62], 40)
    body = [None, "", "é password = 'abcDEF12' and secret=token:abcdefgh", "AKIA" + "A" * 10 + " AKIA" + "B2" * 9, "x" + "0a" * 14 + "g", f"the value {key} is there", "the-quick-brown-fox-jumps-over-lazy-dogs-1", "thntionblethorreoundernttheandofthe", "pw token:" + "a" * 9 + "\n" + "0123456789abcdef" * 2, "secret=" + "ab/" * 3000]
    for _ in range(60):
        body.append(" ".join([draw("etaoinshrdlu", rng.randint(20, 60)), draw("etaoinshrdlu-", rng.randint(20, 30)) + "7", draw(secrets._BASE64, rng.randint(20, 150)), "x" * rng.randint(0, 30), "token=" + draw(secrets._UP, 12) + draw("etao/", 25) + "9"]))
        body.append(" ".join(draw("etaoinshrdlu", rng.randint(20, 31)) for _ in range(3)) + " AKIA" + draw(secrets._UP, 16) + draw("0123456789abcdef", 30) + draw(secrets._BASE64, 9))
    return body


def test_secrets(spark, empty):
    body = _secret_texts()
    df = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in enumerate(body)], "doc_id long, text string, spans int, base int, f int")
    got = secrets.scan_secrets(df).collect()
    by = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in got}
    want = _secret_spans(body)
    assert len(got) == len(body) and all(by[i] == w for i, w in enumerate(want))
    assert [s[1] for s in by[5]] == ["random"] and not by[6] and not by[7]
    random_ = sum(s[1] == "random" for own in want for s in own)
    assert random_ >= 50
    again = secrets.scan_secrets(df.unionByName(df).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))).collect()
    assert Counter(tuple(map(tuple, r["spans"])) for r in again) == Counter({k: 2 * n for k, n in Counter(tuple(map(tuple, r["spans"])) for r in got).items()})
    assert secrets.scan_secrets(empty).count() == 0


def test_secret_query_on_whole_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    want = dict(zip([r["doc_id"] for r in docs], _secret_spans([r["text"] for r in docs]), strict=True))
    say = lambda spans: ",".join(f"{k}:{a}:{z}" for a, k, z in spans)
    for r in queries.op2_secret_scans(spark, "/root/testdata/sf0.001").collect():
        base = [s for s in want[r["doc_id"]] if s[1] != "random"]
        assert (r["spans"], r["base_sha256"]) == (say(want[r["doc_id"]]), hashlib.sha256(say(base).encode()).hexdigest())
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in base) for k in ("assign", "access", "hex")]


def test_secret_query_where_every_band_has_word_like_tokens(spark, tmp_path):
    """Over 100 different ones a band: the estimate from the table decides, not what was assumed before."""
    rng = random.Random(12)
    body = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(*sizes))) for sizes in ((20, 31), (32, 47), (40, 63), (64, 127), (128, 300)) for _ in range(130)]
    body += ["".join(rng.choice(secrets._BASE64[:62]) for _ in range(rng.randint(20, 160))) for _ in range(150)]
    rows = [(i, f"so {t} it is") for i, t in enumerate(body)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = _secret_spans([t for _, t in rows])
    say = lambda spans: ",".join(f"{k}:{a}:{z}" for a, k, z in spans)
    assert {r["doc_id"]: r["spans"] for r in queries.op2_secret_scans(spark, str(tmp_path)).collect()} == {i: say(w) for i, w in enumerate(want)}
    assert 100 < sum(bool(w) for w in want[650:]) and not any(w for w in want[:650] if w and w[0][1] != "random")


def test_secrets_in_very_long_texts(spark):
    """Over 1 and 4 MiB, with thousands of spans and tokens, in time that grows with the text."""
    rng = random.Random(2)
    keys = ["".join(rng.choice(secrets._BASE64[:62]) for _ in range(32)) for _ in range(400)]
    texts_ = [" ".join(f"secret={k[:12]} {k}" for k in keys) * 60, "plain words and more " * 210_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts_)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(df).collect()}
    kinds = Counter(s["kind"] for s in got[0])
    assert kinds["assign"] == 24_000 and kinds["random"] > 20_000 and not got[1] and len(texts_[0]) > 1 << 20


def _raked(cells, powers, rounds=400):
    """Factors of {(category, ...): tokens}, by plain iterative proportional fitting."""
    factor, all_ = dict.fromkeys(cells, 1.0), sum(cells.values())
    targets = []
    for k, power in enumerate(powers):
        own = Counter()
        for c, n in cells.items():
            own[c[k]] += n
        norm = sum(n**power for n in own.values() if n)
        targets.append({x: n**power / norm * all_ for x, n in own.items() if n})
    for _ in range(rounds):
        for k, target in enumerate(targets):
            now = Counter()
            for c, n in cells.items():
                now[c[k]] += n * factor[c]
            for c in cells:
                if now[c[k]] > 0:
                    factor[c] *= target[c[k]] / now[c[k]]
    return factor


@pytest.mark.parametrize("few", [50_000, 0])
def test_mixing(docs, empty, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_CELLS", few)  # 0: the salted way
    docs = docs.withColumn("_salt", F.lit("mine")).withColumn("tokens", F.lit("old"))
    margins = {"source": (F.col("source"), 0.5), "lang": (F.col("lang"), 1.0)}
    out = mixing.mix_to_targets(docs, margins, seed=23)
    assert out.count() == docs.count() and set(docs.columns) - {"kept", "tokens"} <= set(out.columns) and out.where("_salt = 'mine'").count() == docs.count()
    rows = out.collect()
    cells = Counter()
    for r in rows:
        assert r["tokens"] == len(words(r["text"])) and r["mix_source"] == (r["source"] or "\0null")
        cells[r["mix_source"], r["mix_lang"]] += r["tokens"]
    factor = _raked(cells, (0.5, 1.0))
    most = max(f for c, f in factor.items() if cells[c])
    scale = min(1 / most, sum(cells.values()) / sum(n * factor[c] for c, n in cells.items()))
    for r in rows:
        p = min(1.0, factor[r["mix_source"], r["mix_lang"]] * scale)
        assert r["probability"] == pytest.approx(p, abs=1e-5)
        drawn = int(hashlib.md5(f"23:{r['doc_id'] if r['doc_id'] is not None else r['text'] or ''}".encode()).hexdigest()[:13], 16) / (1 << 52)
        assert r["kept"] == (drawn < r["probability"])
    after, own = Counter(), Counter()  # of the last margin, which holds even where one source and language meet no other
    for c, n in cells.items():
        after[c[1]] += n * factor[c]
        own[c[1]] += n
    assert all(after[k] / sum(after.values()) == pytest.approx(own[k] / sum(own.values()), abs=1e-6) for k in own)
    assert mixing.mix_to_targets(empty, margins).count() == 0


def test_mixing_says_when_targets_cannot_all_hold(spark):
    cells = spark.createDataFrame([("a", "x", 10), ("b", "y", 1000)], "s string, t string, tokens long")
    with pytest.warns(UserWarning, match="cannot all hold.*off by"):
        factors, stand, off = mixing.rake(cells, {"s": 0.0, "t": 1.0})
    assert factors.count() == 2 and stand == "cannot_hold" and off > 0.4
    slow = spark.createDataFrame([("a", "x", 1), ("a", "y", 100_000), ("b", "x", 100_000)], "s string, t string, tokens long")
    with pytest.warns(UserWarning, match="do not hold yet"):
        assert mixing.rake(slow, {"s": 0.5, "t": 0.0}, rounds=3)[1] == "not_yet"
    easy = spark.createDataFrame([(a, b, 10 * i + j + 1) for i, a in enumerate("pqr") for j, b in enumerate("xyz")], "s string, t string, tokens long")
    factors, stand, off = mixing.rake(easy, {"s": 0.5, "t": 0.0})
    assert stand == "hold" and off < 1e-6
    for name in "st":
        shares = [r["w"] for r in factors.groupBy(name).agg(F.sum(F.col("tokens") * F.col("factor")).alias("w")).orderBy(name).collect()]
        own = [r["w"] for r in factors.groupBy(name).agg(F.sum("tokens").alias("w")).orderBy(name).collect()]
        power = {"s": 0.5, "t": 0.0}[name]
        assert shares == pytest.approx([w**power / sum(v**power for v in own) * sum(own) for w in own], rel=1e-5)


def test_registered_mixing_query_has_its_targets(spark):
    rows = queries.op3_mixing(spark, "/root/testdata/sf0.01").collect()
    tokens, factor = Counter(), {}
    for r in rows:
        tokens[r["source"], r["lang"], r["topic"]] += r["tokens"]
    factor = _raked(tokens, (0.7, 0.9, 1.0), 300)
    most = max(f for c, f in factor.items() if tokens[c])
    scale = min(1 / most, sum(tokens.values()) / sum(n * factor[c] for c, n in tokens.items()))
    assert {r["targets"] for r in rows} == {"hold"} and max(r["targets_off"] for r in rows) < 1e-5
    assert all(r["probability"] == pytest.approx(min(1.0, factor[r["source"], r["lang"], r["topic"]] * scale), abs=1e-4) for r in rows)


def test_language_id(spark):
    rng = random.Random(3)
    vocab = {"aa": "the and of to in is".split(), "bb": "der die und das ist nicht".split()}
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(rng.randint(5, 60))), k, 1.0) for i, k in enumerate(["aa", "bb"] * 150)]
    df = spark.createDataFrame(rows + [(900, None, "aa", 1.0), (901, "123 !!", "aa", 1.0), (902, "the of", None, 1.0), (None, "die und", "bb", 1.0), (903, "", "aa", 1.0), (904, "the and of " * 150_000, None, 1.0), (905, "die und das " * 450_000, None, 1.0)], "doc_id long, text string, lang string, lang_score double")
    df = df.withColumn("_letter", F.lit("mine")).withColumn("letter", F.lit("mine"))
    model = langid.fit(df)
    out = langid.identify(df.drop("lang"), model)
    assert {"_letter", "letter"} <= set(out.columns)
    got = out.collect()
    assert len(got) == len(rows) + 7
    by = {r["doc_id"]: r for r in got}
    assert np.mean([by[i]["lang_pred"] == k for i, _, k, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]) > 0.97
    assert [(by[i]["lang_pred"], by[i]["lang_score"], by[i]["lang_rejected"]) for i in (900, 901, 903)] == [("und", 0.0, True)] * 3
    assert by[902]["lang_pred"] == by[904]["lang_pred"] == "aa" and by[None]["lang_pred"] == by[905]["lang_pred"] == "bb" and all(0 <= r["lang_score"] <= 1 for r in got)
    assert langid.fit(df.where("lang IS NULL")) is None
    assert {r["lang_pred"] for r in langid.identify(df, None).collect()} == {"und"}
    assert langid.identify(df.where("false"), model).count() == 0
    # The logits are means of rows over all n-grams, the score a softmax of them, and a rejection as the limits say.
    for i, text, *_ in rows[:20]:
        b = bytes(langid._FOLD[np.frombuffer(text.encode(), np.uint8)])
        mean = np.mean([model.rows[(int.from_bytes(b[a : a + n], "little") ^ n * 0x9E3779B1 & 0xFFFFFFFF) * 2654435761 % (1 << 32) >> 32 - langid.BITS] for n in langid.GRAMS for a in range(len(b) - n + 1)], axis=0, dtype=np.float64)
        p = np.exp((mean[:-1] + model.bias) / model.temperature)
        assert by[i]["lang_score"] == pytest.approx(p.max() / p.sum(), abs=1e-6) and by[i]["lang_pred"] == model.langs[p.argmax()]
        assert by[i]["lang_rejected"] == (p.max() / p.sum() < model.threshold or mean[-1] < model.least)


def test_language_rejection(spark):
    """On the tables' held-out documents: hardly any is rejected; texts of no language learned are."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    assert model.false_rejections <= 0.005
    held = langid.identify(docs.where("lang IS NOT NULL AND pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 3) = 1 AND length(text) > 20"), model)
    told = held.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.avg(F.col("lang_rejected").cast("int"))).first()
    assert told[0] > 0.95 and told[1] < 0.01
    rng = random.Random(1)
    noise = ["".join(rng.choice(chars) for _ in range(rng.randint(60, 400))) for chars in ("абвгдежзиклмнопрст ", "漢字仮名交文書", "qxzjkvwq  ", "ΑΒΓΔΕΖαβγδεζ ") for _ in range(25)]
    assert np.mean([r["lang_rejected"] for r in langid.identify(spark.createDataFrame([(i, t) for i, t in enumerate(noise)], "doc_id long, text string"), model).collect()]) > 0.95


def test_language_model_learns_from_long_texts_and_few_ones(spark):
    english, german = "the and of to in is was he for it with as his on be at by ", "der die und das ist nicht ein zu mit sich auf den "
    rows = [(i, english * 430, "en") for i in range(60)] + [(100 + i, german * (1 + i % 3), "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.langs == ["de", "en"] and all(len(t) > langid.SAMPLE_CHARS for _, t, k in rows if k == "en")
    assert all(r["lang_pred"] == r["lang"] and not r["lang_rejected"] for r in langid.identify(docs, model).collect())
    assert langid.fit(docs.where("lang = 'en'")).langs == ["en"]
    few = langid.train([english, german, english * 2], ["en", "de", "en"])
    assert few.temperature != 1.0 or few.threshold == 0.0
    alone = langid.train([english, german], ["en", "de"])  # none can be kept apart
    assert (alone.temperature, alone.threshold, alone.least) == (1.0, 0.0, -np.inf)


def test_limits_weigh_wrong_answers_against_right_ones():
    right = np.array([True] * 20 + [False] * 12)
    x = np.concatenate([np.linspace(0.6, 1.0, 20), np.full(12, 0.62)])
    at = langid.limit(x, right)
    assert 0.62 < at < 0.621 and (x[right] < at).sum() == 1  # twelve wrong ones outweigh a right one
    assert langid.limit(x[:25], right[:25]) < 0.6  # five do not
    assert langid.limit(x[:20], right[:20]) == pytest.approx(0.6 - langid.BELOW * 0.2)


def test_language_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries.op4_language_id(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in docs[r["doc_id"]]["text"] or ""))
    told = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in got if r["held_out"] and docs[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert np.mean(told) > 0.9


def test_language_sample_keeps_rare_languages(spark, monkeypatch):
    rows = [(i, f"text {i}", f"l{i % 14:02}") for i in range(28_000)] + [(100_000 + i, f"rare {i}", "rare") for i in range(30)]
    got = {}
    monkeypatch.setattr(langid, "train", lambda texts, langs: got.update(Counter(langs)))
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=1500)
    held = sum(zlib.crc32(str(100_000 + i).encode()) % 3 != 1 for i in range(30))
    assert got["rare"] == held and len(got) == 15 and sum(got.values()) == 1500
    assert max(got.values()) - min(n for k, n in got.items() if k != "rare") <= 1
    assert langid.shares({"a": 1000, "b": 3, "c": 1000}, 101) == {"b": 3, "a": 49, "c": 49}


def test_warc_round_trip(spark):
    body = ["<p>é</p>", None, "", "<p>é</p>", "long " * 50_000, "x\r\n\r\ny", "<p>é</p>"]
    df = spark.createDataFrame([(i, f"http://h/{i}" if i else None, b, 7) for i, b in enumerate(body)], "page_id long, url string, html string, body int").repartition(2)
    by = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    first = {}
    for i, b in enumerate(body):
        raw = (b or "").encode()
        ref = first.setdefault(raw, i)
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if ref == i else "revisit", None if ref == i else ref)
        assert (by[i]["payload_bytes"], by[i]["payload_digest"], by[i]["record_type"], by[i]["refers_to"]) == want
    assert warc.round_trip(df.where("false")).count() == 0
    files = warc.write_archives(df, warc.fresh_path(spark, "t"), min_bytes=100, gzip=False)
    read = warc.read_archives(spark, files)
    assert read.where("record_type = 'revisit'").count() == 0 and read.where("record_type = 'response'").count() == len(body)
    one = warc.read_archives(spark, files).where("target_uri = 'http://h/5'").collect()
    assert [bytes(r["payload"]) for r in one] == [body[5].encode()]
    plan = warc.read_archives(spark, files, "record_type string, target_uri string").where("record_type = 'response'")
    assert " Filter " not in plan._jdf.queryExecution().executedPlan().toString()


def test_warc_members_without_skip_lengths(tmp_path):
    import gzip

    rec = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:a>"), ("WARC-Target-URI", "u"), ("Content-Type", "application/http;msgtype=response")], b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody")
    info = warc.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:i>")], b"z" * 100_000)
    for name, data in {"members": gzip.compress(info) + gzip.compress(rec) * 2, "one": gzip.compress(info + rec + rec), "plain": info + rec + rec}.items():
        (tmp_path / name).write_bytes(data)
        with open(tmp_path / name, "rb") as f:
            assert [r["payload"] for r in warc.records(f, lambda r: r["record_type"] == "response", True, False)] == [b"body", b"body"], name


@pytest.mark.parametrize("frequent", [8192, 2])
def test_substrings(spark, docs, plain, empty, monkeypatch, frequent):
    """2: all frequent anchors are cut into parts, down to single windows."""
    monkeypatch.setattr(substrings, "SORTED", frequent)
    n = 60
    rng = random.Random(4)
    say = lambda k: "".join(rng.choice("abc é") for _ in range(k))
    shared = [say(k) for k in (25, 45, 61, 75, 200)]
    plain = plain + [(100 + i, say(rng.randint(0, 90)) + rng.choice(shared) + say(rng.randint(0, 90)) + rng.choice(shared)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in plain], "doc_id long, text string, k int, anchor int").repartition(3)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substrings.remove_repeats(docs, length=n, gram=20).collect())
    every = Counter(b[a : a + n] for _, t in plain for b in [(t or "").encode()] for a in range(len(b) - n + 1))
    want = Counter()
    for i, t in plain:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for a in range(len(b) - n + 1):
            if every[b[a : a + n]] > 1:
                gone[a + 1 : a + n + 1] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        want[(i, len(b), int(gone.sum()), spans, bytes(c for c, g in zip(b, gone[1:], strict=False) if not g))] += 1
    assert got == want
    assert substrings.remove_repeats(empty).count() == 0


def test_substrings_of_very_long_texts(spark):
    """Over 4 MiB: repeats across the places where a text is cut into segments, and with another text."""
    rng = random.Random(6)
    long = bytes(rng.choices(b"abcdefgh", k=9_500_000)).decode()
    at = substrings.SEGMENT
    body = [long[: at - 300] + long[1000:1500] + long[at - 300 :], long[2_000_000:2_000_400] + "x", "y" + long[at + 5_000 : at + 5_210]]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in substrings.remove_repeats(spark.createDataFrame([(i, t) for i, t in enumerate(body)], "doc_id long, text string")).collect()}
    assert got == {0: (2 * 500 + 400 + 210, 4), 1: (400, 1), 2: (210, 1)}


def test_suffix_order_and_extensions():
    rng = np.random.default_rng(4)
    parts = [rng.integers(97, 99, rng.integers(1, 12)).astype(np.uint8) for _ in range(60)]
    ends = np.cumsum([len(p) for p in parts])
    s = substrings._Suffixes(np.concatenate(parts), ends - [len(p) for p in parts], ends, ends - [len(p) for p in parts])
    order = s.sort(np.array([0, 25]), np.array([25, 35]))
    said = [bytes(parts[i]) for i in order]
    assert said == sorted(said[:25]) + sorted(said[25:])


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=4)], "z") for i in range(300)]
    rows += [(400 + i, [0.5, 0.5, 0.5, 0.5], "z") for i in range(20)] + [(900, None, "z"), (901, [1.0, None, 0.0, 0.0], "z"), (902, [float("nan"), 0.0, 0.0, 0.0], "z"), (903, [float("inf"), 0.0, 0.0, 0.0], "z"), (1000, [1.0, 2.0], "z"), (1001, [3.0, 2.0], "z"), (None, [0.0] * 4, "z"), (200, [0.5, 0.5, 0.5, 0.5], "z"), (17, [0.1, 0.1, 0.1, 0.1], "z")]
    rows += [(2000, [1e300, 1.0, -1e300], "z"), (2001, [1.0, 2.0, 3.0], "z"), (2002, [-1e300, 0.0, 0.0], "z"), (2100, [4e12, 4e12, 0.0], "z"), (2003, [1e300, 1.0, 0.0], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").withColumn("shard", F.lit("mine")).withColumn("v", F.lit(1))
    got = Counter()
    for r in topk.exact_topk(df, df.where("vec_id % 100 = 0"), k=10, shard_rows=64, query_rows=2).collect():
        got[r["query_id"], r["rank"], r["vec_id"], r["score"]] += 1
    most = (1 << 63) - 1
    clip = lambda x: max(-most, min(most, x))
    ok = [(i, [max(-most - 1, min(most, math.floor(1024 * x))) if abs(x) < 1e290 else (most if x > 0 else -most - 1) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for q in {i for i, _ in ok if i % 100 == 0}:
        mine = [v for i, v in ok if i == q]
        best = sorted((-clip(sum(a * b for a, b in zip(own, v, strict=True))), i) for own in mine for i, v in ok if i != q and len(v) == len(own))
        want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best[:10]))
    assert got == want
    assert topk.exact_topk(df.where("false"), df.where("false")).count() == 0 and topk.exact_topk(df, df.where("false")).count() == 0


def test_topk_prunes_blocks():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8)) * 1000
    x = (centres[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 8)) * 20).astype(np.int64)
    _, _, seen = topk.search(topk.Shard(np.arange(4000), x, block=100), np.arange(10), x[:10], 10)
    assert seen["visited"] < 0.5 * seen["blocks"]


def _lines(plain):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(WS).translate(low)
    held = {}
    for i, t in plain:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20 and i is not None:
                held.setdefault(key(x), set()).add(i)
    want = Counter()
    for i, t in plain:
        own = (t or "").split("\n")
        kept = [x for x in own if i is None or len(held.get(key(x), ())) < 3 or i == max(held[key(x)])]
        want[(i, len(own), len(own) - len(kept), "\n".join(kept))] += 1
    return want


def test_lines(docs, plain, empty):
    odd = docs.withColumns({c: F.lit("mine") for c in ("_doc", "_lost", "doc", "th", "lost", "_k", "pos", "a")})
    out = lines.dedup_lines(odd)
    assert set(odd.columns) <= set(out.columns) and out.where("_lost = 'mine' AND doc = 'mine'").count() == docs.count()
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect()) == _lines(plain)
    assert lines.dedup_lines(empty).count() == 0


def test_lines_of_very_long_texts(spark):
    """Tens of thousands of lines that are lost, some twice, over 1 and 4 MiB; rows that repeat an id with other texts."""
    shared = [f"line number {i} that several documents hold" for i in range(40_000)]
    body = [(1, "\n".join(shared)), (2, "\n".join(shared[::-1] + ["mine alone, and of some length"] + shared[:50])), (2, "\n".join(["own", *shared[:9]])), (3, "\n".join(shared + shared + shared)), (4, "x" * 5_000_000), (None, shared[0])]
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in lines.dedup_lines(spark.createDataFrame(body, "doc_id long, text string")).collect())
    assert got == _lines(body)


def _check_packing(got, rows, capacity):
    """Pieces of every (id, text) are right by the tokenizer alone, and sequences are gapless and within capacity."""
    bpe = tokenizers.Tokenizer.from_file(tokens.vocabulary())
    want = Counter()
    for i, t in rows:
        ids = [*bpe.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want.update((i, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    placed = {}
    for r in got:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in placed.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    return len(placed), sum(r["length"] for r in got)


def test_packing(spark, docs, plain, empty):
    """Repeated and null ids row by row, added tokens, texts of over 1 and 4 MiB."""
    more = [(50, "before <|endoftext|> after"), (51, "<|endoftext|>"), (52, "word " * 250_000), (53, "éx y" * 1_100_000), (None, "null again")]
    odd = spark.createDataFrame([(i, t, 7, 7) for i, t in plain + more], "doc_id long, text string, length int, k int")
    _check_packing(packing.pack_documents(odd, tokens.vocabulary(), capacity=64).collect(), plain + more, 64)
    assert packing.pack_documents(empty, tokens.vocabulary()).count() == 0


def test_packing_query_on_whole_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    n, total = _check_packing(queries.op9_packing(spark, "/root/testdata/sf0.001").collect(), [(r["doc_id"], r["text"]) for r in docs], 1024)
    assert n <= -(-total // 1024) + max(5, total // 1024 // 100)  # near what no packing can be below


def test_packing_plan_is_near_the_bound():
    rng = np.random.default_rng(3)
    size = np.clip(rng.lognormal(5.9, 0.8, 300_000).astype(int), 1, 1023)
    _, n = packing.plan(Counter(size.tolist()), 1024)
    assert n <= 1.003 * size.sum() / 1024


@pytest.mark.parametrize("n", [1_000, 10_000])
def test_packing_plan_uses_the_program_at_small_sizes(n, monkeypatch):
    size = np.clip(np.random.default_rng(3).lognormal(5.9, 0.8, n).astype(int), 1, 1023)
    solved = []
    monkeypatch.setattr(packing, "fractional", lambda *a, f=packing.fractional: solved.extend(f(*a)) or solved)
    slots, total = packing.plan(Counter(size.tolist()), 1024)
    lengths, counts = np.unique(size, return_counts=True)
    assert sum(t * (c @ lengths) for c, t in solved) >= (1 - packing.GAP) * size.sum() - 1e-6
    used = packing.configurations(lengths, counts, 1024)
    assert sum(t for _, t in used) >= 0.25 * total and (sum(c * t for c, t in used) <= counts).all()
    assert (slots[:, 2] - slots[:, 1]).sum() == n and total <= -(-size.sum() // 1024) + 5


def test_configurations_that_are_not_full_are_used():
    """No multiset of these lengths is full, so every sequence of the program has room left, which shorter pieces fill."""
    counts = {600: 500, 400: 500, 10: 700}
    used = packing.configurations(np.array([10, 400, 600]), np.array([700, 500, 500]), 1024)
    assert sum(t for _, t in used) >= 400 and all(c @ np.array([10, 400, 600]) < 1024 for c, _ in used)
    slots, total = packing.plan(counts, 1024)
    assert total <= 505 and (slots[:, 2] - slots[:, 1]).sum() == 1700


def test_tokens_equal_the_vocabulary():
    rng = random.Random(2)
    t = tokens.Tokenizer(tokens.vocabulary())
    chars = "''' ab stmdrevl \n\t 1²é́　.,-中𝔘١"
    plain = tokenizers.Tokenizer.from_file(tokens.vocabulary())
    for _ in range(300):
        own = ["".join(rng.choice([*chars, "<|endoftext|>"]) for _ in range(rng.randint(0, 14))) for _ in range(4)]
        ids, at = t.encode(own)
        assert [ids[a:z].tolist() for a, z in zip(at, at[1:], strict=False)] == [plain.encode(x, add_special_tokens=False).ids for x in own]


def _components(plain, n=5, percent=80):
    sets = {}
    for k, (_, t) in enumerate(plain):
        w = [x for x in re.split(f"[{WS}]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    label = {k: k for k in sets}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                label[root(a)] = root(b)
    groups = {}
    for k in sets:
        groups.setdefault(root(k), []).append(k)
    out = Counter()
    for own in groups.values():
        ids = [plain[k][0] for k in own if plain[k][0] is not None]
        for k in own:
            out[(plain[k][0], len(sets[k]), min(ids) if ids else None)] += 1
    return out


@pytest.mark.parametrize("ref", [(1 << 40) - 1, 15])
def test_jaccard(spark, docs, plain, empty, monkeypatch, ref):
    monkeypatch.setattr(jaccard, "REF", ref)  # 15: most digests meet in the index
    assert Counter(tuple(r) for r in jaccard.jaccard_components(docs).collect()) == _components(plain)
    assert jaccard.jaccard_components(empty).count() == 0
    more = [(None, plain[20][1] + " x"), (None, None), (None, "alone and null"), (7, plain[20][1] + " y"), (7, "other text of one id"), (8, " ".join(f"w{i % 977}" for i in range(300_000)))]
    odd = spark.createDataFrame([(i, t, 0, 0) for i, t in plain + more + more[-2:]], "doc_id long, text string, label int, th int")
    assert Counter(tuple(r) for r in jaccard.jaccard_components(odd).collect()) == _components(plain + more + more[-2:])


def test_jaccard_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(8)
    for _ in range(300):
        s = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 700)), dtype=np.uint64))
        r = np.unique(np.append(s[rng.random(len(s)) > rng.choice([0, 0.05, 0.2])], rng.integers(0, 1 << 63, int(rng.integers(0, 60)), dtype=np.uint64)))
        x, y = (np.frombuffer(jaccard.sketch(t), np.uint64) for t in (s, r))
        n, both = min(len(x), len(y)), len(np.intersect1d(s, r))
        differ = np.bitwise_count(jaccard.folded(x, n) ^ jaccard.folded(y, n)).sum()
        assert differ <= len(s) + len(r) - 2 * both
        if 100 * both >= 80 * (len(s) + len(r) - both):
            assert jaccard.may_link(differ, len(s), len(r), 80)


def test_jaccard_large_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 3)
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(70)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            own[rng.randrange(70)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    for i in range(60, 90):
        rows.append((i, " ".join(base[:40] + [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([2, 5, 60]))])))
    rng.shuffle(rows)
    got = Counter(tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == _components(rows)
