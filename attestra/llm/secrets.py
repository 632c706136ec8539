"""Secret scans, with DataFrame functions only: fixed patterns, and a randomness test battery for other tokens.

A long token's encoding (hexadecimal, base32, letters and digits, base64 ...) is inferred from its characters. Under the hypothesis
that it was drawn uniformly from that alphabet, three tests give p-values: chi-squared uniformity of the alphabet, runs above
and below its middle, and serial correlation; Fisher's method combines them. Words and paths fail them, random keys do not.

Reported are the tokens for which "this is a word-like token" is rejected. What word-like tokens score is estimated from the corpus:
long tokens without any digit, by bands of length, have a log-normal -ln p, whose lower tail is a token's p-value of not being one. A band's estimate is
shrunk towards the one of all bands together, by how few tokens it has. The
Benjamini-Hochberg rule within each band then bounds the expected share of word-like tokens among those reported by `fdr`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs are maximal either way
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Longest token of each length band but the last.
BANDS = (31, 63, 127)
_UP, _LOW, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings by pattern, first match wins: alphabet in code order.
ENCODINGS = (
    (r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    (r"^[A-Z2-7]+$", _UP + "234567"),
    (r"^[a-z0-9]+$", _LOW + _DIGITS),
    (r"^[A-Z0-9]+$", _DIGITS + _UP),
    (r"^[A-Za-z0-9]+$", _UP + _LOW + _DIGITS),
)
_BASE64 = _UP + _LOW + _DIGITS + "+/"
#: Bins per unit of ln(-ln p).
BINS = 50
#: Mean and deviation of ln(-ln p) of word-like tokens by band, before any is seen (random tokens have -0.7 and 1.4 at any length), and as how many
#: tokens that counts: bands are shrunk towards what all bands together say, and that towards DEFAULT.
PRIOR = 20.0
DEFAULT = ((2.2, 0.6), (2.8, 0.6), (3.4, 0.6), (4.0, 0.6))


def _scan(values: Column, joined, back: bool = False) -> Column:
    """Running results of an associative `joined` over an array, from its first entry on (or from its last), by doubling steps: n log n for n entries."""
    steps = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    away = lambda i, p: i + F.pow(F.lit(2), p).cast("int") * (1 if back else -1)
    return F.aggregate(steps, values, lambda acc, p: F.transform(acc, lambda x, i: F.coalesce(joined(x, F.get(acc, away(i, p))), x)))


def matches(text: Column, pattern: str, value_group: int = 0) -> Column:
    """array<struct<start, end, value>> of leftmost non-overlapping matches, in code points, end exclusive."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else hits
    sizes = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
    ends = _scan(sizes, lambda x, y: x + y)
    found = F.zip_with(F.zip_with(hits, ends, lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("end"))), values, lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), v.alias("value")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _tail(z: Column) -> Column:
    """The normal distribution's upper tail, by its logistic approximation; never 0."""
    z = F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def randomness(token: Column) -> Column:
    """The combined p-value of a token of two characters or more, under uniform draws from its inferred alphabet."""
    bare = F.translate(F.rtrim(token, F.lit("=")), "-_=", "+/+")
    alphabet = F.lit(_BASE64)
    for pattern, chars in reversed(ENCODINGS):
        alphabet = F.when(bare.rlike(pattern), F.lit(chars)).otherwise(alphabet)
    # Named once, so that nothing below works them out again and again.
    first = F.transform(F.array(F.struct(bare.alias("t"), alphabet.alias("a"))), lambda s: F.struct(s["t"].alias("t"), s["a"].alias("a"), F.length(s["t"]).cast("double").alias("n"), F.length(s["a"]).cast("double").alias("k"), F.transform(F.split(s["t"], ""), lambda c: (F.instr(s["a"], c) - 1).cast("double")).alias("x")))

    def summed(s: Column) -> Column:
        counts = F.transform(F.split(s["a"], ""), lambda c: F.length(s["t"]) - F.length(F.replace(s["t"], c, F.lit(""))))
        squares = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double"))
        mean = F.aggregate(s["x"], F.lit(0.0), lambda acc, v: acc + v) / s["n"]
        high = F.aggregate(s["x"], F.lit(0.0), lambda acc, v: acc + F.when(v * 2 >= s["k"], 1.0).otherwise(0.0))
        shifted = F.slice(s["x"], 2, F.size(s["x"]))
        turns = F.aggregate(F.zip_with(F.slice(s["x"], 1, F.size(s["x"]) - 1), shifted, lambda a, b: F.when((a * 2 >= s["k"]) == (b * 2 >= s["k"]), 0.0).otherwise(1.0)), F.lit(0.0), lambda acc, v: acc + v)
        spread = F.aggregate(s["x"], F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean))
        lagged = F.aggregate(F.zip_with(F.slice(s["x"], 1, F.size(s["x"]) - 1), shifted, lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda acc, v: acc + v)
        return F.struct(s["n"].alias("n"), s["k"].alias("k"), squares.alias("sq"), high.alias("hi"), turns.alias("turns"), spread.alias("var"), lagged.alias("lag"))

    def combined(s: Column) -> Column:
        n, df = s["n"], s["k"] - 1
        chi = s["k"] / n * s["sq"] - n
        z1 = (F.cbrt(F.greatest(chi, F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        ab = 2 * s["hi"] * (n - s["hi"])
        deviation = F.sqrt(F.greatest(ab * (ab - n) / (n * n * (n - 1)), F.lit(1e-9)))
        z2 = F.when(ab <= n, F.lit(12.0)).otherwise(F.abs(s["turns"] + 1 - ab / n - 1) / deviation)
        z3 = F.when(s["var"] <= 0, F.lit(12.0)).otherwise(F.abs(s["lag"] / s["var"] + 1 / n) * F.sqrt(n))
        logs = F.log(_tail(z1)) + F.log(F.least(F.lit(1.0), 2 * _tail(z2))) + F.log(F.least(F.lit(1.0), 2 * _tail(z3)))
        return F.exp(logs) * (1 - logs + logs * logs / 2)

    return F.element_at(F.transform(F.transform(first, summed), combined), 1)


def _free_of(base: Column, tokens: Column) -> Column:
    """The tokens (start, end, value; by start, not overlapping) that meet no base span (by start): one sweep over both, sorted together."""
    at = lambda x, kind, value: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), value.alias("value"))
    both = F.array_sort(F.concat(F.transform(base, lambda b: at(b, 0, F.lit(None).cast("string"))), F.transform(tokens, lambda t: at(t, 1, t["value"]))))
    named = F.array(F.struct(both.alias("m")))
    # Ends of the base spans so far, and the start of the next one.
    named = F.transform(named, lambda s: F.struct(s["m"].alias("m"), _scan(F.transform(s["m"], lambda x: F.when(x["kind"] == 0, x["end"]).otherwise(-1)), F.greatest).alias("so_far"), _scan(F.transform(s["m"], lambda x: F.when(x["kind"] == 0, x["start"]).otherwise(1 << 30)), F.least, back=True).alias("next")))
    free = F.transform(named, lambda s: F.filter(s["m"], lambda x, i: (x["kind"] == 1) & (F.get(s["so_far"], i) <= x["start"]) & (F.get(s["next"], i) >= x["end"])))
    return F.element_at(free, 1)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.05, floor: float = 1e-3, letters_only: int = 48) -> DataFrame:
    """Every row's id_col with `spans`: array<struct<start, kind, end>> of code point offsets, end exclusive, by start and then kind.

    Kinds: assign, access and hex by their patterns; random: tokens of 20 characters or more of base64 alphabets, that hold a digit
    and a letter (or have letters_only characters or more), meet no span of the other kinds, are told from word-like tokens of
    their length band at the false-discovery rate `fdr`, and whose randomness is not rejected at `floor`.

    Null and empty texts have no spans. Repeated rows and null ids are rows like others (equal tokens count as often as they
    occur). Very long texts are scanned whole, in time about linear in their length. Empty tables give no rows. Other columns are ignored,
    whatever their names.

    Texts are read once: what is found in them is written, and the cuts meet that. Only the histogram of scores by length band is shuffled, and
    only its cuts (a row a band) are broadcast.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    assign = F.filter(matches(F.col("text"), ASSIGN, 2), lambda m: F.length(m["value"]) >= 6)
    access = F.filter(matches(F.col("text"), ACCESS), lambda m: F.length(m["value"]) >= 20)
    kinds = {"assign": assign, "access": access, "hex": matches(F.col("text"), HEX)}

    def tagged(found: Column, order: int, kind: str) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    base = F.array_sort(F.flatten(F.array(*(tagged(found, i, k) for i, (k, found) in enumerate(kinds.items())))))
    band = lambda m: F.lit(len(BANDS)) - sum((F.length(m["value"]) <= b).cast("int") for b in BANDS)
    digit, letter = (lambda m: m["value"].rlike("[0-9]")), (lambda m: m["value"].rlike("[A-Za-z]"))
    candidate = lambda m: (digit(m) & letter(m)) | (F.length(m["value"]) >= letters_only)
    score = lambda m: F.log(F.greatest(-F.log(F.greatest(randomness(m["value"]), F.lit(1e-300))), F.lit(0.01)))
    scored = lambda found: F.transform(F.filter(found, lambda m: candidate(m) | ~digit(m)), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), band(m).alias("band"), candidate(m).alias("candidate"), score(m).alias("x")))
    # Named once, so that nothing is worked out again for each token.
    found = F.transform(F.array(F.struct(base.alias("base"), matches(F.col("text"), TOKEN).alias("tokens"))), lambda s: F.struct(s["base"].alias("base"), scored(_free_of(s["base"], s["tokens"])).alias("tokens")))
    rows = written(rows.select("doc_id", F.element_at(found, 1).alias("f")).select("doc_id", "f.base", "f.tokens"), "spans")

    tokens = rows.select(F.explode("tokens").alias("t")).select("t.*")
    words = tokens.where("NOT candidate").groupBy("band", "x").agg(F.lit(1)).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("own"), F.var_pop("x").alias("var"))  # copies count once
    bands = F.array(*(F.struct(F.lit(i).alias("band"), F.lit(m).alias("m0"), F.lit(d).alias("d0")) for i, (m, d) in enumerate(DEFAULT)))
    wordlike = rows.sparkSession.range(1).select(F.explode(bands).alias("x")).select("x.*").join(words, "band", "left").fillna(0)
    every = wordlike.agg((F.sum(F.col("n") * (F.col("own") - F.col("m0"))) / (F.sum("n") + PRIOR)).alias("shift"), F.sum("n").alias("all"), F.sum(F.col("n") * F.col("var")).alias("squares"))
    n, prior = F.col("n"), F.col("m0") + F.col("shift")
    spread = (F.col("squares") + PRIOR * F.col("d0") * F.col("d0")) / (F.col("all") + PRIOR)
    mean = (n * F.col("own") + PRIOR * prior) / (n + PRIOR)
    dev = F.sqrt((n * F.col("var") + PRIOR * spread) / (n + PRIOR))
    wordlike = wordlike.crossJoin(F.broadcast(every)).select("band", mean.alias("mean"), dev.alias("dev"))  # one row beside one a band
    counts = tokens.where("candidate").groupBy("band", F.ceil(F.col("x") * BINS).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    ranked = counts.withColumn("rank", F.sum("c").over(Window.partitionBy("band").orderBy("bin"))).withColumn("all", F.sum("c").over(Window.partitionBy("band"))).join(F.broadcast(wordlike), "band")
    p = _tail((F.col("mean") - F.col("bin") / BINS) / F.col("dev"))
    cut = ranked.where(p <= fdr * F.col("rank") / F.col("all")).groupBy("band").agg(F.max("bin").alias("cut"))
    cuts = cut.agg(F.map_from_entries(F.collect_list(F.struct("band", "cut"))).alias("cuts"))  # one row, of a cut a band
    most = math.log(-math.log(floor))
    met = rows.crossJoin(F.broadcast(cuts))  # one row
    random = F.filter("tokens", lambda m: m["candidate"] & (F.ceil(m["x"] * BINS) <= F.coalesce(F.try_element_at(F.col("cuts"), m["band"]), F.lit(-(1 << 30)))) & (m["x"] <= most))
    spans = F.array_sort(F.concat("base", F.transform(random, lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("order"), m["end"].alias("end"), F.lit("random").alias("kind")))))
    return met.select(F.col("doc_id").alias(id_col), F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
