"""Text as Column expressions: normal forms, n-grams, similarity, anchors, answer forms and equivalence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_space(text: Column) -> Column:
    """Without any white space, no-break spaces included."""
    return F.regexp_replace(text, "(?U)[\\s ]+", "")


def plain(text: Column) -> Column:
    """Lower case; letters and digits of any script stay, each run of others is one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


#: Words of a file name that tell copies, not contents.
NOISE = ("copy", "draft", "final", "revised", "revision", "version")


def file_base(name: Column) -> Column:
    """A file name's telling words: no extension, no copy words, no version numbers."""
    words = F.split(plain(F.regexp_replace(name, r"\.[^.]*$", "")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*NOISE) & ~w.rlike(r"^(v|ver|rev|r)\d+$")), " ")


def char_ngrams(text: Column, n: int) -> Column:
    """Distinct n-grams in order; a shorter text is one gram, an empty one none."""
    size = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(size == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def fingerprint(text: Column, n: int = 3) -> Column:
    return F.sha1(F.array_join(F.array_sort(char_ngrams(F.replace(text, F.lit(" "), F.lit("")), n)), "|"))


def keyword_grams(text: Column, lengths: tuple[int, ...] = (4, 3, 2), alphabet: str = "一-鿿") -> Column:
    """Distinct n-grams of the text without all characters of other alphabets, longer first."""
    named = F.array(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{alphabet}]", ""))

    def of(r: Column, n: int) -> Column:
        return F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - n + 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(named, lambda r: F.concat(*(of(r, n) for n in lengths)))))


def keyword_f1(stem: Column, name: Column, stem_grams: Column, name_grams: Column) -> Column:
    """The share of the stem's keywords found in the name and of the name's in the stem, as one score; a name of two characters or more that
    the stem holds, white space aside, scores 1."""
    p = F.size(F.filter(stem_grams, lambda g: F.contains(name, g))) / F.size(stem_grams)
    r = F.size(F.filter(name_grams, lambda g: F.contains(stem, g))) / F.size(name_grams)
    f1 = F.element_at(F.transform(F.array(F.struct(p.alias("p"), r.alias("r"))), lambda s: F.when(s["p"] + s["r"] > 0, 2 * s["p"] * s["r"] / (s["p"] + s["r"])).otherwise(0.0)), 1)
    whole = (F.length(strip_space(name)) >= 2) & F.contains(strip_space(stem), strip_space(name))
    return F.when(whole, F.lit(1.0)).when((F.size(stem_grams) == 0) | (F.size(name_grams) == 0), F.lit(0.0)).otherwise(f1)


def signal_groups(text: Column, groups: list[list[str]]) -> Column:
    """Whether the text holds a keyword of every group."""
    out = F.lit(bool(groups))
    for g in groups:
        some = F.lit(False)
        for word in g:
            some = some | F.contains(text, F.lit(word))
        out = out & some
    return F.coalesce(out, F.lit(False))


def in_scope(point: Column, scope: Column, blocked: list[str] = []) -> Column:  # noqa: B006
    """Substring match in either direction against an array of allowed points; an empty or '*' scope allows all, an empty point nothing."""
    bad = F.lit(False)
    for word in blocked:
        bad = bad | F.contains(point, F.lit(word))
    hit = F.exists(scope, lambda p: F.contains(point, p) | F.contains(p, point))
    return F.when(F.coalesce(F.length(point), F.lit(0)) == 0, F.lit(False)).when(bad, F.lit(False)).when((F.size(scope) == 0) | F.array_contains(scope, "*"), F.lit(True)).otherwise(hit)


#: Fixed values, applied in this order: unit words to signs. 克 comes before 千克, so 千克 becomes 千g.
UNITS = (("度", "°"), ("厘米", "cm"), ("毫米", "mm"), ("千米", "km"), ("克", "g"), ("千克", "kg"), ("吨", "t"), ("升", "L"), ("×", "x"), ("·", "x"))
#: Count words without a dimension, characters of units, and what ends an answer without a meaning.
COUNTERS = "条个名位次人本支只棵车辆天周月年页题"
CJK_UNITS = "平方厘米分毫千克升吨元"
LAST = ";；.。,，、！!"
_BETWEEN = "或|；|;|,|，|、|和"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))


def normal_answer(answer: Column) -> Column:
    """Full-width forms as plain ones, unit words as signs, no white space, no punctuation at the end."""
    out = F.translate(F.coalesce(answer, F.lit("")), _WIDE + "\u3000", "".join(chr(ord(c) - 0xFEE0) for c in _WIDE) + " ")
    for word, sign in UNITS:
        out = F.replace(out, F.lit(word), F.lit(sign))
    return F.rtrim(strip_space(out), F.lit(LAST))


def number(text: Column) -> Column:
    """An integer, decimal, fraction, percentage or radical (√12, 3√2, 3√(2)) as a double; else null."""
    part = lambda pattern, i=1: F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).try_cast("double")
    plain_, fraction, percent, radical = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)$", r"^([+-]?\d+)/([+-]?\d+)$", r"^([+-]?\d+(?:\.\d+)?)%$", r"^(\d*)√\(?(\d+)\)?$"
    return F.coalesce(part(plain_), F.try_divide(part(fraction), part(fraction, 2)), part(percent) / 100, F.coalesce(part(radical), F.lit(1.0)) * F.sqrt(part(radical, 2)))


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * 1e-9, F.lit(1e-9))


def equivalent(computed: Column, stored: Column) -> Column:
    """True: the same; false: surely different; null: cannot be told, so nothing may fail by it.

    Null if a side is empty. Equal normal forms are the same. Single letters A-F are choices. Alternatives are the same as sets of equal
    number. Two numbers compare at 1e-9; so do values of one unit, or with a count word, which has no dimension, on one side. All else is null."""
    pattern = f"^([+-]?\\d+(?:\\.\\d+)?)([A-Za-z°%]+|[{CJK_UNITS}]{{1,3}}|[一-鿿]{{1,2}})$"

    def side(x: Column) -> Column:
        parts = F.filter(F.transform(F.split(x, _BETWEEN), normal_answer), lambda p: p != "")
        unit = F.nullif(F.regexp_extract(x, pattern, 2), F.lit(""))
        return F.struct(x.alias("t"), parts.alias("parts"), number(x).alias("n"), F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")).try_cast("double").alias("v"), unit.alias("u"), F.coalesce(unit.rlike(f"^[{COUNTERS}]$"), F.lit(False)).alias("counts"))

    # Named once, so that no normal form is worked out again for each rule.
    named = F.transform(F.array(normal_answer(computed), normal_answer(stored)), side)

    def told(a: Column, b: Column) -> Column:
        letter = lambda x: x["t"].rlike("^[A-Fa-f]$")
        same = (F.size(a["parts"]) == F.size(b["parts"])) & (F.size(a["parts"]) >= 2) & (F.array_sort(F.array_distinct(a["parts"])) == F.array_sort(F.array_distinct(b["parts"])))
        return (
            F.when((a["t"] == "") | (b["t"] == ""), F.lit(None).cast("boolean"))
            .when(a["t"] == b["t"], F.lit(True))
            .when(letter(a) & letter(b), F.upper(a["t"]) == F.upper(b["t"]))
            .when(same, F.lit(True))
            .when(a["n"].isNotNull() & b["n"].isNotNull(), _close(a["n"], b["n"]))
            .when(a["u"].isNotNull() & b["u"].isNotNull() & ((a["u"] == b["u"]) | a["counts"] | b["counts"]), _close(a["v"], b["v"]))
            .when(a["u"].isNull() & a["n"].isNotNull() & b["counts"], _close(a["n"], b["v"]))
            .when(b["u"].isNull() & b["n"].isNotNull() & a["counts"], _close(b["n"], a["v"]))
        )

    both = F.transform(F.array(named), lambda s: told(F.element_at(s, 1), F.element_at(s, 2)))
    return F.element_at(both, 1)


def answer_form(answer: Column) -> Column:
    """The first form whose rule holds."""
    t = F.trim(F.coalesce(answer, F.lit("")))
    return (
        F.when(t == "", "missing")
        .when(t.rlike("^[A-D]$"), "choice_letter")
        .when(t.rlike("^[A-Z]{2,6}$"), "letter_abbrev")
        .when(t.rlike(r"^-?\d+(\.\d+)?$"), "pure_number")
        .when(t.rlike(r"^-?\d+/\d+$"), "fraction")
        .when(t.rlike(r"^-?\d+(\.\d+)?\s*[A-Za-z%°]+$"), "number_with_unit")
        .when(F.length(t) > 40, "long_solution")
        .when(t.rlike(r"[=+*/^]"), "expression_multi")
        .otherwise("short_text")
    )


def source_fields_kept(value: Column, provenance: Column) -> Column:
    """Whether a stored field is found in the text it came from, white space aside; null without a value."""
    return F.when(F.coalesce(F.length(strip_space(value)), F.lit(0)) == 0, F.lit(None).cast("boolean")).otherwise(F.contains(strip_space(provenance), strip_space(value)))
