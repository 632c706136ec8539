"""Texts of content items as Column expressions: options, blocks, references, anchors, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import named, running

_BLANK = " \t\n\r\x0b\x0c"

#: Option letters and what follows them; blanks of a gap; reasons to leave an item to people; known difficulties.
OPTION = r"(?<!\S)([A-F])[.．、]\s*"
GAP = "____"
PREFILTER = (("prefilter_missing_condition", r"，，|,,|，\s{2,}，"), ("prefilter_stem_content_missing", r"[:：=＝]\s*[/／]\s*$"), ("prefilter_solution_residual", "[∴∵]"))
DIFFICULTIES, BASIC = ("基础", "中等", "高", "拓展"), "基础"
#: Terms, conditions and signs that anchor an item's scope.
TERMS = ("三角形", "等腰三角形", "全等", "勾股", "函数", "方程", "不等式", "平行线", "相似", "圆", "角", "面积", "周长", "坐标")
CONDITIONS = ("已知", "若", "当", "因为", "则", "求", "证明", "设")
SYMBOLS = r"[=＋+－\-×*/÷<>≤≥≈√²³π∠△⊥∥]"


def _strip(x: Column) -> Column:
    return F.btrim(x, F.lit(_BLANK))


def _empty() -> Column:
    return F.array().cast("array<string>")


def split_options(stem: Column) -> Column:
    """struct<stem, options>: conventional A-F choices behind the stem; without two of them from A on, or with an empty one, all is stem."""
    lines = F.filter(F.transform(F.split(F.coalesce(stem, F.lit("")), r"\r\n|\n|\r"), _strip), lambda x: x != "")
    named = F.transform(F.array(F.array_join(lines, "\n")), lambda t: F.struct(t.alias("t"), F.regexp_extract_all(t, F.lit(OPTION), F.lit(1)).alias("k"), F.transform(F.split(t, OPTION, -1), _strip).alias("p")))

    def told(s: Column) -> Column:
        values = F.slice(s["p"], 2, F.greatest(F.size(s["p"]) - 1, F.lit(0)))
        good = (F.size(s["k"]) >= 2) & (F.get(s["k"], 0) == "A") & ~F.exists(values, lambda v: v == "")
        options = F.zip_with(s["k"], values, lambda k, v: F.concat(k, F.lit(". "), v))
        return F.struct(F.when(good, F.get(s["p"], 0)).otherwise(s["t"]).alias("stem"), F.when(good, options).otherwise(_empty()).alias("options"))

    return F.element_at(F.transform(named, told), 1)


def strip_option_prefix(option: Column) -> Column:
    return F.regexp_replace(_strip(F.coalesce(option, F.lit(""))), r"^[A-F][.、]\s*", "")


def question_type(stem: Column, options: Column) -> Column:
    return F.when(F.size(options) > 0, "选择题").when(F.contains(stem, F.lit(GAP)), "填空题").otherwise("待分类")


def prefilter_reason(stem: Column) -> Column:
    """The first rule that sends a stem to people; null if none does."""
    out = F.lit(None).cast("string")
    for rule, pattern in reversed(PREFILTER):
        out = F.when(stem.rlike(pattern), rule).otherwise(out)
    return out


def difficulty_or_basic(value: Column) -> Column:
    """Unknown difficulties count as basic; empty and null ones stay."""
    return F.when((F.coalesce(F.length(value), F.lit(0)) > 0) & ~value.isin(*DIFFICULTIES), BASIC).otherwise(value)


def hash_prefix(value: Column, n: int = 12) -> Column:
    return F.lower(F.substring(value, 1, n))


def composite_id(*parts: Column) -> Column:
    """SHA-256 of the parts between NULs; a null part is empty."""
    return F.sha2(F.array_join(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), "\u0000"), 256)


def image_refs(text: Column) -> Column:
    """Names in [图片1: name] marks, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[图片(?:\d+)?:\s*([^\]]+)\]"), F.lit(1)), _strip), lambda x: x != ""))


def numbered_blocks(text: Column) -> Column:
    """A text cut at lines that begin with a number and a point; with fewer than two of them, the text itself."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    mark = r"(?m)^\s*\d+\."
    blocks = F.filter(F.transform(F.split(plain, rf"(?={mark})"), _strip), lambda x: x.rlike(r"^\d+\."))
    whole = F.when(_strip(plain) == "", _empty()).otherwise(F.array(_strip(plain)))
    return F.when(F.regexp_count(plain, F.lit(mark)) < 2, whole).otherwise(blocks)


def occurrences(text: Column, fragment: Column) -> Column:
    """Offsets of the fragment's occurrences that do not overlap, from the left, by running lengths of what lies between; an empty fragment has none."""
    quoted = F.regexp_replace(fragment, r"([^\p{L}\p{N}\s])", r"\\$1")
    pieces = F.split(text, quoted, -1)
    return F.when(fragment == "", F.array().cast("array<int>")).otherwise(named(F.struct(pieces.alias("p"), F.length(fragment).alias("n")), lambda x: F.transform(running(F.transform(F.slice(x["p"], 1, F.size(x["p"]) - 1), lambda p: F.length(p) + x["n"])), lambda end: end - x["n"])))


def label_anchors(name: Column, least: int = 4) -> Column:
    """All substrings of `least` characters or more of the name's runs of Chinese characters, longest first."""
    runs = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(f"[一-鿿]{{{least},}}"), F.lit(0))
    sized = lambda r, n: F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substring(r, i, n))
    every = F.flatten(F.transform(runs, lambda r: F.flatten(F.transform(F.sequence(F.lit(least), F.length(r)), lambda n: sized(r, n)))))
    return F.transform(F.array_sort(F.transform(F.array_distinct(every), lambda a: F.struct((-F.length(a)).alias("n"), a.alias("a")))), lambda s: s["a"])


def scope_anchors(text: Column) -> Column:
    """array<struct<kind, anchor, start, end>> of terms, signs and conditions in the text without white space, by kind and start."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    of = lambda kind, a: F.transform(occurrences(plain, F.lit(a)), lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("start"), F.lit(a).alias("anchor"), (i + len(a)).alias("end")))
    signs = F.filter(F.transform(F.split(plain, ""), lambda c, i: F.struct(F.lit("symbol").alias("kind"), i.alias("start"), c.alias("anchor"), (i + 1).alias("end"))), lambda s: s["anchor"].rlike(f"^{SYMBOLS}$"))
    return F.array_sort(F.flatten(F.array(*(of("term", t) for t in TERMS), *(of("condition", t) for t in CONDITIONS), signs)))


def progress_label(text: Column) -> Column:
    """struct<type, numeral> of exactly 第N章 or 第N单元, white space aside; nulls otherwise."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    pattern = "^第([0-9零一二三四五六七八九十百千万两]+)(章|单元)$"
    part = lambda i: F.nullif(F.regexp_extract(bare, pattern, i), F.lit(""))
    return F.struct(F.when(part(2) == "章", "chapter").when(part(2) == "单元", "unit").alias("type"), part(1).alias("numeral"))


def progress_request(text: Column) -> Column:
    """struct<textbook, type, numeral> of exactly `textbook，进度第N章` with one comma; nulls otherwise."""
    raw = _strip(F.coalesce(text, F.lit("")))
    pieces = F.split(raw, "[，,]", -1)
    book, rest = _strip(F.get(pieces, 0)), F.regexp_replace(F.get(pieces, 1), r"\s+", "")
    label = progress_label(F.when((F.size(pieces) == 2) & (book != "") & F.startswith(rest, F.lit("进度")), F.substring(rest, F.lit(3), F.length(rest))))
    return F.struct(F.when(label["type"].isNotNull(), book).alias("textbook"), label["type"].alias("type"), label["numeral"].alias("numeral"))


def text_batches(blocks: Column, most_chars: int, most_images: int) -> Column:
    """array<struct<content, images>>: the blocks in order, joined by empty lines, as many to a batch as fit; a block that is too large is one alone.
    Images are the marks' names, each once a batch."""
    batch = lambda s: F.struct(F.array_join(s["held"], "\n\n").alias("content"), s["images"].alias("images"))
    none = F.array().cast("array<struct<content:string,images:array<string>>>")
    start = F.struct(none.alias("done"), _empty().alias("held"), _empty().alias("images"), F.lit(0).alias("chars"))

    def step(s: Column, b: Column) -> Column:
        images, some = F.array_union(s["images"], image_refs(b)), F.size(s["held"]) > 0
        full = some & ((s["chars"] + F.length(b) + 2 > most_chars) | (F.size(images) > most_images))
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(batch(s)))).otherwise(s["done"]).alias("done"),
            F.when(full, F.array(b)).otherwise(F.concat(s["held"], F.array(b))).alias("held"),
            F.when(full, image_refs(b)).otherwise(images).alias("images"),
            F.when(full, F.length(b)).otherwise(s["chars"] + F.length(b)).alias("chars"),
        )

    return F.aggregate(blocks, start, step, lambda s: F.when(F.size(s["held"]) > 0, F.concat(s["done"], F.array(batch(s)))).otherwise(s["done"]))
