"""Questions, notes and worked examples of source documents, from their ordered blocks. A document's blocks are handled together.

Every text that is given comes with its evidence: spans (block, start, end) whose substrings of the blocks' raw texts are that text, the parts of
different blocks with a line feed between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.spans import SPACE, cut, matches, named, shown, shown_runs

#: What begins a section, an item and an option (with text, or with a placed image alone); what begins answers.
SECTION = rf"^[{SPACE}]*[一-鿿]+[.．、][{SPACE}]*(选择题|填空题|计算题|解答题)"
NUMBER = rf"^[{SPACE}]*(\p{{Nd}}+)[.．、]"
OPTION = rf"(?:^|[{SPACE}])([A-D])[.．、][{SPACE}]*"
PLACED_OPTION = rf"(?:^|[{SPACE}])([A-D])[^{SPACE}\x01]{{1,4}}[{SPACE}]*\x01"
HEADING, ANSWER, ANALYSIS = "【答案与解析】", "【答案】", "【解析】"
#: What begins notes, types, examples and what only teachers see.
TYPICAL, GOAL, VARIANT = "【典型例题】", "【学习目标】", "【变式】"
POINT, TYPE, EXAMPLE = "^要点[一-鿿]+、", "^类型[一-鿿]+[、。]", r"^\s*\d+[,、.．]"
INTERNAL = ("【思路点拨】", "【答案", "【解析", "【总结升华】")


def _running(document: str, *more: str):
    return Window.partitionBy(document, *more).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)


def _count(starts: Column, w) -> Column:
    return F.sum(F.coalesce(starts, F.lit(False)).cast("long")).over(w)


def _ordered(cond: Column, *columns: Column) -> Column:
    """The columns of rows for which the condition holds, in order. Fields of what comes out are arrays."""
    return F.sort_array(F.collect_list(F.when(cond, F.struct(F.col("ordinal"), *columns))))


def _with_parts(blocks: DataFrame, asked: Column) -> DataFrame:
    """blocks with _stem, _stem_spans, _options and _problem of those that are asked. An option reaches from its label to the next one (or the block's end), its
    text lies behind its label; one of an image alone reaches to the image's mark."""
    raw, ordinal = F.coalesce(F.col("raw_text"), F.lit("")), F.col("ordinal")
    out = blocks.withColumns({"_told": F.when(asked, matches(raw, OPTION, hint="[A-D][.．、]")), "_placed": F.when(asked, matches(raw, PLACED_OPTION, hint="\x01"))})
    told, placed = F.col("_told"), F.col("_placed")
    alone = F.size(placed) > 0
    # A match may begin with the white space before its label.
    label_at = lambda m: (m["start"] + F.when(cut(raw, m["start"], m["start"] + 1) == m["value"], 0).otherwise(1)).cast("int")
    option = lambda m, end, value, spans, only: F.struct(m["value"].alias("label"), value.alias("text"), F.lit(only).alias("asset_only"), ordinal.alias("block"), label_at(m).alias("start"), end.cast("int").alias("end"), spans.alias("text_spans"))
    end_of = lambda i: F.coalesce(F.get(told, i + 1)["start"], F.length(raw))
    written = F.transform(told, lambda m, i: named(cut(raw, m["end"], end_of(i)), lambda t: option(m, m["end"] + F.length(t), shown(t), shown_runs(t, m["end"], ordinal), False)))
    nowhere = F.array_repeat(F.struct(ordinal.alias("block"), F.lit(0).alias("start"), F.lit(0).alias("end")), 0)
    images = F.transform(placed, lambda m: option(m, m["end"], F.lit(None).cast("string"), nowhere, True))
    until = F.when(alone, label_at(F.get(placed, 0))).when(F.size(told) > 0, label_at(F.get(told, 0))).otherwise(F.length(raw))
    out = out.withColumns({"_options": F.when(alone, images).otherwise(written), "_until": until})
    labels = F.col("_placed.value")
    bad = F.when(alone & ((F.size(labels) < 2) | (F.size(F.array_distinct(labels)) < F.size(labels))), "unreadable_option_assets").when(~alone & F.array_contains(F.col("_options.text"), ""), "empty_option_text")
    return out.withColumns({"_stem": F.when(asked, shown(cut(raw, F.lit(0), F.col("_until")))), "_stem_spans": F.when(asked, shown_runs(cut(raw, F.lit(0), F.col("_until")), block=ordinal)), "_problem": F.when(asked, bad)})


def segment_questions(blocks: DataFrame, document: str) -> DataFrame:
    """document, section (from 1), item (from 1), number, question_type, stem, stem_spans, options, answer, answer_spans, analysis, analysis_spans, first, last, problem.

    An option has label, text, asset_only, its place (block, start, end), and text_spans. answer and analysis are arrays of texts, with a span each.

    blocks: document, ordinal, raw_text. Questions stand in sections before the first answer heading or numbered block with an answer mark;
    answers behind it belong to the question of their number, the last entry of a number if there are several. What cannot be read for sure has
    a problem (empty_option_text, unreadable_option_assets, question_stem_missing or duplicate_option_label) and must not be taken. Blocks are shuffled once, by document.
    """
    raw = F.coalesce(F.col("raw_text"), F.lit(""))
    numbered = raw.rlike(NUMBER)
    answers_at = F.min(F.when(F.contains(raw, F.lit(HEADING)) | (numbered & F.contains(raw, F.lit(ANSWER))), F.col("ordinal"))).over(Window.partitionBy(document))
    cut_ = blocks.select(document, "ordinal", "raw_text", answers_at.alias("_at"))
    behind = F.when(F.col("_at").isNull() | (F.col("ordinal") < F.col("_at")), False).when((F.col("ordinal") > F.col("_at")) | ~F.contains(raw, F.lit(HEADING)), True)
    cut_ = cut_.select(document, "ordinal", "raw_text", behind.alias("_behind"), F.when(numbered, F.regexp_extract(raw, NUMBER, 1)).alias("_number"), F.when(~behind, F.nullif(F.regexp_extract(raw, SECTION, 1), F.lit(""))).alias("_type")).where("_behind IS NOT NULL")
    cut_ = cut_.withColumns({"section": _count(F.col("_type").isNotNull(), _running(document, "_behind")), "question_type": F.last("_type", ignorenulls=True).over(_running(document, "_behind"))})
    cut_ = cut_.where("_behind OR section > 0").withColumn("item", _count(F.col("_number").isNotNull(), _running(document, "_behind", "section"))).where("item > 0")
    cut_ = _with_answers(_with_parts(cut_, ~F.col("_behind")), F.col("_behind"))
    per = cut_.groupBy(document, "_behind", "section", "item").agg(
        F.min_by("_number", "ordinal").alias("number"), F.min("question_type").alias("question_type"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"),
        _ordered(~F.col("_behind"), *(F.col(c) for c in ("_stem_spans", "_options"))).alias("_p"), _ordered(F.col("_stem") != "", F.col("_stem")).alias("_s"),
        F.min_by("_problem", F.when(F.col("_problem").isNotNull(), F.col("ordinal"))).alias("_problem"), *(_ordered(F.col(k).isNotNull(), F.col(k)).alias(k) for k in ("_answer", "_analysis")),
    )
    # The last entry of a number, next to its questions.
    same = Window.partitionBy(document, "number")
    given = F.max_by(F.when(F.col("_behind"), F.struct("_answer", "_analysis")), F.when(F.col("_behind"), F.col("item"))).over(same)
    per = per.withColumn("_e", given).where("NOT _behind").withColumns({"stem": F.array_join("_s._stem", "\n"), "stem_spans": F.flatten("_p._stem_spans"), "options": F.flatten("_p._options")})
    labels = F.col("options.label")
    problem = F.coalesce("_problem", F.when(F.size("_s") == 0, "question_stem_missing"), F.when(F.size(F.array_distinct(labels)) < F.size(labels), "duplicate_option_label"))
    told = [F.col(f"_e._{k}._{k}.{field}").alias(name) for k in ("answer", "analysis") for field, name in (("text", k), ("span", f"{k}_spans"))]
    return per.select(document, "section", "item", "number", "question_type", "stem", "stem_spans", "options", *told, "first", "last", problem.alias("problem"))


def _with_answers(blocks: DataFrame, behind: Column) -> DataFrame:
    """blocks with _answer and _analysis (text and span) of those behind the questions: the marked texts, from their marks on."""
    raw = F.coalesce(F.col("raw_text"), F.lit(""))
    a, b, whole = F.locate(ANSWER, raw) - 1, F.locate(ANALYSIS, raw) - 1, F.length(raw)
    stop = F.when(b > a + len(ANSWER), b).otherwise(whole)
    span = lambda start, end: F.struct(cut(raw, start, end).alias("text"), F.struct(F.col("ordinal").alias("block"), start.cast("int").alias("start"), end.cast("int").alias("end")).alias("span"))
    filled = lambda start, end: shown(cut(raw, start, end)) != ""
    answer = F.when(behind & (a >= 0) & filled(a + len(ANSWER), stop), span(a, stop))
    analysis = F.when(behind & (b >= 0), F.when(filled(b + len(ANALYSIS), whole), span(b, whole))).when(behind & F.col("_number").isNull() & (shown(raw) != ""), span(F.lit(0), whole))
    return blocks.withColumns({"_answer": answer, "_analysis": analysis})


def segment_notes(blocks: DataFrame, document: str) -> DataFrame:
    """document, item_kind (knowledge_note or worked_example), title, student_text, student_spans, internal_text, internal_spans, first, last.

    Notes begin at the learning goals or a point, before the typical examples (or the first type); examples stand under a type, and what
    follows the first mark of hints, answers or summaries in one is internal. Items without a text for students go.
    """
    raw = F.coalesce("raw_text", F.lit(""))
    whole = Window.partitionBy(document)
    cut_ = blocks.select(document, "ordinal", shown(raw).alias("_t"), shown_runs(raw, block=F.col("ordinal")).alias("_runs")).withColumn("_is_type", F.col("_t").rlike(TYPE))
    cut_ = cut_.withColumns({"_typical": F.min(F.when(F.contains("_t", F.lit(TYPICAL)), F.col("ordinal"))).over(whole), "_types": F.min(F.when(F.col("_is_type"), F.col("ordinal"))).over(whole)})
    # A block may be both a note's and an example's: then it is there twice.
    note, typed = F.coalesce(F.col("ordinal") < F.coalesce("_typical", "_types"), F.lit(True)), F.coalesce(F.col("ordinal") >= F.col("_types"), F.lit(False))
    sides = F.when(note & typed, F.array(F.lit(False), F.lit(True))).when(note, F.array(F.lit(False))).when(typed, F.array(F.lit(True)))
    each = cut_.select(document, "ordinal", "_t", "_runs", "_is_type", F.explode(sides).alias("_typed"))
    begins = F.col("_typed") & F.col("_is_type")
    each = each.withColumns({"_group": _count(begins, _running(document, "_typed")), "_name": F.last(F.when(begins, F.col("_t")), ignorenulls=True).over(_running(document, "_typed"))})
    variant = F.startswith("_t", F.lit(VARIANT))
    starts = F.when(F.col("_typed"), ~F.col("_is_type") & (F.col("_t").rlike(EXAMPLE) | variant)).otherwise((F.col("_t") == GOAL) | F.col("_t").rlike(POINT))
    each = each.withColumn("_item", _count(starts, _running(document, "_typed", "_group"))).where("_item > 0")
    mark = F.lit(False)
    for m in INTERNAL:
        mark = mark | F.startswith("_t", F.lit(m))
    each = each.withColumn("_inner", _count(F.col("_typed") & mark, _running(document, "_typed", "_group", "_item")) > 0)
    shown_, hidden = ~F.col("_inner") & (F.col("_t") != ""), F.col("_inner") & (F.col("_t") != "")
    out = each.groupBy(document, "_typed", "_group", "_item").agg(F.min_by("_t", "ordinal").alias("_t"), F.min("_name").alias("_name"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), *(_ordered(c, F.col("_t"), F.col("_runs")).alias(n) for n, c in (("_s", shown_), ("_h", hidden))))
    title = F.when(~F.col("_typed"), F.col("_t")).otherwise(F.concat("_name", F.when(variant, " / variant").otherwise("")))
    kind = F.when(~F.col("_typed"), "knowledge_note").otherwise("worked_example")
    said = {f"{n}_text": F.array_join(f"{c}._t", "\n") for n, c in (("student", "_s"), ("internal", "_h"))} | {f"{n}_spans": F.flatten(f"{c}._runs") for n, c in (("student", "_s"), ("internal", "_h"))}
    return out.withColumns(said).where("student_text <> ''").select(document, kind.alias("item_kind"), title.alias("title"), "student_text", "student_spans", "internal_text", "internal_spans", "first", "last")
