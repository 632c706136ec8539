"""Segmentation of questions and notes, text batches, progress decisions and samples, on small fixtures."""

import random
import re

from pyspark.sql import functions as F

from attestra.functions import items as it
from attestra.operators import gates, progress, questions, sampling


def blocks(spark, *docs):
    return spark.createDataFrame([(d, i, t) for d, texts in docs for i, t in enumerate(texts)], "doc string, ordinal int, raw_text string")


def told(texts, spans):
    """The substrings at spans, a line a block."""
    by = {}
    for b, a, z in spans:
        by[b] = by.get(b, "") + texts[b][a:z]
    return "\n".join(by.values())


def test_evidence_survives_strip_translate_and_split(spark):
    """Random papers with marks and white space of all kinds anywhere: every text is the substrings at its spans, and shown as plain Python shows it."""
    rng = random.Random(11)
    noise = lambda: "".join(rng.choice(" \t\u3000\xa0\x01\x07\x1f\u2003") for _ in range(rng.choice([0, 0, 1, 3])))
    word = lambda: noise() + "".join(rng.choice(["甲", "b", "\x07", "𝔘", " ", "é"]) for _ in range(rng.randint(1, 6))) + noise()
    docs = []
    for k in range(60):
        texts = [f"{noise()}".replace("\x01", "").replace("\x07", "") + "一、选择题"]
        for n in range(1, 5):
            texts.append(f"{n}.{word()}")
            texts.append(rng.choice([word(), f"{word()} A.{word()}x B．{word()}y\u3000C、z{word()}", f"A(图)\x01 B(图) \x01", ""]))
        texts.append("【答案与解析】")
        texts += [f"{n}. 【答案】{word()}{rng.choice(['', '【解析】' + word()])}" for n in range(1, 5)]
        docs.append((f"d{k}", texts))
    by = dict(docs)
    clean = lambda t: t.replace("\x01", "").replace("\x07", "").strip()
    got = questions.segment_questions(blocks(spark, *docs), "doc").collect()
    assert len(got) == 240
    for r in got:
        texts = by[r["doc"]]
        assert told(texts, r["stem_spans"]) == r["stem"]
        for o in r["options"]:
            assert texts[o["block"]][o["start"]] == o["label"]
            assert o["asset_only"] or (told(texts, o["text_spans"]) == o["text"] == clean(texts[o["block"]][o["start"] : o["end"]][2:]))
            assert not o["asset_only"] or texts[o["block"]][o["end"] - 1] == "\x01"
        for k in ("answer", "analysis"):
            assert [texts[b][a:z] for b, a, z in r[f"{k}_spans"] or []] == (r[k] or [])
        plain = [clean(re.split(r"(?:^|\s)[A-D][.．、]\s*", texts[b])[0]) if not re.search(r"(?:^|\s)[A-D][^\s\x01]{1,4}\s*\x01", texts[b]) else clean(re.split(r"(?:^|\s)[A-D][^\s\x01]{1,4}\s*\x01", texts[b])[0]) for b in range(r["first"], r["last"] + 1)]
        assert r["stem"] == "\n".join(x for x in plain if x)
    assert sum(len(r["stem_spans"]) for r in got) > 260 and any(o["text"] for r in got for o in r["options"])


def test_questions_have_their_options_and_answers(spark):
    paper = ["1. 不在任何部分里", "一、选择题", "1．下列正确的是\x07", "A. 甲 B. 乙", "C. 丙 D. 丁", "2. 图中", "A(图) \x01 B(图) \x01", "二、填空题", "3、填 ____", None, "【答案与解析】", "1. 【答案】A【解析】因为甲", "所以甲", "3. 【答案】 ", "3. 【答案】七"]
    out = {r["number"]: r for r in questions.segment_questions(blocks(spark, ("p", paper)), "doc").collect()}
    assert sorted(out) == ["1", "2", "3"] and all(r["problem"] is None for r in out.values())
    assert out["1"]["stem"] == "1．下列正确的是" and [(o["label"], o["text"]) for o in out["1"]["options"]] == [("A", "甲"), ("B", "乙"), ("C", "丙"), ("D", "丁")]
    assert out["1"]["answer"] == ["【答案】A"] and out["1"]["analysis"] == ["【解析】因为甲", "所以甲"]
    assert [(o["label"], o["text"], o["asset_only"]) for o in out["2"]["options"]] == [("A", None, True), ("B", None, True)] and out["2"]["answer"] is None
    assert (out["3"]["question_type"], out["3"]["section"], out["3"]["answer"], out["3"]["last"]) == ("填空题", 2, ["【答案】七"], 9)


def test_answers_without_a_heading_and_what_is_ambiguous(spark):
    bad = ["一、选择题", "1. 题 A. 甲 A. 乙", "2. 题 A. B", "3. 题", "A(图) \x01", "1. 【答案】A", "2. 【答案】B【解析】乙"]
    out = {r["number"]: r for r in questions.segment_questions(blocks(spark, ("p", bad), ("empty", ["没有题"])), "doc").collect()}
    assert {k: r["problem"] for k, r in out.items()} == {"1": "duplicate_option_label", "2": None, "3": "unreadable_option_assets"}
    assert out["2"]["answer"] == ["【答案】B"] and out["2"]["analysis"] == ["【解析】乙"] and out["3"]["answer"] is None
    assert questions.segment_questions(blocks(spark, ("p", ["一、选择题", "1. 题 A. 乙 B. "])), "doc").head()["problem"] == "empty_option_text"
    assert questions.segment_questions(blocks(spark, ("p", bad)).limit(0), "doc").count() == 0


def test_notes_and_examples(spark):
    text = ["序", "【学习目标】", "认识圆", "要点一、圆", "到定点", "", "【典型例题】", "类型一、计算", "引言", "1. 求", "【思路点拨】想", "【答案】3", "【变式】再求", "【解析】略", "2、 \x07", "类型二。证明", "3．证"]
    notes = questions.segment_notes(blocks(spark, ("d", text)), "doc").orderBy("first").collect()
    out = [(*r[:4], r["internal_text"], *r[7:]) for r in notes]
    for r in notes:
        assert told(text, r["student_spans"]) == r["student_text"] and told(text, r["internal_spans"]) == r["internal_text"]
    assert out == [
        ("d", "knowledge_note", "【学习目标】", "【学习目标】\n认识圆", "", 1, 2),
        ("d", "knowledge_note", "要点一、圆", "要点一、圆\n到定点", "", 3, 5),
        ("d", "worked_example", "类型一、计算", "1. 求", "【思路点拨】想\n【答案】3", 9, 11),
        ("d", "worked_example", "类型一、计算 / variant", "【变式】再求", "【解析】略", 12, 13),
        ("d", "worked_example", "类型一、计算", "2、", "", 14, 14),
        ("d", "worked_example", "类型二。证明", "3．证", "", 16, 16),
    ]


def test_text_batches_hold_what_fits(spark):
    rng = random.Random(5)
    rows = [(k, ["x" * rng.randrange(1, 30) + "".join(f"[图片: {rng.randrange(4)}]" for _ in range(rng.randrange(3))) for _ in range(rng.randrange(8))]) for k in range(40)]
    names = lambda b: [x.split("]")[0].strip() for x in b.split("[图片:")[1:]]
    got = spark.createDataFrame(rows, "k int, b array<string>").select("k", it.text_batches(F.col("b"), 60, 2).alias("x")).collect()
    for r in got:
        want, held = [], []
        for b in rows[r["k"]][1]:
            both = held + [b]
            if held and (sum(map(len, held)) + len(b) + 2 > 60 or len({n for h in both for n in names(h)}) > 2):
                want.append(held)
                both = [b]
            held = both
        want += [held] if held else []
        assert [(x["content"], x["images"]) for x in r["x"]] == [("\n\n".join(h), list(dict.fromkeys(n for b in h for n in names(b)))) for h in want]


def test_progress_is_decided_closed(spark):
    good = ("q", "approved", "AB" * 32, "t", ["n1", " n2 ", ""], "c", "t", "n2", ["n1", "n2"])
    cases = {
        (): good,
        ("mapping_not_approved",): ("q", None, *good[2:]),
        ("invalid_mapping_provenance",): (*good[:2], "g" * 64, *good[3:]),
        ("missing_mapped_nodes",): (*good[:4], [None, " "], *good[5:]),
        ("mapped_node_outside_active_progress",): (*good[:4], ["n1", "n3"], *good[5:]),
        ("current_node_not_allowed", "incomplete_active_progress"): (*good[:7], None, good[8]),
        ("textbook_mismatch",): (*good[:3], "u", *good[4:]),
        ("incomplete_active_progress", "missing_question_id"): ("", *good[1:5], " ", *good[6:]),
        ("current_node_not_allowed", "mapped_node_outside_active_progress"): (*good[:8], None),
    }
    schema = "question_id string, mapping_status string, provenance_hash string, question_textbook_id string, mapped array<string>, class_id string, class_textbook_id string, current_node string, allowed array<string>"
    for why, row in cases.items():
        out = progress.decide_progress(spark.createDataFrame([row], schema)).head()
        assert tuple(out["reasons"]) == why and out["status"] == ("blocked" if why else "within_active_progress")


def test_suggestions_that_are_not_sure_are_isolated(spark):
    nodes = [("k", "n1", "等腰三角形的性质", "t", "v"), ("k", "n2", "直角三角形", "t", "v"), ("k", "n3", "圆", "t", "v")]
    asked = [("a", "求等腰三角形的角", "t", "k"), ("b", "等腰三角形与直角三角形", "t", "k"), ("c", "圆", "t", "k"), ("d", None, "t", "k"), ("e", "直角三角形", "t", "none"), ("f", "直角三角形", None, "k")]
    out = progress.suggest_mapping(spark.createDataFrame(asked, "question_id string, text string, textbook_id string, catalog string"), spark.createDataFrame(nodes, "catalog string, node_id string, name string, textbook_id string, catalog_version string"))
    assert {r["question_id"]: (r["node_id"], r["confidence"], tuple(r["reasons"])) for r in out.collect()} == {
        "a": ("n1", 1.0, ()),
        "b": (None, None, ("ambiguous_top_candidate",)),
        "c": (None, None, ("no_exact_catalog_anchor",)),
        "d": (None, None, ("missing_question_text",)),
        "e": (None, None, ("no_catalog_nodes",)),
        "f": (None, None, ("cross_textbook_catalog_node", "missing_textbook_id")),
    }


def test_a_sample_of_two_levels_meets_its_targets(spark):
    rows = [(i, "ab"[i % 3 == 0], [None, "x", "y"][i % 7 % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, s string, r string")
    got = sampling.two_level(df, "s", "r", "id", {"a": 10, "b": 500}, "z").collect()
    assert sum(x["s"] == "a" for x in got) == 10 and {x["id"] for x in got if x["s"] == "b"} == {i for i, s, _ in rows if s == "b"}
    sizes = {r: sum(x[1:] == ("a", r) for x in rows) for r in (None, "x", "y")}
    for r, n in sizes.items():
        assert abs(sum(x["s"] == "a" and x["r"] == r for x in got) - 10 * n / 60) < 1


def test_only_eligible_items_are_approved(spark):
    out = spark.createDataFrame([(True,), (False,), (None,)], "e boolean").select(gates.applied(F.col("e")).alias("x")).collect()
    assert [tuple(r["x"]) for r in out] == [("approved", "approved"), ("blocked", "pending"), ("blocked", "pending")]
