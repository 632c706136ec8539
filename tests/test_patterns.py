"""The multi-pattern matcher against plain search, and rules over what it finds."""

import random

import numpy as np
import pytest

from attestra.operators import patterns


@pytest.mark.parametrize("held", [1 << 24, 0])
def test_hits_are_those_of_plain_search(spark, held):
    rng = random.Random(2)
    say = lambda n, letters="ab中𝔘é": "".join(rng.choice(letters) for _ in range(n))
    texts = [(i, say(rng.choice([0, 1, 2, 5, 40, 300]))) for i in range(120)] + [(500, None), (7, "ab"), (501, "a" * 3000)]
    words = sorted({say(rng.choice([1, 2, 3, 4, 7, 12])) for _ in range(400)} | {"aaaa", "zzz", "中"})
    table = [(k * 10 - 999, w) for k, w in enumerate(words)] + [(1 << 40, ""), (2 << 40, None)]
    got = patterns.hits(spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame(table, "pattern_id long, pattern string"), "i", "t", held=held).collect()
    want = sorted((i, k, t.find(w)) for i, t in texts if t for k, w in table if w and w in t)
    assert sorted(map(tuple, got)) == want and len(want) > 2000


def test_ten_thousand_patterns_take_one_pass():
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, rng.integers(97, 123, rng.integers(4, 12)))) for _ in range(10_000)]
    table = patterns.Patterns(list(range(len(words))), words)
    text = "".join(map(chr, rng.integers(97, 123, 400_000)))
    place, who, at = table.first_places(["", text, words[5]])
    assert [(w, a) for p, w, a in zip(place.tolist(), who.tolist(), at.tolist(), strict=True) if p == 1] == sorted((k, text.find(w)) for k, w in enumerate(words) if w in text)
    assert (2, 5, 0) in list(zip(place.tolist(), who.tolist(), at.tolist(), strict=True))
    # Places that are looked up are few: the bits rule out the others.
    gram, _, _, bits = table.of[3]
    assert bits[patterns._slot(patterns._grams(np.frombuffer(text.encode("utf-32-le"), np.uint32), 3))].mean() < 0.5 and len(gram) == len(words)


RULES = [("centers", "theme", 0, "直角三角形")] + [("centers", part, g, w) for part in ("signal", "required") for g, w in enumerate(("高线", "中线", "角平分线"))] + [("other", "theme", 0, "圆"), ("other", "signal", 0, "弧"), ("other", "signal", 0, "弦"), ("other", "required", 0, "圆周角"), ("other", "required", 0, "圆心角")]


def test_signals_ask_for_supported_knowledge(spark):
    texts = [("q1", "作高线、中线与角平分线"), ("q2", "作高线和中线"), ("q3", "一段弧上的高线、中线与角平分线")]
    know = lambda *x: [(n, s) for n, s in x]
    evidence = [
        ("a", "q1", "直角三角形的性质", know(("三角形的高线", True), ("中线", True), ("角平分线", False))),
        ("b", "q1", "圆", know()),
        ("c", "q1", None, know(("高线", True))),
        ("d", "q2", "直角三角形", know()),
        ("e", "q3", "", know(("圆心角", True), ("高线", True), ("中线", True), ("角平分线", True))),
        ("f", "q3", "圆和直角三角形", know(("圆", True))),
    ]
    got = patterns.signal_findings(spark.createDataFrame(evidence, "id string, question_id string, core_theme string, knowledge array<struct<name:string,supported:boolean>>"), spark.createDataFrame(texts, "question_id string, text string"), spark.createDataFrame(RULES, "rule string, part string, group int, pattern string"))
    first = "required_knowledge_incomplete_against_question_signals"
    assert {r["id"]: r["findings"] for r in got.collect()} == {
        "a": [first, "question_signal_rule:centers", "question_signal_missing_required:角平分线"],
        "c": [first, "question_signal_rule:centers", "question_signal_missing_required:中线,角平分线"],
        "f": [first, "question_signal_rule:centers", "question_signal_missing_required:高线,中线,角平分线", first, "question_signal_rule:other", "question_signal_missing_required:圆周角/圆心角"],
    }


def test_answers_leak_to_students_alone(spark):
    rows = [("s", "student", 1, "1. 求x"), ("s", "student", 2, "【答案】3"), ("s", "student", 3, "答:B"), ("t", "teacher", 1, "【答案】3"), ("s", "student", 4, None), ("s", "student", 5, "见解析")]
    got = patterns.leaks(spark.createDataFrame(rows, "artifact string, audience string, index int, text string"), spark.createDataFrame([("【答案",), ("解析",)], "pattern string"), answer_line=r"^答[:：]")
    assert sorted((r["artifact"], r["index"]) for r in got.collect()) == [("s", 2), ("s", 3), ("s", 5)]
