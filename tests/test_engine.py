"""The engine's operators on hand-built rows."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from attestra.functions import items as it
from attestra.functions import text as tx
from attestra.functions import udfs
from attestra.operators import candidates, gates, integrity, latest, reports, sampling, segment, selection, similarity, snapshots, tables, tree
from attestra.sources import documents

KINDS = ["asset_semantics", "mathematical_independent", "source_fidelity", "structural_consistency", "textbook_scope"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_latest_rules_differ_on_back_dated_rows(spark):
    log = spark.createDataFrame([("q", "t", 1, 10, "pass"), ("q", "t", 2, 5, "fail")], "item string, kind string, seq int, at int, status string")
    assert rows(latest.latest_per_key(log, ["item", "kind"], ["seq"], ["status"])) == [("q", "t", "fail")]
    assert rows(latest.latest_per_key(log, ["item", "kind"], ["at", "seq"], ["status"])) == [("q", "t", "pass")]


def test_admission_needs_all_kinds_and_a_live_snapshot(spark):
    log = spark.createDataFrame([(q, k, i, "pass" if (q, k) != ("b", "textbook_scope") else "unsupported", "H" if q != "c" else "old") for q in "abcd" for i, k in enumerate(KINDS)], "item string, kind string, seq int, status string, input_hash string")
    snaps = spark.createDataFrame([("a", "h", "H", False), ("b", "h", "h", False), ("c", "h", "h", False), ("d", "h", "h", True), ("e", "h", "h", False)], "item string, input_hash string, live_hash string, invalidated boolean")
    got = {r["item"]: r for r in gates.admission(log, "item", "kind", "status", KINDS, ["seq"], snaps).collect()}
    assert got["a"]["eligible"]
    assert got["b"]["missing"] == ["textbook_scope"] == got["b"]["blockers"]
    assert got["c"]["blockers"] == KINDS and not got["c"]["eligible"]
    assert got["d"]["blockers"] == ["input_snapshot"] and got["d"]["missing"] == KINDS
    assert got["e"]["missing"] == KINDS and not got["e"]["eligible"]


def test_selection_history_reuse_and_shortage(spark):
    items = spark.createDataFrame([(q, "c1", i) for i, q in enumerate(["q1", "q2", "q3"])], "q string, class string, created int")
    used = spark.createDataFrame([("q1", "c1"), ("q2", "c1"), ("q3", "c2")], "q string, class string")
    allowed = spark.createDataFrame([("q2", "c1")], "q string, class string")
    free = selection.not_delivered(items, used, allowed, "q", "class")
    assert [r["q"] for r in selection.select_items(free, "q", ["created"], 5).orderBy("position").collect()] == ["q2", "q3"]
    with pytest.raises(ValueError):
        selection.select_items(free, "q", ["created"], 0)
    demand = spark.createDataFrame([("c1", 3)], "class string, wanted long")
    assert rows(selection.shortage(demand, free, ["class"], "wanted")) == [("c1", 3, 2, 1, "blocked")]


def test_review_eligibility_and_fold(spark):
    reviews = spark.createDataFrame([("a", "x", "approved"), ("a", "y", "approved"), ("b", "x", "approved"), ("b", "x", "rejected")], "i string, k string, d string")
    assert rows(gates.review_quorum(reviews, "i", "k", "d", ["x", "y"])) == [("a", [], [], True), ("b", ["x", "y"], ["x"], False)]
    items, e = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a",)], "k string")
    assert rows(gates.eligibility(items, "k", e, e, e))[1] == ("b", False, "mathematical_validation_missing_or_nonpassing")
    fold = spark.createDataFrame([("s", "equal"), ("s", "loss"), ("t", "equal"), ("u", "odd")], "k string, o string")
    assert rows(gates.fold_by_precedence(fold, "k", "o", ["loss", "equal"])) == [("s", "loss"), ("t", "equal"), ("u", "unknown")]


def test_source_relationship(spark):
    pairs = spark.createDataFrame([("H", "h", "a.docx", None, "s", "t"), ("1", "2", "unit test v1 final.docx", "unit test v2.docx", "alpha beta gamma", "alpha beta gamma"), ("1", "2", "x.docx", "y.docx", "abc def", "zzz qqq"), ("1", "2", "x.docx", "", "a", "b")], "ha string, hb string, fa string, fb string, sa string, sb string")
    got = [r["decision"] for r in similarity.relationship(pairs, "ha", "hb", "fa", "fb", "sa", "sb").collect()]
    assert got == ["exact_duplicate", "suspected_same_family", "no_match", "insufficient_input"]


@pytest.mark.parametrize("a,b,want", [("26或22", "22或26", True), ("1/2", "0.5", True), ("50%", "0.5", True), ("40cm", "40厘米", True), ("2条", "2", True), ("A", "b", False), ("A", "3", None), ("", "3", None), (None, "3", None), ("AB", "ba", None), ("40cm", "40kg", None), ("x+1", "1+x", None), ("40cm", "40m", None), ("√4", "2", True), ("3√2", "√18", True), ("√5", "2", False), ("1.0或2", "1或2", None), ("ABC", "CBA", None), ("A", "a", True), ("f", "F", True), ("40度", "40°", True), ("５０％", "0.5", True), ("2条", "3", False), ("2×3", "2·3", True), ("10吨", "10t", True), ("3，4", "4、3", True), ("130元", "130", None), ("2个", "2名", True)])
def test_equivalence(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(tx.equivalent(F.col("a"), F.col("b"))).first()[0] is want


def test_answer_normal_form_keeps_the_unit_order(spark):
    df = spark.createDataFrame([("3千克。", "30度", "")], "a string, b string, c string")
    assert tuple(df.select(tx.normal_answer("a"), tx.normal_answer("b"), tx.answer_form(F.col("c"))).first()) == ("3千g", "30°", "missing")


def test_keyword_grams_and_scope(spark):
    df = spark.createDataFrame([("等腰三角形abc", "角形")], "s string, p string")
    got = df.select(tx.keyword_grams(F.col("s")).alias("g"), tx.in_scope(F.col("p"), F.array(F.lit("三角形"))).alias("i"), tx.in_scope(F.lit(""), F.array(F.lit("*"))).alias("e"), tx.in_scope(F.col("p"), F.array().cast("array<string>")).alias("n")).first()
    assert got["g"][:2] == ["等腰三角", "腰三角形"] and "角形" in got["g"] and (got["i"], got["e"], got["n"]) == (True, False, True)
    gaps = spark.createDataFrame([("等腰，三角", "x")], "s string, p string").select(tx.keyword_grams(F.col("s"))).first()[0]
    assert gaps == ["等腰三角", "等腰三", "腰三角", "等腰", "腰三", "三角"]
    names = spark.createDataFrame([("Unit ver2 rev3 r1 final Revised.docx",)], "f string").select(tx.file_base(F.col("f"))).first()[0]
    assert names == "unit"


def test_classify_and_scope_decision(spark):
    items = spark.createDataFrame([(1, "已知等腰 三角形的面积"), (2, "求函数值"), (3, None), (4, "圆的周长公式"), (5, "x3y")], "q int, stem string")
    nodes = spark.createDataFrame([("n1", "等腰三角形"), ("n2", "圆周长"), ("n3", "函数"), ("n4", "圆"), ("n5", "x3")], "n string, name string")

    def score(stem, name):
        stem = stem or ""
        if len(name) >= 2 and name in stem.replace(" ", ""):
            return 1.0
        grams = lambda t: list(dict.fromkeys(c[i : i + n] for c in ["".join(x for x in t if "一" <= x <= "鿿")] for n in (4, 3, 2) for i in range(len(c) - n + 1)))
        g, h = grams(stem), grams(name)
        if not g or not h:
            return 0.0
        p_, r_ = sum(k in name for k in g) / len(g), sum(k in stem for k in h) / len(h)
        return 2 * p_ * r_ / (p_ + r_) if p_ + r_ else 0.0

    want = []
    for q, stem in items.collect():
        ranked = sorted(((-round(score(stem, name), 4), n) for n, name in nodes.collect()))
        want += [(q, n, -x, k + 1) for k, (x, n) in enumerate(ranked[:3]) if -x >= 0.35]
    assert rows(similarity.classify(items, nodes, "q", "stem", "n", "name")) == sorted(want) and len(want) >= 3
    m = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (2, "b", 5), (3, "x", 5), (4, "a", 5), (4, "x", 4)], "q int, n string, longest int")
    got = {r["q"]: (r["status"], r["reason"]) for r in similarity.scope_decision(m, "q", "n", "longest", F.col("n").isin("a", "b")).collect()}
    assert got == {1: ("candidate", "unique_evidence_chain"), 2: ("rejected", "ambiguous_top_candidate"), 3: ("rejected", "candidate_node_outside_allowed_progress"), 4: ("rejected", "candidate_node_outside_allowed_progress")}


def test_decisions_need_few_anchors(spark):
    """The same decisions with and without the anchors that none needs."""
    import random

    rng = random.Random(6)
    anchors = spark.createDataFrame([(rng.choice(["four", "fiver", "sixsix", "that", "with", "seven77"]), rng.randrange(30)) for _ in range(40)] + [("lone", 3), ("outer", 1), ("five5", 6)], "w string, n int")
    words = spark.createDataFrame([(d, w) for d in range(60) for w in rng.sample(["four", "fiver", "sixsix", "that", "with", "lone", "outer", "five5", "none"], rng.randint(1, 2))], "d int, w string")
    inside = F.col("n") % 3 == 0
    told = lambda a: rows(similarity.scope_decision(words.join(a, "w").groupBy("d", "n").agg(F.max(F.length("w")).alias("longest")), "d", "n", "longest", inside))
    few = similarity.deciding_anchors(anchors, "w", "n", inside)
    assert told(few) == told(anchors) and few.count() <= 27 and few.count() < anchors.distinct().count() and len({r[2] for r in told(few)}) >= 3


def test_first_similar_is_that_of_all_pairs(spark):
    import difflib
    import random

    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def ratio(a, b):
        return __import__("pandas").Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(3, 30))) for _ in range(25)]
    texts = [rng.choice(base) for _ in range(50)] + ["".join(c for c in t if rng.random() > 0.06) for t in base * 2] + ["", "", "a"]
    items = [(k, "s" if k % 3 else "t", t) for k, t in enumerate(texts)]
    want = {}
    for k, s, t in items:
        for j, z, o in items[:k]:
            if z == s and (r := 1.0 if t == o else difflib.SequenceMatcher(None, t, o).ratio()) >= 0.9:
                want[k] = (j, round(r, 9))
                break
    got = similarity.find_similar(spark.createDataFrame(items, "k int, s string, t string"), "k", "t", "s", ratio).collect()
    assert {r["k"]: (r["similar_to"], round(r["ratio"], 9)) for r in got} == want and 30 < len(want) < len(items)


def test_passages_of_any_length_are_found(spark):
    texts = [(1, "a b c d e f g h i"), (2, "x one two y"), (3, None), (4, "zone twofold")]
    passages = [(10, "b c d e f g h"), (11, "one two"), (12, "two y"), (13, "nowhere"), (14, "i"), (15, None)]
    got = similarity.contained(spark.createDataFrame(texts, "d int, t string"), spark.createDataFrame(passages, "q int, p string"), "d", "t", "q", "p")
    assert rows(got) == sorted((d, q) for d, t in texts for q, p in passages if t and p and p in t)


def test_segments_owners_overlaps(spark):
    b = spark.createDataFrame([("d", i, t) for i, t in enumerate(["head", "1. a", "x", "2. b"])], "d string, o int, t string")
    got = rows(segment.segments(b, "d", "o", F.col("t").rlike(r"^\d+\."), "t"))
    assert got == [("d", 0, 0, 0, 1, "head"), ("d", 1, 1, 2, 2, "1. a\nx"), ("d", 2, 3, 3, 1, "2. b")]
    states = segment.line_states(b.withColumnRenamed("o", "line").withColumnRenamed("t", "raw"), "d", [("question", r"^\d+\.")], "question", r"^(\d+)")
    assert [r["status"] for r in states.orderBy("line").collect()] == ["header", "live", "live", "live"]
    marks, ranges = spark.createDataFrame([("d", 1), ("d", 9), ("e", 1)], "d string, at int"), spark.createDataFrame([("d", 0, 3, "q1"), ("d", 9, 10, "q2"), ("d", 8, 10, "q3")], "d string, a int, z int, q string")
    assert [(r["d"], r["at"], r["assignment"]) for r in segment.owners(marks, ranges, "d", "at", "a", "z", "q").orderBy("d", "at").collect()] == [("d", 1, "assigned"), ("d", 9, "ambiguous"), ("e", 1, "unassigned")]


def test_tree_scope_and_problems(spark):
    nodes = spark.createDataFrame([("r", None, 1), ("a", "r", 1), ("a1", "a", 1), ("b", "r", 2), ("b1", "b", 1), ("c", "r", 3)], "n string, p string, s int")
    placed = tree.paths(nodes, "n", "p", "s")
    assert {r["n"] for r in tree.allowed_prefix(placed, "n", F.lit("b")).collect()} == {"r", "a", "a1", "b", "b1"}
    chain = spark.createDataFrame([(i, i - 1 if i else None, 1) for i in range(70)] + [(3, 69, 1)], "n int, p int, s int")
    deep = tree.paths(chain, "n", "p", "s")
    assert deep.agg(F.max("level"), F.count(F.lit(1))).first() == (69, 70)
    bad = spark.createDataFrame([("r", None, 1), ("x", "y", 1), ("y", "x", 1), ("s", "s", 2), ("o", "gone", 1), ("k", "r", 0), ("l", "r", 5), ("m", "r", 5)], "n string, p string, s int")
    got = set(rows(tree.forest_problems(bad, "n", "p", "s")))
    assert {("self_referencing_node", "s"), ("missing_parent", "o"), ("unordered_sequence", "k"), ("not_reached_from_a_root", "x"), ("not_reached_from_a_root", "y"), ("ambiguous_sibling_sequence", "l")} <= got


def test_integrity_and_transitions(spark):
    before, after = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string"), spark.createDataFrame([(1, "a"), (2, "c")], "k int, v string")
    assert rows(integrity.drift(before, after, ["k"], ["v"])) == [("deleted", "3"), ("updated", "2")]
    log = spark.createDataFrame([("r", i, s) for i, s in enumerate(["selecting", "selected", "selected", "passed", "failed"])], "k string, at int, s string")
    assert rows(integrity.illegal_transitions(log, "k", "at", "s", [("selecting", "selected")], ["failed"])) == [("r", 3, "selected", "passed")]
    assert rows(integrity.several_active(after.withColumn("one", F.lit(1)), "one", F.lit(True), "one_active")) == [("one_active", "1")]
    assert rows(integrity.failed_checks(before, {"is_b": F.col("v") == "b"}, ["k"])) == [("is_b", "1")]


def test_append_replace_and_checkpoints(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "x"), (3, "c"), (3, "c")], "k int, v string")
    assert rows(latest.append_new(old, new, ["k"])) == [(3, "c")]
    several = spark.createDataFrame([(3, "d"), (3, "c"), (4, None), (1, "z")], "k int, v string")
    assert sorted(map(tuple, latest.append_new(old, several, ["k"]).collect()), key=str) == [(3, "c"), (4, None)]
    assert sorted(map(tuple, latest.replace_rows(old, several, ["k"]).collect()), key=str) == [(1, "z"), (2, "b"), (3, "d"), (4, None)]
    assert rows(latest.collisions(old, new, ["k"], ["v"])) == [(2,)]
    assert rows(latest.replace_rows(old, new.distinct(), ["k"])) == [(1, "a"), (2, "x"), (3, "c")]
    assert rows(documents.todo(new.distinct(), old, ["k"])) == [(3, "c")]


def test_samples_are_stable_and_allocation_adds_up(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i % 4 else "a") for i in range(100)], "i int, s string")
    one, two = (rows(sampling.per_stratum(d, "s", "i", 3, "seed").select("i")) for d in (df, df.repartition(7)))
    assert one == two and len(one) == 9
    quota = sampling.allocation(df, "s", 17).collect()
    assert sum(r["quota"] for r in quota) == 17
    assert sampling.at_least_ratio(df, "s", "i", 1, "x").count() == 3
    assert {r["s"]: r["quota"] for r in sampling.allocation(df, "s", 5000).collect()} == {r["s"]: r["n"] for r in quota}
    filled = sampling.priority_strata(df, [("first", F.col("i") < 10), ("b", F.col("s") == "b")], "i", 4, "z", total=20)
    assert filled.count() == 20 and filled.select("i").distinct().count() == 20 and filled.where("stratum = 'fill'").count() == 12


def test_coverage_verdicts(spark):
    df = spark.createDataFrame([("pdf", "pass", "full", "A", "a"), ("pdf", "pass", "full", "a", "b"), ("ppt", "pass", "full", None, None), ("doc", None, None, None, None), ("doc", "odd", "partial", None, None), ("pdf", "pass", "much", None, None)], "file_type string, status string, coverage string, expected_hash string, observed_hash string")
    assert [r["verdict"] for r in reports.coverage_verdict(df).collect()] == ["pass", "fail", "unsupported", "fail", "fail", "fail"]


def test_values_beyond_sql():
    assert [udfs.numeral(x) for x in ("十二", "二十", "一百零五", "两千", "12", "x", "")] == [12, 20, 105, 2000, 12, None, None]
    assert udfs.nfkc_text("Ａ １½ ") == "A11⁄2"
    assert udfs.canonical('{"b": 1, "a": "é"}') == '{"a":"é","b":1}' and udfs.canonical("{") is None
    assert udfs.repair_json('```json\n{"a": "\\sqrt"}\n```') == '{"a":"\\\\sqrt"}'
    run = udfs.VALIDATORS.run
    assert run("arithmetic", "3×(2+4)=", "18")[0] == "pass" and run("arithmetic", "1/3+1/6=", "1/2")[0] == "pass" and run("arithmetic", "2+2=", "5")[0] == "fail"
    assert run("triangle", "3 4 8", "no")[0] == "pass" and run("isosceles_perimeter", "6, 10", "26或22")[0] == "pass" and run("isosceles_perimeter", "3, 7", "17")[0] == "pass"
    assert run("quadratic", "x^2-5x+6=0", "2, 3")[0] == "pass" and run("nothing", "", "") == ("unsupported", "unknown_validator")
    with pytest.raises(ValueError):
        udfs.VALIDATORS.register("triangle")


def test_docx_reading_and_intake(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(documents.as_docx(["1. one (5分)", "", "2. two"]))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x", "y")
    (tmp_path / "c.docx").write_bytes(out.getvalue())
    docs = documents.files(spark, str(tmp_path))
    got = {r["path"][-6:]: r["reasons"] for r in documents.intake(docs, f"file:{tmp_path}").collect()}
    assert got == {"a.docx": [], "b.docx": ["invalid_docx"], "c.docx": ["missing_docx_parts"]}
    assert [r["raw_text"] for r in documents.docx_blocks(docs).orderBy("ordinal").collect()] == ["1. one (5分)", "2. two"]
    assert documents.scores(["1. one (5分)", "2. （10 分）"]) == [5, 10]
    (tmp_path / "m.json").write_bytes(b"\xef\xbb\xbf{}")
    assert documents.json_manifest(spark, str(tmp_path / "m.json")).first()["body"] == "{}"
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert documents.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").count() == 2


def test_outcomes_fold(spark):
    cases = {"a": ["equal", "loss"], "b": ["nc", "nc"], "c": ["nc", "acc"], "d": ["nc", "equal"], "e": ["equal"], "f": ["acc", "equal"]}
    df = spark.createDataFrame([(k, o) for k, v in cases.items() for o in v], "k string, o string")
    assert rows(gates.fold_outcomes(df, "k", "o", "loss", "acc", "nc", "equal")) == [("a", "loss"), ("b", "nc"), ("c", "acc"), ("d", "nc"), ("e", "equal"), ("f", "acc")]
    log = spark.createDataFrame([("i", "x", "pass"), ("i", "x", "fail"), ("i", "y", "pass"), ("i", "z", "unsupported"), ("i", "z", "fail"), ("i", "w", "odd")], "i string, k string, s string")
    assert rows(gates.status_sets(log, "i", "k", "s", ["x", "y", "z", "w", "v"])) == [("i", "v", "missing", False), ("i", "w", "nonpass", False), ("i", "x", "fail", True), ("i", "y", "pass", False), ("i", "z", "unsupported", True)]


def test_similar_pairs_and_first_similar(spark):
    import random

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6))) for _ in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts += [t + " zz" for t in texts[:15]] + ["", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    every = df.alias("a").join(df.alias("b"), F.col("a.k") < F.col("b.k")).select(F.col("a.k"), F.col("b.k"), similarity.similarity(F.col("a.t"), F.col("b.t")).alias("s")).where("s >= 0.72")
    assert rows(similarity.similar_pairs(df, "k", "t", 0.72)) == rows(every) and every.count() >= 5


def test_item_texts(spark):
    one = lambda c, *v: spark.createDataFrame([v], ", ".join(f"c{i} string" for i in range(len(v)))).select(c(*(F.col(f"c{i}") for i in range(len(v))))).first()[0]
    split = lambda t: (lambda r: (r["stem"], r["options"]))(one(it.split_options, t))
    assert split(" stem\n\nA. one\tB、two\n C．three") == ("stem", ["A. one", "B. two", "C. three"])
    assert split("stem B. one C. two") == ("stem B. one C. two", []) and split("s A. one B. ") == ("s A. one B.", []) and split(None) == ("", []) and split("A. x A.y") == ("", ["A. x", "A. y"])
    assert [one(it.strip_option_prefix, x) for x in (" A. x", "B、y", "G. z", None)] == ["x", "y", "G. z", ""]
    assert [one(lambda c: it.question_type(c, F.array().cast("array<string>")), x) for x in ("a ____ b", "a")] == ["填空题", "待分类"]
    assert [one(it.prefilter_reason, x) for x in ("若，，则", "x：/", "∴ a", "ok")] == ["prefilter_missing_condition", "prefilter_stem_content_missing", "prefilter_solution_residual", None]
    assert [one(it.difficulty_or_basic, x) for x in ("高", "hard", "", None)] == ["高", "基础", "", None]
    assert one(it.image_refs, "a [图片1: x.png] [图片: y] [图片2:  x.png ] [图: z]") == ["x.png", "y"]
    assert one(it.numbered_blocks, "head\r\n1. a\n b\n\n 2. c\n3.d") == ["1. a\n b", "2. c", "3.d"] and one(it.numbered_blocks, " only 1. one ") == ["only 1. one"] and one(it.numbered_blocks, None) == []
    assert one(it.occurrences, "aaaa.b.aa", "aa") == [0, 2, 7] and one(it.occurrences, "a.b", ".") == [1] and one(it.occurrences, "abc", "x") == []
    assert one(it.occurrences, r"a\Eb\Ea\E", r"\E") == [1, 4, 7] and one(it.occurrences, "x[(é)]^$中 中", "[(é)]^$") == [1] and one(it.occurrences, "ab", "") == []
    assert one(it.occurrences, "ab " * 20_000, "b ") == list(range(1, 60_000, 3))
    assert one(it.label_anchors, "第1章 全等三角形") == ["全等三角形", "全等三角", "等三角形"]
    anchors = {(a["kind"], a["anchor"], a["start"], a["end"]) for a in one(it.scope_anchors, "已知 △ABC，求角")}
    assert anchors == {("condition", "已知", 0, 2), ("symbol", "△", 2, 3), ("condition", "求", 7, 8), ("term", "角", 8, 9)}
    label = lambda t: tuple(one(it.progress_label, t))
    assert label("第 二 章") == ("chapter", "二") and label("第12单元") == ("unit", "12") and label("第二章节") == (None, None)
    request = lambda t: tuple(one(it.progress_request, t))
    assert request("人教版八上，进度第 十二 章") == ("人教版八上", "chapter", "十二") and request("a，b，进度第一章") == (None,) * 3 == request("进度第一章")
    assert one(it.composite_id, "a", None, "b") == __import__("hashlib").sha256("a\0\0b".encode()).hexdigest() and one(it.hash_prefix, "ABCDEF0123456789") == "abcdef012345"


def test_snapshots_void_what_rests_on_them(spark):
    items = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, stem string, answer string")
    parts = spark.createDataFrame([(1, 2, "q"), (1, 1, "p")], "k int, pos int, h string")
    hashes = {r["k"]: r["input_hash"] for r in snapshots.input_hashes(items, "k", {"parts": (parts, ["pos"])}).collect()}
    import hashlib
    assert hashes[1] == hashlib.sha256(b'{"item":{"answer":null,"k":1,"stem":"a"},"parts":[{"h":"p","pos":1},{"h":"q","pos":2}],"schema":"input-v1"}').hexdigest()
    assert hashes[2] == hashlib.sha256(b'{"item":{"answer":"x","k":2,"stem":"b"},"parts":[],"schema":"input-v1"}').hexdigest()
    fresh = snapshots.input_hashes(items, "k", {"parts": (parts, ["pos"])})
    old = spark.createDataFrame([(1, hashes[1].upper(), False, 3), (2, "other", False, 1), (9, "h", False, 1)], "k int, input_hash string, invalidated boolean, revision int")
    assert rows(snapshots.stale(old, fresh, "k")) == [(2, "input_changed"), (9, "input_missing")]
    assert [(r["k"], r["revision"], r["invalidated"]) for r in snapshots.refreshed(old.where("k < 2"), fresh, "k").orderBy("k").collect()] == [(1, 3, False), (2, 1, False)]
    plans, docs = spark.createDataFrame([("p1", "1"), ("p2", "2")], "id string, item string"), spark.createDataFrame([("d1", "p1"), ("d2", "p2")], "id string, plan string")
    gone = snapshots.cascade(spark.createDataFrame([("1",)], "k string"), "k", [("plans", plans, "id", "item"), ("documents", docs, "id", "plan")])
    assert rows(gone) == [("documents", "d1"), ("plans", "p1")]
    quorum = spark.createDataFrame([(1, True), (2, False)], "k int, quorum boolean")
    assert rows(snapshots.approval_lock(items.withColumn("ok", F.lit(True)), "k", "ok", quorum)) == [(2,)]


def test_candidates(spark):
    df = spark.createDataFrame([("s", " ", "25"), ("", "a", "3")], "stem string, answer string, n string")
    assert [r[0] for r in df.select(candidates.review_reasons({"stem": F.col("stem"), "answer": F.col("answer")}, F.col("n"))).collect()] == [["missing answer", "outside first objective-question batch"], ["missing stem"]]
    rows_ = [("选择题", ["A. x", "B. y"], "B", True, True), ("选择题", ["A. x"], "A", True, False), ("选择题", ["A. x", "B. y"], "", False, False), ("填空题", [], "3", True, True), ("填空题", ["A. x"], "3", True, False), ("other", [], "1", True, False), ("选择题", None, "A", True, False)]
    got = spark.createDataFrame(rows_, "k string, o array<string>, a string, x boolean, y boolean").select(candidates.consistency(F.col("k"), F.col("o"), F.col("a")).alias("f"), "x", "y").collect()
    assert all([f["passed"] for f in r["f"]] == [r["x"], r["y"]] for r in got)
    grade = spark.createDataFrame([("初中", "七上"), ("小学", "六下"), ("初中", "七下")], "stage string, level string")
    pick = lambda g: [r["level"] for r in grade.where(candidates.grade_matches(g, {"初中全": "初中", "六升七": ["六下", "七上"]}, F.col("stage"), F.col("level"))).collect()]
    assert pick("初中全") == ["七上", "七下"] and pick("六升七") == ["七上", "六下"] and pick("七下") == ["七下"]
    q = spark.createDataFrame([("pass", "pass"), ("pass", None)], "a string, b string").select(candidates.quality_status(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in q] == ["passed", "blocked"]
    with pytest.raises(ValueError, match="items lacks x, y"):
        tables.require_columns(df, ["stem", "y", "x"], "items")
    assert df.select(tables.column_or_null(df, "nope").alias("c")).first()[0] is None


def test_reports_and_text_layers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "k int, v string")
    assert rows(reports.blockers([("some", df, "k > 1"), ("none", df, "k > 9")])) == [("some", 2)]
    pages = spark.createDataFrame([("d", 1, "x" * 60), ("d", 2, None), ("e", 1, "y" * 200), ("e", 4, "")], "d string, p int, t string")
    assert [(r["d"], r["kind"]) for r in documents.is_text_layer(pages, "d", "p", "t").orderBy("d").collect()] == [("d", "scanned"), ("e", "text")]
    items = spark.createDataFrame([("d", 2, "two", []), ("d", 1, "one", ["A. x", "B. y"])], "d string, o int, s string, c array<string>")
    assert documents.markdown(items, "d", "o", "s", "c").first()["markdown"] == "1. one\n   - A. x\n   - B. y\n\n2. two"
    kept = spark.createDataFrame([("a b", "x ab y"), ("q", "x"), (" ", "x")], "v string, p string")
    assert [r[0] for r in kept.select(tx.source_fields_kept(F.col("v"), F.col("p"))).collect()] == [True, False, None]
    documents.export_json({"t": df}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "t")).count() == 3
    first, again = (documents.write_manifest(d, str(tmp_path / "m")) for d in (df, df.orderBy(F.desc("k"))))
    assert first == again and first.startswith("3:") and documents.write_manifest(df.where("k < 3"), str(tmp_path / "m")) != first
    big = spark.range(100_050).withColumnRenamed("id", "k")
    assert documents.write_manifest(big, str(tmp_path / "b")).startswith("100050:")
    from attestra.streaming.ledger import windowed_counts

    at = spark.createDataFrame([("2024-01-01 00:00:10", "x"), ("2024-01-01 00:00:50", "x"), ("2024-01-01 00:01:05", "y")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert sorted((r["k"], r["n"]) for r in windowed_counts(at, "t", "1 minute", "k").collect()) == [("x", 2), ("y", 1)]
