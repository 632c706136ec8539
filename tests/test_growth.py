"""Steps whose work must not grow faster than their input: what they may compare, join or hold."""

import difflib
import random

import pandas as pd
from pyspark.sql import functions as F

from attestra.operators import intervals, progress, scope, similarity


def shuffled(spark, df):
    """The rows of df, and how many records its stages wrote into shuffles."""
    sc, jvm = spark.sparkContext, spark._jvm

    def stages():
        found = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    got = df.collect()
    return got, sum(n for k, n in stages().items() if k not in before)


def test_only_pairs_that_suffice_are_compared(spark):
    """A ratio in Python stays behind the joins that rule pairs out."""

    @F.pandas_udf("double")
    def ratio(a, b):
        for x, y in zip(a, b, strict=True):
            if difflib.SequenceMatcher(None, x, y).quick_ratio() < 0.9:
                raise ValueError(f"{x} was compared with {y}")
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    texts = [f"{a} {b} {n}" for a in ("large", "small", "old") for b in ("ring", "plate", "bolt") for n in (1, 2, 10, 20)]
    items = spark.createDataFrame([(k, "s", t) for k, t in enumerate(texts)], "k int, s string, t string")
    got = {r["k"]: r["similar_to"] for r in similarity.find_similar(items, "k", "t", "s", ratio).collect()}
    first = lambda k: next((j for j in range(k) if difflib.SequenceMatcher(None, texts[k], texts[j]).ratio() >= 0.9), None)
    assert got == {k: j for k in range(len(texts)) if (j := first(k)) is not None} and got


def test_texts_are_compared_with_earlier_ones_until_one_is_similar(spark, monkeypatch):
    """As brute force has it, over several blocks and rounds; a few records a text are shuffled, and later texts are never compared."""
    for name, value in {"TEXTS": 16, "CHARACTERS": 300, "LEADERS": 1, "PLACED": 100, "MET": 50}.items():
        monkeypatch.setattr(similarity, name, value, raising=False)
    rng = random.Random(3)
    names = [f"{a} {b}" for a in ("large", "small", "old", "blue", "hot") for b in ("ring", "plate", "bolt", "gear")]
    drawn = lambda: rng.choice(["".join(rng.choice("abcdefghij é一二😀") for _ in range(rng.randrange(25))), f"{rng.choice(names)} {rng.choice(['PROMO', 'LARGE'])} {rng.randrange(1, 51)}"])
    rows = [(k, "s" if k % 4 else f"t{k % 3}", drawn()) for k in range(700)] + [(700 + k, "s", "") for k in range(3)] + [(k, "u", "one and only") for k in (5, 800, 801)] + [(802, "v", "same key 1"), (802, "v", "same key 2"), (803, "v", "same key 3")]
    odd = [(900, None, "blue ring PROMO 1"), (901, "s", None), (None, "v", "same key 1"), (None, "w", "none")]
    first = {}
    for k, s, t in rows:
        first[t, s] = min(k, first.get((t, s), k))
    place = {}
    for (t, _), k in first.items():
        place.setdefault(t, []).append(k)

    @F.pandas_udf("double")
    def ratio(a, b):
        for x, y in zip(a, b, strict=True):
            if x != y and min(place[y]) > max(place[x]):
                raise ValueError(f"{x} was compared with {y}, which comes later")
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    want = {}
    for k, s, t in rows:
        for j, z, o in sorted(rows):
            if z == s and j < k and (r := 1.0 if t == o else difflib.SequenceMatcher(None, t, o).ratio()) >= 0.9:
                want[k] = (j, r)
                break
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows + odd, "k int, s string, t string")
    size, before = "spark.sql.autoBroadcastJoinThreshold", _written_records(spark)
    spark.conf.set(size, "-1")
    try:
        got = similarity.find_similar(frame, "k", "t", "s", ratio).collect()
    finally:
        spark.conf.unset(size)
    told = {r["k"]: (r["similar_to"], r["ratio"]) for r in got}
    assert {k: v for k, v in told.items() if k != 803} == {k: v for k, v in want.items() if k != 803} and told[803][0] == want[803][0] and len(got) == len(want) > 200
    records = _written_records(spark) - before
    assert records < 20 * len(rows), records
    assert not similarity.find_similar(frame.where("k < 0"), "k", "t", "s", ratio).collect()


def test_suggestions_do_not_list_questions_by_nodes(spark):
    """Questions of one text meet nodes of one name: as many rows as there are of both, not their product."""
    texts, names = ["一二三四五", "甲乙丙丁", "一二三四甲乙丙丁", "子丑寅卯"], ["一二三四", "甲乙丙丁", "二三四五", "一二三四五"]
    asked = [(q, texts[q % 4], "t", "k" if q % 8 < 6 else "m") for q in range(400)]
    nodes = [("k" if n % 3 else "m", n, names[n % 4], "t", "v") for n in range(400)]
    out = progress.suggest_mapping(spark.createDataFrame(asked, "question_id int, text string, textbook_id string, catalog string"), spark.createDataFrame(nodes, "catalog string, node_id int, name string, textbook_id string, catalog_version string"))
    got, records = shuffled(spark, out)
    want = {}
    for q, text, _, catalog in asked:
        anchors = lambda name: [name[i:j] for i in range(len(name)) for j in range(i + 4, len(name) + 1)]
        found = sorted((-min(1.0, max(map(len, hits)) / 5), n) for c, n, name, _, _ in nodes if c == catalog and (hits := [a for a in anchors(name) if a in text]))
        sure = found and (len(found) < 2 or found[1][0] - found[0][0] >= 0.15)
        want[q] = ("no_exact_catalog_anchor",) if not found else () if sure else ("ambiguous_top_candidate",), found[0][1] if sure else None
    assert {r["question_id"]: (tuple(r["reasons"]), r["node_id"]) for r in got} == want and records < 10_000


def test_overlaps_are_swept_chunk_by_chunk(spark):
    """Ranges over many chunks of positions: right results, and a few records a range, not one a bin."""
    rng = random.Random(4)
    size = lambda: rng.choice([-5, 0, 1, 60, 3 << 20, 50 << 20])
    some = lambda n, keys: [(i, rng.choice(keys), a, a + size()) for i in range(n) for a in [rng.choice([rng.randrange(200), rng.randrange(64 << 20), (5 << 20) - 1, -(3 << 20)])]]
    spans, others = some(300, ["a", "b", "c", None]) + [(900, "a", None, 5), (901, "a", 5, None)], some(40, ["a", "b", None]) + [(900, "a", None, 5)]
    frame = lambda rows: spark.createDataFrame(rows, "id int, k string, start long, end long")
    meets = lambda x, y: None not in (*x, *y) and x[1] == y[1] and x[2] <= x[3] and y[2] <= y[3] and x[2] < y[3] and y[2] < x[3]
    hit = {x[0] for x in spans if any(meets(x, y) for y in others)}
    got, records = shuffled(spark, intervals.not_overlapping(frame(spans), frame(others), ["k"]))
    assert sorted(r["id"] for r in got) == sorted(x[0] for x in spans if x[0] not in hit) and len(hit) > 50
    assert records < 5 * (len(spans) + len(others))
    told = {tuple(r) for r in intervals.overlapping(frame(spans), frame(others), ["k"]).collect()}
    assert told == {x[1:] for x in spans if x[0] in hit}


def test_shared_inputs_are_worked_out_once(spark):
    """What several inputs are built from is not read and grouped again for each."""
    from attestra.plans import content, evidence  # noqa: F401

    sf = "/root/testdata/sf0.001"
    for names in (("content_parts", "content_revs", "answers"), ("paper",), ("choices", "assets")):
        for df in evidence.made(spark, sf, *names):
            assert not any(f.endswith("lineitem.parquet") for f in df.inputFiles())


def test_points_of_nodes_that_nobody_wants_are_not_shuffled(spark):
    points = [(q, p) for q in range(40) for p in range(q % 7, 60, 2)]
    places = [(p, n) for p in range(60) for n in range(p % 3, 40, 3)]
    approved = [(p, "approved" if p % 5 else "pending") for p in range(60)]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    wanted = [(q, q % 40 + d) for q in range(40) for d in (0, 1)]
    out = scope.approved_points(frame(points, "id int, knowledge_point_id int"), frame(places, "knowledge_point_id int, curriculum_node_id int"), frame(approved, "id int, review_status string"), frame(wanted, "id int, curriculum_node_id int"), ["id"])
    got, records = shuffled(spark, out)
    want = {(q, n): [p for i, p in points if i == q and (p, n) in set(places) and p % 5] for q, n in wanted}
    assert {(r["id"], r["curriculum_node_id"]): r["knowledge_points"] for r in got} == {k: v for k, v in want.items() if v}
    assert records < 3 * (len(points) + len(places) + len(wanted))


def test_batches_of_long_texts_are_bounded(spark):
    from attestra.plans import catalogue

    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(size)
    assert catalogue.nfkc_normalise(spark, "/root/testdata/sf0.001").count() and 0 < int(spark.conf.get(size)) <= 16 << 20


def test_blocks_of_papers_and_notes_are_shuffled_once(spark):
    from attestra.operators import questions

    paper = ["一、选择题", "1. 甲 A. 乙 B. 丙", "\x01 A. 图 \x01", "2. 丁", "【答案与解析】", "1. 【答案】 A", "2. 【答案】 B 【解析】 戊"]
    notes = ["【学习目标】", "甲", "【典型例题】", "类型一、乙", "1. 丙", "【思路点拨】丁"]
    for segment, texts, want in ((questions.segment_questions, paper, 2), (questions.segment_notes, notes, 2)):
        rows = [(d, i, t) for d in range(100) for i, t in enumerate(texts)]
        got, records = shuffled(spark, segment(spark.createDataFrame(rows, "d int, ordinal int, raw_text string").repartition(3), "d"))
        assert len(got) == want * 100 and records <= 2 * len(rows)  # one of the two is repartition's


def test_pairs_among_ranges_are_those_of_brute_force_and_few_ranges_are_shuffled(spark):
    rng = random.Random(9)
    size = lambda: rng.choice([-5, 0, 0, 1, 60, 900, 3 << 20])
    rows = [(i, rng.choice(["a", "b", None]), a, a + size()) for i in range(300) for a in [rng.choice([rng.randrange(200), rng.randrange(64 << 20), (1 << 20) - 1, 5 << 20])]] + [(900, "a", None, 5), (901, "a", 5, None), (299, "a", 7, 9)]
    frame = lambda rows: spark.createDataFrame(rows, "id int, k string, start long, end long")
    held = [r for r in rows if None not in r and r[2] <= r[3]]
    want = sorted((x[0], y[0]) for x in held for y in held if x[1] == y[1] and x[0] != y[0] and (x[2], x[0]) < (y[2], y[0]) and x[2] < y[3] and y[2] < x[3])
    got = intervals.overlaps_among(frame(rows), ["k"], "id").collect()
    assert sorted((r["id"], r["other_id"]) for r in got) == want and len(want) > 500
    apart = [(i, "a", 100 * i, 100 * i + 40) for i in range(1000)] + [(5000, "a", 30, 35)]
    got, records = shuffled(spark, intervals.overlaps_among(frame(apart), ["k"], "id").select("id", "other_id"))
    assert [tuple(r) for r in got] == [(0, 5000)] and records < 2 * len(apart)


def test_role_evidence_meets_each_side_once(spark):
    from attestra.operators import evidence

    n = 400
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    roles = frame([(i, 1, i % 20, "s" if i % 3 else "t", 7, i % 4, i % 30, f"d{i % 30}", i % 30, "h", "A") for i in range(n)], "id int, import_run_id int, question_id int, input_hash string, textbook_id int, curriculum_node_id int, source_document_id int, source_document_hash string, source_fragment_id int, source_hash string, role_marker string")
    asked = frame([(q, "approved" if q % 5 else "blocked", "approved") for q in range(20)], "id int, quality_status string, review_status string")
    inputs = frame([(q, "s", None if q % 7 else "now") for q in range(20)], "question_id int, input_hash string, invalidated_at string")
    fits = frame([(q, 7, n_, "approved" if q % 3 else "pending") for q in range(20) for n_ in range(3)], "question_id int, textbook_id int, curriculum_node_id int, fit_status string")
    files = frame([(d, f"d{d if d % 6 else 0}", "parsed" if d % 11 else "failed") for d in range(30)], "id int, file_hash string, parse_status string")
    fragments = frame([(d, d, "h", "xAx" if d % 4 else "x") for d in range(30)], "id int, source_document_id int, raw_hash string, raw_text string")
    size = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(size, "-1")
    try:
        got, records = shuffled(spark, evidence.role_evidence(roles, frame([(1, "validated_evidence")], "id int, status string"), asked, inputs, fits, files, fragments).select("id"))
    finally:
        spark.conf.unset(size)
    want = [i for i in range(n) if i % 3 and i % 20 % 5 and i % 20 % 7 and i % 20 % 3 and i % 4 < 3 and i % 30 % 6 and i % 30 % 11 and i % 30 % 4]
    assert sorted(r["id"] for r in got) == want and want
    assert records < 3.5 * n  # runs and documents meet all of it, questions and mappings what is left


def test_ledgers_are_stored_before_their_steps(spark):
    from attestra.plans import stores

    _, changed = stores._ledger_changes(spark, "/root/testdata/sf0.001")
    assert not any(f.endswith("lineitem.parquet") for f in changed.inputFiles())


def test_places_are_swept_into_ranges(spark):
    """As brute force has it, whether ranges overlap, are long, empty or reach over chunks; places and ranges apart are shuffled once."""
    rng = random.Random(7)
    size = lambda: rng.choice([-5, 0, 1, 60, 60, 900, 1 << 20, 3 << 20])
    ranges = [(i, rng.choice(["a", "b", None]), a, a + size()) for i in range(200) for a in [rng.choice([rng.randrange(2000), rng.randrange(8 << 20), (1 << 20) - 1, -(1 << 20)])]] + [(900, "a", None, 5), (901, "a", 5, None)]
    places = [(i, rng.choice(["a", "b", None]), rng.choice([rng.randrange(2000), rng.randrange(8 << 20), 1 << 20, 0, None])) for i in range(200)] + [(500 + i, "a", z + d) for i, (_, _, _, z) in enumerate(ranges) if z is not None for d in (-1, 0)]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    swept = lambda p, r: intervals.places_swept(frame(p, "place int, k string, at long"), frame(r, "id int, k string, a long, z long"), ["k"], "at", "a", "z")
    want = sorted((p[0], p[2], r[0]) for p in places for r in ranges if None not in (*p, *r) and p[1] == r[1] and r[2] <= p[2] < r[3])
    assert sorted((x["place"], x["at"], x["id"]) for x in swept(places, ranges).collect()) == want and len(want) > 1000
    before = [(i, "a", 100 * i + 7) for i in range(1000)]
    got, records = shuffled(spark, swept(before, [(i, "a", 100 * i, 100 * i + 40) for i in range(1000)]))
    assert sorted((x["place"], x["id"]) for x in got) == [(i, i) for i in range(1000)] and records == 0  # written already, no bins


def test_options_meet_assets_with_few_records(spark):
    """Options and blocks are shuffled a few times in all, and nothing is listed by bins; options outside of their block are bound too."""
    from attestra.operators import bindings

    n = 300
    options = [(q % 7, q, i, "ABCD"[i], f"b{q}", 30 * i + (500 if q % 10 == 9 else 0), 30 * i + 20 + (500 if q % 10 == 9 else 0), q % 10 != 8 or i > 0) for q in range(n) for i in range(4)]
    blocks = [(q % 7, f"b{q}", 1000 * q, 1000 * q + 120) for q in range(n)]
    assets = [(d, f"{q}-{i}", i, 1000 * q + s + (500 if q % 10 == 9 else 0), 1000 * q + s + 5 + (500 if q % 10 == 9 else 0)) for d, q, i, *_ in options for s in [30 * i + (7 if q % 3 else 18)]]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    size, before = "spark.sql.autoBroadcastJoinThreshold", _written_records(spark)
    spark.conf.set(size, "-1")
    try:
        out = bindings.bind_assets(frame(options, "document int, question int, position int, label string, block string, start int, end int, asset_only boolean"), frame(blocks, "document int, block string, range_start long, range_end long"), frame(assets, "document int, asset string, ordinal int, range_start long, range_end long"))
        got = {(r["question"], r["position"]): (r["asset"], r["mode"], r["reason"]) for r in out.collect()}
    finally:
        spark.conf.unset(size)
    records = _written_records(spark) - before

    def bound(q, i):
        if q % 10 == 8:
            return None, None, bindings.AMBIGUOUS
        if q % 3:
            return f"{q}-{i}", bindings.EXACT, None
        return (None, None, bindings.BAD_COUNT) if q % 10 == 9 else (f"{q}-{i}", bindings.ORDER, None)

    assert got == {(q, i): bound(q, i) for q in range(n) for i in range(4)}
    assert records < 4 * len(options)


def _written_records(spark):
    sc, jvm = spark.sparkContext, spark._jvm
    found = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))


def _most_read(spark, df):
    """The rows of df, and the most shuffled records that one of its tasks read."""
    sc, jvm = spark.sparkContext, spark._jvm
    store = sc._jsc.sc().statusStore()

    def stages():
        found = store.stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(i).stageId() for i in range(found.size())}

    size, before = "spark.sql.autoBroadcastJoinThreshold", stages()
    spark.conf.set(size, "-1")
    try:
        got = df().collect()
    finally:
        spark.conf.unset(size)
    tasks = [store.taskList(s, 0, 10_000) for s in stages() - before]
    metrics = [t.apply(i).taskMetrics() for t in tasks for i in range(t.size())]
    return got, max(m.get().shuffleReadMetrics().recordsRead() for m in metrics if m.isDefined())


def test_completeness_is_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    from attestra.operators import selection, tables

    monkeypatch.setattr(tables, "ROWS", 200)
    n = 2000
    frame = lambda rows: spark.createDataFrame(rows, "doc int, item int")
    bound = [(d, i) for d in range(n) for i in (1, 2) if d % 5] + [(7, None), (7, None), (None, 1), (n + 5, 1), (8, 1)]
    used = [(d, i) for d in range(n) for i in (1, 2, 2, 3)[d % 3 :] if d % 7] + [(9, None), (9, None), (None, 1), (n + 6, 1)]
    docs = frame([(d, 0) for d in range(n)] + [(3, 0), (None, 0)]).select("doc")

    def want(d):
        b, u = {i for x, i in bound if x == d}, [i for x, i in used if x == d]
        if d is None:
            return 0, 0, 0, True
        missing, extra = sum(i is None or i not in u for i in b), sum(i is None or i not in b for i in set(u))
        several = sum(u.count(i) > 1 for i in set(u))
        return missing, extra, several, missing + extra + several == 0

    got, most = _most_read(spark, lambda: selection.usage_completeness(docs, frame(bound), frame(used), "doc", "item"))
    assert {r["doc"]: tuple(r)[1:] for r in got} == {d: want(d) for d in [*range(n), None]} and len(got) == n + 1
    assert most < 3 * 200


def test_violations_are_found_in_tasks_of_bounded_size(spark, monkeypatch):
    from attestra.operators import integrity, tables

    monkeypatch.setattr(tables, "ROWS", 200)
    rows = [(i, i % 3, i * 2 % 4001) for i in range(4000)] + [(5, 2, None), (None, 1, 3), (None, 1, 4)]
    df, parents = spark.createDataFrame(rows, "a int, b int, p int"), spark.createDataFrame([(i,) for i in range(0, 4001, 3)] + [(0,), (None,)], "q int")
    told, most = lambda got: sorted(r["key"] for r in got), []
    for f, want in (
        (lambda: integrity.duplicate_keys(df, ["a", "b"], "r"), ["1", "5|2"]),
        (lambda: integrity.orphans(df, "p", parents, "q", ["a", "b"], "r"), sorted("|".join(str(x) for x in r[:2] if x is not None) for r in rows if r[2] is not None and r[2] % 3)),
        (lambda: integrity.several_active(df, "a", F.col("b") < 2, "r"), [""]),
    ):
        got, n = _most_read(spark, f)
        assert told(got) == want
        most.append(n)
    assert max(most) < 5 * 200  # a join's task reads from both sides


def test_rules_are_judged_text_by_text(spark):
    """A row a text is shuffled, not one a pattern or rule; ids that repeat are judged together."""
    from attestra.operators import patterns
    from attestra.plans import content

    rng = random.Random(5)
    words = [f"w{k}x" for k in range(30)]
    texts = [(rng.choice([None, *range(150)]), rng.choice([None, " ".join(rng.sample(words, rng.randrange(20)))])) for _ in range(400)]
    rules = [(rng.choice(["r1", "r2", "r3", "r4"]), rng.choice([0, 1, 2]), rng.randrange(32)) for _ in range(40)] + [("n", None, 1), ("n", 0, 2), (None, 0, 1), ("lost", 0, 3), ("lost", 1, 99)]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    made = lambda rows, held: patterns.rules_of_texts(frame(texts, "i int, t string"), frame([*enumerate(words), (30, ""), (31, None)], "pattern_id long, pattern string"), frame(rows, "rule string, group int, pattern_id long"), "i", "t", held)
    want = set()
    for i in {i for i, _ in texts}:
        held = {k for j, t in texts if j == i and t for k, w in enumerate(words) if w in t}
        for rule in {r for r, *_ in rules if r}:
            found = {g for r, g, k in rules if r == rule and k in held}
            if found and len(found) == len({g for r, g, _ in rules if r == rule and g is not None}):
                want.add((i, rule))
    for held in (1 << 24, 0):
        got = [tuple(r) for r in made(rules, held).collect()]
        assert set(got) == want and len(got) == len(want) > 50
    assert not made([], 1 << 24).collect()
    got, records = shuffled(spark, content.signal_rules(spark, "/root/testdata/sf0.001"))
    assert records <= spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count() < len(got)
