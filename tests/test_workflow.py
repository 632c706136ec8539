"""Invalidation to a fixed point, delivery as transitions, and scope rules, on small fixtures."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from attestra.operators import closure, delivery, scope, snapshots
from attestra.sources import dump


def test_what_is_reached_carries_its_first_cause(spark, monkeypatch):
    monkeypatch.setattr(closure, "TOGETHER", 3)
    rng = random.Random(3)
    nodes = [(k, i) for k in "ab" for i in range(40)]
    edges = [(*rng.choice(nodes), *rng.choice(nodes)) for _ in range(110)] + [("a", 0, "a", 0), ("a", None, "b", 1)] + [("c", i, "c", i + 1) for i in range(55)]
    roots = [("a", 3, "x"), ("b", 7, "y"), ("b", 7, "w"), ("c", 0, "z"), ("d", 1, "alone"), ("a", None, "none")]
    want, front = {}, {}
    for k, i, cause in roots:
        if i is not None:
            front[k, i] = min(cause, front.get((k, i), cause))
    depth = 0
    while front:
        want |= {n: (c, depth) for n, c in front.items()}
        step = {}
        for k, i, tk, ti in edges:
            if (k, i) in front and (tk, ti) not in want:
                step[tk, ti] = min(front[k, i], step.get((tk, ti), front[k, i]))
        front, depth = step, depth + 1
    e, r = spark.createDataFrame(edges, "kind string, id int, to_kind string, to_id int"), spark.createDataFrame(roots, "kind string, id int, cause string")
    for few in (closure.FEW, 0):
        monkeypatch.setattr(closure, "FEW", few)
        got = closure.reached(r, e).collect()
        assert {(x["kind"], x["id"]): (x["cause"], x["depth"]) for x in got} == want and len(got) == len(want)
    assert max(d for _, d in want.values()) == 55
    assert closure.reached(r.where("false"), e).count() == 0


def test_a_cascade_takes_dependants_in_any_order(spark):
    df = lambda rows: spark.createDataFrame(rows, "id string, on string")
    a, b, c = df([("a1", "q1"), ("a2", "q2")]), df([("b1", "a1"), ("b2", "c9")]), df([("c1", "b1"), ("c9", "c1"), ("c3", "a2")])
    voided = spark.createDataFrame([("q1",)], "q string")
    for order in ([("a", a), ("b", b), ("c", c)], [("c", c), ("b", b), ("a", a)]):
        got = snapshots.cascade(voided, "q", [(n, t, "id", "on") for n, t in order]).collect()
        assert sorted(map(tuple, got)) == [("a", "a1"), ("b", "b1"), ("b", "b2"), ("c", "c1"), ("c", "c9")]


_EVENT = "document string, seq int, token string, kind string, expected int, shortage int, progress boolean, content string, evidence string, gates boolean, complete boolean"


def event(document, seq, kind, token=None, expected=None, shortage=0, progress=True, content=" h ", evidence="h", gates=True, complete=True):
    return (document, seq, token or f"{document}{seq}", kind, expected, shortage, progress, content, evidence, gates, complete)


def test_deliveries_are_transitions(spark):
    path = lambda d, n=5: [event(d, i, k) for i, k in enumerate(delivery.KINDS[:n])]
    rows = path("ok") + [event("ok", 9, "bind"), event("ok", 10, "deliver", token="ok4")]
    rows += path("stale", 2) + [event("stale", 2, "bind", expected=2), event("stale", 3, "bind", expected=2, content="late"), event("stale", 4, "report", expected=3)]
    rows += path("open", 4) + [event("open", 4, "deliver", complete=False), event("open", 5, "deliver", progress=False), event("open", 6, "deliver")]
    rows += path("other", 3) + [event("other", 3, "report", evidence="x"), event("other", 4, "report", gates=False), event("other", 5, "deliver"), event("other", 6, "bind", content=" "), event("other", 7, "bind", content="n"), event("other", 8, "report", evidence="n")]
    rows += [event("short", 0, "plan", shortage=3), event("short", 1, "generate"), event("short", 2, "plan"), event("short", 3, "generate", progress=False), event("short", 4, "sell"), event("short", 5, None)]
    rows += [event(None, 0, "plan"), event(None, 1, "plan")]
    folded = delivery.fold(spark.createDataFrame(rows, _EVENT).repartition(3)).cache()
    by = {}
    for r in folded.orderBy("document", "seq").collect():
        by.setdefault(r["document"], []).append((r["outcome"], r["reason"], r["status"], r["version"]))
    done = [("applied", None, s, i + 1) for i, s in enumerate(("selected", "draft", "pending_review", "passed", "delivered"))]
    assert by["ok"] == [*done, ("conflict", "wrong_state", "delivered", 5), ("repeated", None, "delivered", 5)]
    assert by["stale"][2:] == [("applied", None, "pending_review", 3), ("conflict", "stale_version", "pending_review", 3), ("applied", None, "passed", 4)]
    assert by["open"][4:] == [("conflict", "usage_incomplete", "passed", 4), ("conflict", "progress_changed", "passed", 4), ("applied", None, "delivered", 5)]
    assert [x[1] for x in by["other"][3:]] == ["evidence_mismatch", None, "wrong_state", "content_hash_missing", None, None] and by["other"][-1][2] == "passed"
    assert [x[1] for x in by["short"]] == [None, "wrong_state", None, "progress_changed", "unknown_kind", "unknown_kind"]
    assert by[None] == [("conflict", "document_missing", "none", 0)] * 2
    now = {r["document"]: (r["status"], r["version"], r["content"]) for r in delivery.states(folded).collect()}
    assert now["ok"] == ("delivered", 5, "h") and now["stale"] == ("passed", 4, "h") and now["other"] == ("passed", 6, "n") and now["short"][0] == "selected"
    bound = spark.createDataFrame([("ok", "q1"), ("ok", "q2"), ("ok", "q2"), ("open", "q1"), ("stale", "q9")], "document string, item string")
    assert sorted((r["document"], r["item"], r["seq"]) for r in delivery.usage_rows(folded, bound).collect()) == [("ok", "q1", 4), ("ok", "q2", 4), ("open", "q1", 6)]


def test_scope_without_audits_or_optional_columns(spark):
    df = spark.createDataFrame
    tables = [
        df([("q", "m"), ("r", "m")], "id string, stage string"),
        df([("q", 1, 10, "approved"), ("q", 2, 20, "rejected"), ("r", 1, 10, "approved")], "question_id string, textbook_id int, curriculum_node_id int, fit_status string"),
        df([(1, "v1"), (2, "v1")], "id int, catalog_version string"),
        df([(10, 1, "m", "v1", "active"), (20, 2, "m", "v1", "active")], "id int, textbook_id int, stage string, catalog_version string, status string"),
        df([(5, 1, "v1", "approved", "ref", "hash")], "id int, textbook_id int, catalog_version string, status string, source_reference string, source_hash string"),
        df([(5, 50)], "catalog_release_id int, import_run_id int"),
        df([(50, "approved"), (60, "approved")], "id int, status string"),
        None,
        df([("q", 1, 10, 60, "h"), ("r", 1, 10, 60, "h")], "question_id string, textbook_id int, curriculum_node_id int, import_run_id int, mapping_hash string"),
        df([("q", 7, 60, "h"), ("q", 8, 60, "h"), ("r", 9, 60, "h")], "question_id string, knowledge_point_id int, import_run_id int, mapping_hash string"),
        df([(7, 10), (8, 10), (9, 10)], "knowledge_point_id int, curriculum_node_id int"),
        df([(7, "approved"), (8, "approved"), (9, "pending")], "id int, review_status string"),
    ]
    judged = scope.mapping_scope(*tables).collect()
    assert {(r["question_id"], r["textbook_id"]): (r["status"], r["rank"], r["knowledge_points"]) for r in judged} == {("q", 1): ("pass", 14, [7, 8]), ("q", 2): ("fail", 1, None), ("r", 1): ("unsupported", 13, None)}
    tables[7] = df([(5, 50, "approved")], "catalog_release_id int, import_run_id int, status string")
    assert {r["rank"] for r in scope.mapping_scope(*tables).where("textbook_id = 1").collect()} == {9}  # an audited import has to be validated
    told = scope.question_scope(df([("q", "m"), ("r", "m"), ("s", "m")], "id string, stage string"), scope.mapping_scope(*tables))
    assert {r["id"]: r["status"] for r in told.collect()} == {"q": "fail", "r": "unsupported", "s": "unsupported"}


@pytest.mark.parametrize("kind", delivery.KINDS)
def test_steps_never_skip_a_state(kind):
    order = ("none", "selected", "draft", "pending_review", "passed", "delivered")
    for at, status in enumerate(order):
        after, reason = delivery.step(delivery.State(status, 3, "h"), kind, 0, True, "h", "h", True, True)
        assert (after is None) == (reason is not None)
        assert after is None or (after.version == 4 and order.index(after.status) <= at + 1)


def test_snapshots_are_canonical_and_refresh_what_was_touched(spark):
    odd = 'q"\\u001F \x1f\x0b\x1a\\\\\x0f é中\t/\n'
    items = [("a", odd, 3), ("b", None, None), ("c", "", 1)]
    parts = [("a", 2, "x\x0e"), ("a", 1, None), ("c", 5, odd)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    one = lambda rows: {"parts": (df(rows, "id string, k int, v string"), ["k"]), "none": (df([], "id string, z int"), ["z"])}
    schema = "id string, stem string, n int"
    got = {r["id"]: r for r in snapshots.snapshot(df(items, schema), "id", "question", one(parts), "v1").collect()}

    def plain(items, parts):
        out = {}
        for i, stem, n in items:
            own = [{"k": k, "v": v} for j, k, v in sorted(parts, key=lambda x: x[1]) if j == i]
            out[i] = hashlib.sha256(json.dumps({"question": {"id": i, "stem": stem, "n": n}, "parts": own, "none": [], "snapshot_schema": "v1"}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        return out

    assert {i: r["input_hash"] for i, r in got.items()} == plain(items, parts)
    old = df([(i, r["input_hash"], r["set_hashes"], 4) for i, r in got.items()], "id string, input_hash string, set_hashes map<string,string>, revision int")
    items2, parts2 = [("a", odd, 3), ("c", "new", 1), ("d", "d", 0)], [*parts[:2], ("c", 6, odd), ("d", 1, "v")]
    touched = df([("a",), ("b",), ("d",)], "id string")
    now = {r["id"]: r for r in snapshots.refreshed_snapshot(old, touched, df(items2, schema), "id", "question", one(parts2), "v1").collect()}
    want = plain(items2, parts2)
    assert sorted(now) == ["a", "c", "d"] and (now["a"]["revision"], now["a"]["changed"]) == (4, []) and (now["d"]["revision"], now["d"]["changed"]) == (1, ["none", "parts", "question"])
    assert now["c"]["input_hash"] == got["c"]["input_hash"] and now["c"]["changed"] is None and now["d"]["input_hash"] == want["d"]
    again = {r["id"]: r for r in snapshots.refreshed_snapshot(old, df([("c",)], "id string"), df(items2, schema), "id", "question", one(parts2), "v1").collect()}
    assert (again["c"]["input_hash"], again["c"]["revision"], again["c"]["changed"]) == (want["c"], 5, ["parts", "question"])


def test_files_count_if_their_bytes_are_the_declared_ones(spark, tmp_path):
    for name, body in {"a": b"x", "b": b"y", "e": b"z"}.items():
        (tmp_path / name).write_bytes(body)
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*").select(F.element_at(F.split("path", "/"), -1).alias("path"), "content")
    sha = lambda b: hashlib.sha256(b).hexdigest().upper()
    ok = '{"hashes_match": true}'
    rows = [("a", sha(b"x"), 1, ok), ("b", sha(b"x"), 1, ok), ("c", sha(b"x"), 1, ok), ("d", "", 0, ok), ("e", sha(b"z"), 1, "{}"), ("f", "", None, None)]
    got = snapshots.file_reasons(spark.createDataFrame(rows, "relative_path string, file_hash string, trusted_source int, intake_manifest_json string"), files).collect()
    assert {r["relative_path"]: r["reason"] for r in got} == {"a": None, "b": "question_source_hash_mismatch", "c": "question_source_missing", "d": "question_source_not_trusted", "e": "question_source_intake_hashes_not_matched", "f": "question_source_not_trusted"}


def test_dumps_are_loaded_parents_first(spark, tmp_path):
    tables = {"tags": dump.Table("id int, name string, parent_id int", "id", "first"), "questions": dump.Table("id string, tag int, used int", "id"), "images": dump.Table("id string, question string", "id")}
    references = [dump.Reference("images", "question", "questions"), dump.Reference("questions", "tag", "tags"), dump.Reference("tags", "parent_id", "tags")]
    assert dump.order_of(list(tables), references) == (["tags", "questions", "images"], [])
    assert dump.order_of(["a", "b", "c", "d"], [dump.Reference("a", "x", "b"), dump.Reference("b", "x", "a"), dump.Reference("c", "x", "a")]) == (["d"], ["a", "b", "c"])
    one = {"tags": [{"id": 1, "name": "x"}, {"id": 1, "name": "again"}, {"id": 2, "parent_id": 1}, {"id": 3, "parent_id": 4}, {"id": 4, "parent_id": 3}, {"id": 5, "parent_id": 9}, {"id": 6, "parent_id": 5}, {"name": "no key"}], "questions": [{"id": "q", "tag": 1, "used": 1}, {"id": "q", "tag": 2, "used": 2, "more": True}, {"id": "r", "tag": 77}], "other": [1]}
    (tmp_path / "dump.json").write_text(json.dumps(one, indent=1))
    loaded = dump.read_dump(spark, str(tmp_path / "dump.json"), tables, one_document=True)
    assert {r["id"]: r["name"] for r in loaded["tags"].collect()} == {1: "x", 2: None, 3: None, 4: None, 5: None, 6: None}
    assert sorted(map(tuple, loaded["questions"].collect())) == [("q", 2, 2), ("r", 77, None)] and loaded["images"].count() == 0
    got = sorted(tuple(r) for r in dump.problems(loaded, tables, references).collect())
    assert got == [("questions", "r", "tag", "77", "orphan"), ("tags", "3", "parent_id", "4", "row_cycle"), ("tags", "4", "parent_id", "3", "row_cycle"), ("tags", "5", "parent_id", "9", "orphan")]
