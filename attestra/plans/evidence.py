"""Queries over current evidence. The evidence tables are built from the driver's by SQL that both engines run (`INPUTS`); the twins then say
in their own words which rows still stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import progress, sampling
from ..operators.tables import written
from .catalogue import query, table

_TABLES = ("nation", "customer", "part", "orders", "lineitem")

#: A line's order and number are its id here, so rows that repeat one are one line.
_LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag, min(l_discount) AS l_discount FROM {lineitem} GROUP BY l_orderkey, l_linenumber) AS l"

INPUTS = {
    "runs": "SELECT n_nationkey AS id, 'question_mapping' AS import_kind, CASE WHEN n_regionkey = 0 THEN 'rejected' ELSE 'validated' END AS status, n_name AS source_reference, CASE WHEN n_nationkey % 7 = 0 THEN 'x' ELSE md5(n_name) END AS source_hash FROM {nation}",
    "revisions": "SELECT o_orderkey AS id, o_custkey AS question_id, o_custkey % 3 AS textbook_id, o_custkey % 5 AS curriculum_node_id, o_orderkey % 25 AS import_run_id, n_name AS source_reference, md5(n_name) AS source_hash, '[' || repeat('1,', CAST(n - 1 + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS INT)) || '1]' AS knowledge_points_json FROM {orders} JOIN {nation} ON n_nationkey = o_orderkey % 25 JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) AS l ON l_orderkey = o_orderkey",
    "heads": "SELECT max(o_orderkey) AS current_revision_id, o_custkey AS question_id, o_custkey % 3 AS textbook_id, o_custkey % 5 AS curriculum_node_id, count(*) AS head_revision FROM {orders} GROUP BY o_custkey, o_orderkey % 2",
    "points": "SELECT l_orderkey AS source_revision_id, l_partkey AS knowledge_point_id FROM {lineitem}",
    "known": "SELECT p_partkey AS id, CASE WHEN p_size > 3 THEN 'approved' ELSE 'pending' END AS review_status FROM {part}",
    "placed": "SELECT p_partkey AS knowledge_point_id, k AS curriculum_node_id FROM {part} CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS v(k) WHERE (p_partkey + k) % 17 <> 0",
    "snapshots": "SELECT c_custkey AS question_id, c_custkey % 2 AS revision, md5(CAST(c_custkey AS STRING)) AS input_hash, CASE WHEN c_acctbal < 0 THEN 'now' END AS invalidated_at FROM {customer}",
    "questions": "SELECT c_custkey AS id, c_custkey + 7 AS source_document_id FROM {customer}",
    "sources": "SELECT c_custkey + 7 AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END AS trusted_source FROM {customer}",
    "textbooks": "SELECT n_nationkey AS id, 'v1' AS catalog_version FROM {nation}",
    "nodes": "SELECT n_nationkey * 10 + k AS id, n_nationkey AS textbook_id, CASE WHEN k = 3 THEN 'v0' ELSE 'v1' END AS catalog_version, CASE WHEN k = 2 AND n_nationkey % 2 = 0 THEN 'retired' ELSE 'active' END AS status FROM {nation} CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(k)",
    "releases": "SELECT n_nationkey AS id, n_nationkey AS textbook_id, 'v1' AS catalog_version, CASE WHEN n_regionkey = 1 THEN 'draft' ELSE 'approved' END AS status, n_name AS source_reference, md5(n_name) AS source_hash FROM {nation}",
    "release_audits": "SELECT n_nationkey AS catalog_release_id, n_nationkey AS import_run_id, 'approved' AS status, n_name AS source_reference, md5(n_name) AS source_hash FROM {nation}",
    "catalog_runs": "SELECT n_nationkey AS id, 'catalog' AS import_kind, CASE WHEN n_nationkey % 6 = 5 THEN 'failed' ELSE 'validated' END AS status, n_name AS source_reference, md5(n_name) AS source_hash FROM {nation}",
    "mapped": "SELECT c_custkey * 10 AS id, c_custkey AS question_id, c_nationkey AS textbook_id, c_nationkey * 10 + c_custkey % 4 AS curriculum_node_id FROM {customer}",
    "approvals": "SELECT o_orderkey AS id, o_custkey AS question_id, c_nationkey AS textbook_id, c_nationkey * 10 + c_custkey % 4 AS curriculum_node_id, o_custkey * 10 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS source_revision_id, md5(CAST(o_custkey AS STRING)) AS approval_input_hash, o_orderkey % 2 AS approval_snapshot_revision, CASE WHEN o_orderstatus = 'P' THEN 'withdrawn' ELSE 'candidate' END AS status FROM {orders} JOIN {customer} ON c_custkey = o_custkey",
    "mapping_audits": "SELECT o_orderkey + 1000000 AS id, o_orderkey AS evidence_id, o_custkey AS question_id, c_nationkey AS textbook_id, c_nationkey * 10 + c_custkey % 4 AS curriculum_node_id, o_custkey * 10 AS source_revision_id, md5(CAST(o_custkey AS STRING)) AS approval_input_hash, o_custkey % 2 AS approval_snapshot_revision, CASE WHEN o_orderkey % 5 = 0 THEN 'fail' ELSE 'pass' END AS audit_status FROM {orders} JOIN {customer} ON c_custkey = o_custkey",
    "placements": "SELECT o_orderkey AS id, o_custkey AS question_id, c_nationkey AS textbook_id, c_nationkey * 10 + c_custkey % 4 AS curriculum_node_id, md5(CAST(o_custkey AS STRING)) AS question_input_hash, o_orderkey % 2 AS question_snapshot_revision, 'v1' AS textbook_catalog_version, CASE WHEN c_custkey % 4 = 3 THEN 'v0' ELSE 'v1' END AS node_catalog_version, CASE WHEN o_orderstatus = 'P' THEN 'now' END AS invalidated_at FROM {orders} JOIN {customer} ON c_custkey = o_custkey",
    "content_sources": "SELECT o_orderkey AS id, o_orderkey % 25 AS import_run_id, CASE WHEN o_orderkey % 13 = 0 THEN 'failed' ELSE 'passed' END AS fidelity_status, md5(CAST(o_orderkey AS STRING)) AS converted_sha256 FROM {orders}",
    "content_parts": f"SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS source_id, l_linenumber AS segment_id, l_returnflag AS content_type, l_orderkey AS textbook_id, l_orderkey % 5 AS curriculum_node_id, '[' || CAST(l_linenumber * 100 AS STRING) || ',' || CAST(l_linenumber * 100 + 60 AS STRING) || ']' AS source_character_range_json, CASE WHEN l_discount > 0.09 THEN 'now' END AS invalidated_at FROM {_LINES}",
    "content_revs": f"SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey * 10 + l_linenumber AS segment_row_id, l_orderkey AS source_id, l_linenumber AS source_segment_id, l_returnflag AS content_type, l_orderkey AS textbook_id, l_orderkey % 5 AS curriculum_node_id FROM {_LINES}",
    "content_heads": f"SELECT max(l_orderkey * 10 + l_linenumber) AS current_revision_id, l_returnflag AS content_type, l_orderkey AS textbook_id, l_orderkey % 5 AS curriculum_node_id, count(*) AS head_revision FROM {_LINES} GROUP BY l_returnflag, l_orderkey",
    "answers": f"SELECT l_orderkey AS controlled_source_id, l_orderkey % 25 AS import_run_id, l_orderkey AS textbook_id, l_orderkey % 5 AS curriculum_node_id, l_linenumber AS source_question_no, f AS field_name, '[' || CAST(l_linenumber * 100 + s AS STRING) || ',' || CAST(l_linenumber * 100 + s + 10 AS STRING) || ']' AS source_character_range_json FROM {_LINES} CROSS JOIN (VALUES ('answer', 55), ('analysis', 70)) AS v(f, s)",
    "derived": f"SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey % 25 AS import_run_id, l_orderkey AS source_document_id, l_orderkey AS controlled_source_id, l_orderkey * 10 + l_linenumber AS student_segment_row_id, l_orderkey AS textbook_id, l_orderkey % 5 AS curriculum_node_id, l_linenumber - 1 AS source_question_no FROM {_LINES}",
    "files": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'pdf' ELSE 'docx' END AS file_type, 'parsed' AS parse_status, md5(CAST(o_orderkey AS STRING)) AS file_hash FROM {orders}",
    "roles": f"SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey % 25 AS import_run_id, l_orderkey AS question_id, md5(CAST(l_orderkey AS STRING)) AS input_hash, l_suppkey AS textbook_id, l_linenumber AS curriculum_node_id, l_partkey AS source_document_id, md5(CAST(l_partkey AS STRING)) AS source_document_hash, l_partkey AS source_fragment_id, 'h' AS source_hash, CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'P' ELSE 'EEL' END AS role_marker FROM {_LINES}",
    "role_runs": "SELECT n_nationkey AS id, CASE WHEN n_regionkey = 0 THEN 'rejected' ELSE 'validated_evidence' END AS status FROM {nation}",
    "asked": "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'blocked' ELSE 'approved' END AS quality_status, 'approved' AS review_status FROM {orders}",
    "asked_inputs": "SELECT o_orderkey AS question_id, md5(CAST(o_orderkey AS STRING)) AS input_hash, CASE WHEN o_orderkey % 10 = 0 THEN 'now' END AS invalidated_at FROM {orders}",
    "fits": f"SELECT l_orderkey AS question_id, l_suppkey AS textbook_id, l_linenumber AS curriculum_node_id, CASE WHEN l_discount < 0.08 THEN 'approved' ELSE 'pending' END AS fit_status FROM {_LINES}",
    "part_files": "SELECT p_partkey AS id, md5(CAST(p_partkey AS STRING)) AS file_hash, CASE WHEN p_size = 7 THEN 'failed' ELSE 'parsed' END AS parse_status FROM {part}",
    "fragments": "SELECT p_partkey AS id, p_partkey AS source_document_id, 'h' AS raw_hash, p_type AS raw_text FROM {part}",
    "extras": "SELECT o_orderkey AS id, o_orderkey % 25 AS import_run_id, o_custkey AS controlled_source_id, md5(CAST(o_custkey AS STRING)) AS original_sha256, md5(CAST(o_custkey + o_orderkey % 3 AS STRING)) AS archive_sha256, 'c' AS converted_sha256 FROM {orders}",
    "extra_sources": "SELECT c_custkey AS id, md5(CAST(c_custkey AS STRING)) AS original_sha256, md5(CAST(c_custkey AS STRING)) AS archive_sha256, 'c' AS converted_sha256 FROM {customer}",
    "artifacts": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'pdf' ELSE 'docx' END AS document_type, CASE WHEN o_orderkey % 3 = 0 THEN 'teacher' ELSE 'student' END AS audience, md5(CAST(o_orderkey AS STRING)) AS content_hash, 'q' AS question_set_hash, 's' AS snapshot_hash FROM {orders}",
    "quality": "SELECT o_orderkey * 2 AS id, o_orderkey AS document_id, 'pass' AS status, 'pass' AS data_gate, CASE WHEN o_orderstatus = 'P' THEN 'fail' ELSE 'pass' END AS rule_gate, 'pass' AS fidelity_gate, CASE WHEN o_custkey % 9 = 0 THEN 'fail' ELSE 'pass' END AS artifact_gate FROM {orders}",
    "validations": "SELECT o_orderkey * 2 AS quality_report_id, o_orderkey AS document_id, 'pass' AS gate, md5(CAST(o_orderkey + CASE WHEN o_custkey % 8 = 0 THEN 1 ELSE 0 END AS STRING)) AS content_hash, 'q' AS question_set_hash, 's' AS snapshot_hash, CASE WHEN o_orderkey % 2 = 0 THEN 'pdf' WHEN o_custkey % 2 = 0 THEN 'docx_teacher' ELSE 'docx_student' END AS artifact_role FROM {orders}",
    "asking": "SELECT c_custkey AS question_id, translate(md5(CAST(c_custkey % 60 AS STRING)), '0123456789abcdef', '一二三四五六七八九十百千万角形圆') AS text, CASE WHEN c_custkey % 11 = 0 THEN 9 ELSE c_custkey % 5 END AS textbook_id, c_custkey % 5 AS catalog FROM {customer}",
    "labels_": "SELECT p_partkey % 5 AS catalog, p_partkey AS node_id, substring(translate(md5(CAST(p_partkey AS STRING)), '0123456789abcdef', '一二三四五六七八九十百千万角形圆'), 1, 3 + CAST(p_partkey % 4 AS INT)) AS name, p_partkey % 5 AS textbook_id, CASE WHEN p_partkey % 5 = 4 THEN '' ELSE 'v1' END AS catalog_version FROM {part} WHERE p_partkey % 5 <> 3",
}


#: What several inputs are built from, by name: how they say it, and what it is.
SHARED = {"lines": (_LINES, f"SELECT * FROM {_LINES}")}


def made(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The inputs. What they say more than once is worked out once, written, and read by each."""
    given = {t: table(spark, sf_dir, t) for t in _TABLES}
    said = {n: INPUTS[n] for n in names}
    for name, (how, what) in reversed(SHARED.items()):
        if sum(q.count(how) for q in said.values()) > 1:
            said = {n: q.replace(how, f"{{{name}}} AS l") for n, q in said.items()}
            given[name] = written(_told(spark, what, given), name)
    return [_told(spark, q, given) for q in said.values()]


def _told(spark: SparkSession, query_: str, given: dict[str, DataFrame]) -> DataFrame:
    return spark.sql(query_, **{t: df for t, df in given.items() if f"{{{t}}}" in query_})


def twin(names: tuple[str, ...], *more: str) -> str:
    """The inputs by name, further named steps, and a last SELECT."""
    plain = {t: t for t in _TABLES}
    return "WITH " + ", ".join([f"{n} AS ({INPUTS[n].format(**plain)})" for n in names] + list(more[:-1])) + " " + more[-1]


_MAPPING = ("revisions", "heads", "runs", "points", "known", "placed")


@query(
    twin(
        _MAPPING,
        "told AS (SELECT p.source_revision_id, count(*) AS n, bool_and(coalesce(k.review_status = 'approved', false) AND d.knowledge_point_id IS NOT NULL) AS good FROM points p JOIN revisions r ON r.id = p.source_revision_id LEFT JOIN known k ON k.id = p.knowledge_point_id LEFT JOIN placed d ON d.knowledge_point_id = p.knowledge_point_id AND d.curriculum_node_id = r.curriculum_node_id GROUP BY 1)",
        "SELECT r.id, r.question_id, h.head_revision FROM revisions r JOIN heads h ON h.current_revision_id = r.id AND h.question_id = r.question_id JOIN told t ON t.source_revision_id = r.id AND t.good AND t.n = json_array_length(r.knowledge_points_json) WHERE EXISTS (SELECT 1 FROM runs u WHERE u.id = r.import_run_id AND u.status IN ('validated', 'approved') AND u.source_reference = r.source_reference AND u.source_hash = r.source_hash)",
    )
)
def current_mapping_revisions(spark, sf_dir):
    return ev.mapping_revisions(*made(spark, sf_dir, *_MAPPING)).select("id", "question_id", "head_revision")


_CATALOG = ("releases", "release_audits", "catalog_runs")
_APPROVAL = ("approvals", "snapshots", "mapped", "questions", "sources", "textbooks", "nodes")
_APPROVED = (
    "open_books AS (SELECT DISTINCT l.textbook_id, l.catalog_version FROM releases l JOIN release_audits a ON a.catalog_release_id = l.id AND a.source_hash = l.source_hash JOIN catalog_runs c ON c.id = a.import_run_id AND c.status = 'validated' AND c.source_hash = l.source_hash WHERE l.status = 'approved')",
    "live_inputs AS (SELECT * FROM snapshots WHERE invalidated_at IS NULL)",
    "trusted AS (SELECT q.id FROM questions q JOIN sources s ON s.id = q.source_document_id WHERE s.trusted_source = 1)",
)
_STANDING = "standing AS (SELECT a.* FROM approvals a JOIN live_inputs s ON s.question_id = a.question_id AND s.revision = a.approval_snapshot_revision AND s.input_hash = a.approval_input_hash JOIN mapped m ON m.id = a.source_revision_id AND m.curriculum_node_id = a.curriculum_node_id JOIN trusted t ON t.id = a.question_id JOIN nodes n ON n.id = a.curriculum_node_id AND n.textbook_id = a.textbook_id AND n.status = 'active' JOIN open_books b ON b.textbook_id = n.textbook_id AND b.catalog_version = n.catalog_version WHERE a.status = 'candidate')"


def _approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    given, inputs, revisions, questions, documents, books, nodes = made(spark, sf_dir, *_APPROVAL)
    return ev.approval_evidence(given, inputs, revisions, questions, documents, books, nodes, ev.audited_releases(*made(spark, sf_dir, *_CATALOG)))


@query(twin((*_CATALOG, *_APPROVAL), *_APPROVED, _STANDING, "SELECT id, question_id, source_revision_id FROM standing"))
def current_approval_evidence(spark, sf_dir):
    return _approved(spark, sf_dir).select("id", "question_id", "source_revision_id")


@query(
    twin(
        (*_CATALOG, *_APPROVAL, "mapping_audits"),
        *_APPROVED,
        _STANDING,
        "SELECT x.id, x.evidence_id FROM mapping_audits x JOIN standing a ON a.id = x.evidence_id AND a.source_revision_id = x.source_revision_id AND a.approval_snapshot_revision = x.approval_snapshot_revision AND a.approval_input_hash = x.approval_input_hash WHERE x.audit_status = 'pass'",
    )
)
def current_mapping_audits(spark, sf_dir):
    audits, inputs, revisions = made(spark, sf_dir, "mapping_audits", "snapshots", "mapped")
    return ev.passed_audits(audits, _approved(spark, sf_dir), inputs, revisions).select("id", "evidence_id")


@query(
    twin(
        (*_CATALOG, "placements", "snapshots", "questions", "sources", "textbooks", "nodes"),
        *_APPROVED,
        "SELECT p.id, p.question_id FROM placements p JOIN live_inputs s ON s.question_id = p.question_id AND s.revision = p.question_snapshot_revision JOIN trusted t ON t.id = p.question_id JOIN open_books b ON b.textbook_id = p.textbook_id AND b.catalog_version = p.textbook_catalog_version JOIN nodes n ON n.id = p.curriculum_node_id AND n.catalog_version = p.node_catalog_version WHERE p.invalidated_at IS NULL",
    )
)
def current_curriculum_evidence(spark, sf_dir):
    given = made(spark, sf_dir, "placements", "snapshots", "questions", "sources", "textbooks", "nodes")
    return ev.curriculum_evidence(*given, ev.audited_releases(*made(spark, sf_dir, *_CATALOG))).select("id", "question_id")


_CONTENT = ("content_revs", "content_heads", "content_parts", "content_sources", "runs")
_LIVE = "live AS (SELECT p.*, h.head_revision, CAST(json_extract(p.source_character_range_json, '$[0]') AS BIGINT) AS s, CAST(json_extract(p.source_character_range_json, '$[1]') AS BIGINT) AS e FROM content_revs r JOIN content_heads h ON h.current_revision_id = r.id JOIN content_parts p ON p.id = r.segment_row_id AND p.invalidated_at IS NULL JOIN content_sources c ON c.id = r.source_id AND c.fidelity_status = 'passed' JOIN runs u ON u.id = c.import_run_id AND u.status = 'validated')"
_FREE = "free AS (SELECT a.* FROM answers a JOIN runs u ON u.id = a.import_run_id AND u.status = 'validated' WHERE EXISTS (SELECT 1 FROM live v WHERE v.source_id = a.controlled_source_id) AND NOT EXISTS (SELECT 1 FROM live v WHERE v.source_id = a.controlled_source_id AND v.s < CAST(json_extract(a.source_character_range_json, '$[1]') AS BIGINT) AND v.e > CAST(json_extract(a.source_character_range_json, '$[0]') AS BIGINT)))"


def _segments(*content: DataFrame) -> DataFrame:
    """Current segments, written, as several steps read them."""
    return written(ev.content_segments(content[2], ev.content_revisions(*content)).select("id", "source_id", "textbook_id", "curriculum_node_id", "source_character_range_json"), "segments")


@query(twin(_CONTENT, _LIVE, "SELECT id, source_id, head_revision FROM live"))
def current_content_revisions(spark, sf_dir):
    return ev.content_revisions(*made(spark, sf_dir, *_CONTENT)).select("id", "source_id", "head_revision")


@query(twin((*_CONTENT, "answers"), _LIVE, _FREE, "SELECT controlled_source_id, source_question_no, field_name FROM free"))
def current_answer_evidence(spark, sf_dir):
    *content, answers = made(spark, sf_dir, *_CONTENT, "answers")
    return ev.answer_evidence(answers, content[4], _segments(*content)).select("controlled_source_id", "source_question_no", "field_name")


@query(
    twin(
        (*_CONTENT, "answers", "derived", "files"),
        _LIVE,
        _FREE,
        "SELECT d.id FROM derived d JOIN live v ON v.id = d.student_segment_row_id JOIN files f ON f.id = d.source_document_id AND f.file_type = 'docx' WHERE 2 = (SELECT count(DISTINCT field_name) FROM free a WHERE a.controlled_source_id = d.controlled_source_id AND a.source_question_no = d.source_question_no)",
    )
)
def current_source_derivations(spark, sf_dir):
    *content, derived, files, answers = made(spark, sf_dir, *_CONTENT, "derived", "files", "answers")
    sources, runs = content[3:]
    parts = _segments(*content)
    return ev.source_derivations(derived, runs, files, sources, parts, ev.answer_evidence(answers, runs, parts)).select("id")


_ROLE = ("roles", "role_runs", "asked", "asked_inputs", "fits", "part_files", "fragments")


@query(
    twin(
        _ROLE,
        "SELECT r.id, r.role_marker FROM roles r JOIN role_runs u ON u.id = r.import_run_id AND u.status = 'validated_evidence' JOIN asked q ON q.id = r.question_id AND q.quality_status = 'approved' JOIN asked_inputs s ON s.question_id = r.question_id AND s.invalidated_at IS NULL JOIN part_files d ON d.id = r.source_document_id AND d.parse_status = 'parsed' JOIN fragments f ON f.id = r.source_fragment_id AND contains(f.raw_text, r.role_marker) WHERE EXISTS (SELECT 1 FROM fits m WHERE m.question_id = r.question_id AND m.textbook_id = r.textbook_id AND m.curriculum_node_id = r.curriculum_node_id AND m.fit_status = 'approved')",
    )
)
def current_role_evidence(spark, sf_dir):
    return ev.role_evidence(*made(spark, sf_dir, *_ROLE)).select("id", "role_marker")


@query(twin(("extras", "role_runs", "extra_sources"), "SELECT e.id FROM extras e JOIN role_runs u ON u.id = e.import_run_id AND u.status = 'validated_evidence' JOIN extra_sources s ON s.id = e.controlled_source_id AND s.archive_sha256 = e.archive_sha256 AND s.original_sha256 = e.original_sha256"))
def current_auxiliary_evidence(spark, sf_dir):
    return ev.auxiliary_evidence(*made(spark, sf_dir, "extras", "role_runs", "extra_sources")).select("id")


@query(twin(("artifacts", "quality", "validations"), "SELECT a.id, v.artifact_role FROM artifacts a JOIN validations v ON v.document_id = a.id AND v.content_hash = a.content_hash AND v.artifact_role = CASE WHEN a.document_type = 'pdf' THEN 'pdf' ELSE 'docx_' || a.audience END JOIN quality q ON q.id = v.quality_report_id AND 'fail' NOT IN (q.data_gate, q.rule_gate, q.fidelity_gate, q.artifact_gate)"))
def evidence_binding(spark, sf_dir):
    return ev.bound_documents(*made(spark, sf_dir, "artifacts", "quality", "validations")).select("id", "artifact_role")


@query(
    twin(
        ("asking", "labels_"),
        "pairs AS (SELECT a.question_id, n.node_id, (SELECT max(k) FROM range(4, 7) t(k), range(1, 4) s(i) WHERE i + k - 1 <= length(n.name) AND contains(a.text, substring(n.name, CAST(i AS INT), CAST(k AS INT)))) AS longest FROM asking a JOIN labels_ n ON n.catalog = a.catalog)",
        "ranked AS (SELECT question_id, node_id, least(1.0, longest / 5) AS c, row_number() OVER (PARTITION BY question_id ORDER BY least(1.0, longest / 5) DESC, node_id) AS r FROM pairs WHERE longest IS NOT NULL)",
        "best AS (SELECT a.*, x.node_id, x.c, y.c AS c2 FROM asking a LEFT JOIN ranked x ON x.question_id = a.question_id AND x.r = 1 LEFT JOIN ranked y ON y.question_id = a.question_id AND y.r = 2)",
        "judged AS (SELECT *, CASE WHEN catalog = 3 THEN 'no_catalog_nodes' WHEN catalog = 4 AND textbook_id = 9 THEN 'cross_textbook_catalog_node,incomplete_catalog_node' WHEN catalog = 4 THEN 'incomplete_catalog_node' WHEN catalog <> textbook_id THEN 'cross_textbook_catalog_node' WHEN c IS NULL THEN 'no_exact_catalog_anchor' WHEN c < 0.75 THEN 'low_confidence' WHEN c - c2 < 0.15 THEN 'ambiguous_top_candidate' ELSE '' END AS why FROM best)",
        "SELECT question_id, CASE WHEN why = '' THEN 'candidate' ELSE 'isolated' END AS status, CASE WHEN why = '' THEN node_id END AS node_id, why AS reasons FROM judged",
    )
)
def mapping_suggestions(spark, sf_dir):
    out = progress.suggest_mapping(*made(spark, sf_dir, "asking", "labels_"))
    return out.select("question_id", "status", "node_id", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH s AS (SELECT lang, source, count(*) AS n FROM documents WHERE lang IN ('en', 'de') GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS a, least(CASE lang WHEN 'en' THEN 37 ELSE 11 END, sum(n) OVER (PARTITION BY lang)) AS w FROM s),
    f AS (SELECT *, (n * w) // a AS fl, row_number() OVER (PARTITION BY lang ORDER BY (n * w) % a DESC, source NULLS FIRST) AS p, w - sum((n * w) // a) OVER (PARTITION BY lang) AS lft FROM t),
    d AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('two:' || CAST(doc_id AS VARCHAR)), doc_id) AS pick FROM documents)
    SELECT d.doc_id, d.lang, d.pick FROM d JOIN f ON f.lang = d.lang AND f.source IS NOT DISTINCT FROM d.source WHERE d.pick <= fl + CASE WHEN p <= lft THEN 1 ELSE 0 END""")
def two_level_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return sampling.two_level(docs, "lang", "source", "doc_id", {"en": 37, "de": 11}, "two").select("doc_id", "lang", "pick")
