"""Evidence that still stands: heads, import runs, snapshots and cited sources must all still say what the evidence says. Every view returns a
row of its first table once, however often others back it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .segment import overlapping_removed

_PLACE = ("textbook_id", "curriculum_node_id")


def backed(rows: DataFrame, must: DataFrame, on: Mapping[str, str] | Sequence[str], where: Column | None = None) -> DataFrame:
    """rows for which `must` (where the condition holds in it) has an equal row: column of rows -> column of must, or names that both have."""
    pairs = dict(on) if isinstance(on, Mapping) else {c: c for c in on}
    held = (must if where is None else must.where(where)).select(*(F.col(theirs).alias(f"_{k}_must") for k, theirs in enumerate(pairs.values())))
    equal = [F.col(mine) == F.col(f"_{k}_must") for k, mine in enumerate(pairs)]
    return rows.join(held, reduce(lambda a, b: a & b, equal), "left_semi")


def _headed(revisions: DataFrame, heads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Revisions that the head of their keys names, with head_revision."""
    return revisions.join(heads.select(F.col("current_revision_id").alias("id"), *keys, "head_revision"), ["id", *keys])


def mapping_revisions(revisions: DataFrame, heads: DataFrame, runs: DataFrame, points: DataFrame, known: DataFrame, placed: DataFrame) -> DataFrame:
    """Head revisions from a validated or approved mapping run of their source, all of whose knowledge points, one at least and as many as
    their JSON list has, are approved and placed at the revision's node."""
    now = _headed(revisions, heads, ["question_id", *_PLACE])
    now = backed(now, runs, {"import_run_id": "id", "source_reference": "source_reference", "source_hash": "source_hash"}, (F.col("import_kind") == "question_mapping") & F.col("status").isin("validated", "approved"))
    nodes = now.select(F.col("id").alias("source_revision_id"), "curriculum_node_id")
    approved = known.where("review_status = 'approved'").select(F.col("id").alias("knowledge_point_id")).distinct().withColumn("_known", F.lit(True))
    there = placed.select("knowledge_point_id", "curriculum_node_id").distinct().withColumn("_placed", F.lit(True))
    met = points.select("source_revision_id", "knowledge_point_id").join(nodes, "source_revision_id").join(approved, "knowledge_point_id", "left").join(there, ["knowledge_point_id", "curriculum_node_id"], "left")
    whole = met.groupBy(F.col("source_revision_id").alias("_rev")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_known") & F.col("_placed")).alias("_good")).where("_n = _good")
    return now.join(whole, (F.col("id") == F.col("_rev")) & (F.json_array_length("knowledge_points_json") == F.col("_n")), "left_semi")


def audited_releases(releases: DataFrame, audits: DataFrame, runs: DataFrame) -> DataFrame:
    """Approved catalog releases with an approved audit from a validated catalog run, all of one source."""
    source = {"source_reference": "source_reference", "source_hash": "source_hash"}
    sound = backed(audits.where("status = 'approved'"), runs, {"import_run_id": "id"} | source, (F.col("import_kind") == "catalog") & (F.col("status") == "validated"))
    return backed(releases.where("status = 'approved'"), sound, {"id": "catalog_release_id"} | source)


def _of_trusted(evidence: DataFrame, questions: DataFrame, documents: DataFrame) -> DataFrame:
    return backed(evidence, backed(questions, documents, {"source_document_id": "id"}, F.col("trusted_source") == 1), {"question_id": "id"})


def approval_evidence(evidence: DataFrame, snapshots: DataFrame, revisions: DataFrame, questions: DataFrame, documents: DataFrame, textbooks: DataFrame, nodes: DataFrame, releases: DataFrame) -> DataFrame:
    """Candidates whose snapshot hash and revision are live, whose revision is current (`mapping_revisions`), whose document is trusted and
    whose active node is of its textbook's version, released (`audited_releases`)."""
    out = evidence.where("status = 'candidate'")
    out = backed(out, snapshots, {"question_id": "question_id", "approval_input_hash": "input_hash", "approval_snapshot_revision": "revision"}, F.col("invalidated_at").isNull())
    out = backed(out, revisions, {"source_revision_id": "id", "question_id": "question_id"} | {c: c for c in _PLACE})
    books = backed(textbooks, releases, {"id": "textbook_id", "catalog_version": "catalog_version"})
    live = backed(nodes.where("status = 'active'"), books, {"textbook_id": "id", "catalog_version": "catalog_version"})
    return backed(_of_trusted(out, questions, documents), live, {"curriculum_node_id": "id", "textbook_id": "textbook_id"})


def passed_audits(audits: DataFrame, evidence: DataFrame, snapshots: DataFrame, revisions: DataFrame) -> DataFrame:
    """Passed audits of current evidence (`approval_evidence`) with its keys, hash and revision."""
    same = {c: c for c in ("question_id", *_PLACE, "source_revision_id", "approval_input_hash", "approval_snapshot_revision")}
    out = backed(audits.where("audit_status = 'pass'"), evidence, {"evidence_id": "id"} | same)
    out = backed(out, snapshots, {"question_id": "question_id", "approval_input_hash": "input_hash", "approval_snapshot_revision": "revision"}, F.col("invalidated_at").isNull())
    return backed(out, revisions, {"source_revision_id": "id"})


def curriculum_evidence(evidence: DataFrame, snapshots: DataFrame, questions: DataFrame, documents: DataFrame, textbooks: DataFrame, nodes: DataFrame, releases: DataFrame) -> DataFrame:
    """Evidence that is not voided, of a live snapshot, a trusted document, and the versions of textbook and node it was given for."""
    out = evidence.where("invalidated_at IS NULL")
    out = backed(out, snapshots, {"question_id": "question_id", "question_input_hash": "input_hash", "question_snapshot_revision": "revision"}, F.col("invalidated_at").isNull())
    out = backed(_of_trusted(out, questions, documents), backed(textbooks, releases, {"id": "textbook_id", "catalog_version": "catalog_version"}), {"textbook_id": "id", "textbook_catalog_version": "catalog_version"})
    return backed(out, nodes, {"curriculum_node_id": "id", "textbook_id": "textbook_id", "node_catalog_version": "catalog_version"})


def content_revisions(revisions: DataFrame, heads: DataFrame, segments: DataFrame, sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Head revisions of live segments from faithful sources of validated runs."""
    sound = backed(sources.where("fidelity_status = 'passed'"), runs, {"import_run_id": "id"}, F.col("status") == "validated")
    now = backed(_headed(revisions, heads, ["content_type", *_PLACE]), sound, {"source_id": "id"})
    same = {"segment_row_id": "id", "source_id": "source_id", "source_segment_id": "segment_id", "content_type": "content_type"}
    return backed(now, segments, same | {c: c for c in _PLACE}, F.col("invalidated_at").isNull())


def content_segments(segments: DataFrame, current: DataFrame) -> DataFrame:
    """Segments that a current revision is of."""
    return backed(segments, current, {"id": "segment_row_id"})


def _ranged(df: DataFrame) -> DataFrame:
    at = lambda k: F.get_json_object("source_character_range_json", f"$[{k}]").cast("long")
    return df.withColumns({"start": at(0), "end": at(1)})


def answer_evidence(evidence: DataFrame, runs: DataFrame, segments: DataFrame) -> DataFrame:
    """Evidence of validated runs at a place with current segments, none of which its characters overlap."""
    place = ["controlled_source_id", *_PLACE]
    shown = _ranged(segments).select(F.col("source_id").alias("controlled_source_id"), *_PLACE, "start", "end")
    now = backed(evidence, runs, {"import_run_id": "id"}, F.col("status") == "validated")
    return backed(overlapping_removed(_ranged(now), shown, place), shown, place).select(*evidence.columns)


def source_derivations(derivations: DataFrame, runs: DataFrame, documents: DataFrame, sources: DataFrame, segments: DataFrame, answers: DataFrame) -> DataFrame:
    """Derivations of validated runs from parsed word documents that are the source's bytes, with current answer and analysis evidence."""
    out = backed(derivations, runs, {"import_run_id": "id"}, F.col("status") == "validated")
    out = backed(out, segments, {"student_segment_row_id": "id", "controlled_source_id": "source_id"} | {c: c for c in _PLACE})
    bytes_of = documents.where("file_type = 'docx' AND parse_status = 'parsed'").select(F.col("id").alias("_d"), F.col("file_hash").alias("_h")).join(sources.select(F.col("id").alias("_s"), F.col("converted_sha256").alias("_h")), "_h")
    out = backed(out, bytes_of, {"source_document_id": "_d", "controlled_source_id": "_s"})
    both = ["import_run_id", "controlled_source_id", *_PLACE, "source_question_no"]
    has = lambda field: F.bool_or(F.col("field_name") == field)
    return backed(out, answers.groupBy(*both).agg((has("answer") & has("analysis")).alias("_both")), both, F.col("_both"))


def role_evidence(evidence: DataFrame, runs: DataFrame, questions: DataFrame, snapshots: DataFrame, mappings: DataFrame, documents: DataFrame, fragments: DataFrame) -> DataFrame:
    """Roles of approved questions with live snapshots and approved mappings, whose marker is in the cited fragment of the parsed document."""
    # What is asked of one question, and of one document, is put together first, so that evidence meets each side once.
    out = backed(evidence, runs, {"import_run_id": "id"}, F.col("status") == "validated_evidence")
    parsed = documents.where("parse_status = 'parsed'").select(F.col("id").alias("_d"), F.col("file_hash").alias("_dh"))
    cited = fragments.select(F.col("id").alias("_f"), F.col("source_document_id").alias("_d"), F.col("raw_hash").alias("_h"), F.col("raw_text").alias("_t")).join(parsed, "_d")
    on = (F.col("source_fragment_id") == F.col("_f")) & (F.col("source_document_id") == F.col("_d")) & (F.col("source_hash") == F.col("_h")) & (F.col("source_document_hash") == F.col("_dh")) & F.contains("_t", F.col("role_marker"))
    out = out.join(cited, on, "left_semi")
    live = backed(snapshots.where("invalidated_at IS NULL"), questions, {"question_id": "id"}, (F.col("quality_status") == "approved") & (F.col("review_status") == "approved"))
    out = backed(out, live, ["question_id", "input_hash"])
    return backed(out, mappings, ["question_id", *_PLACE], F.col("fit_status") == "approved")


def auxiliary_evidence(evidence: DataFrame, runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence of validated runs whose three hashes are the source's."""
    out = backed(evidence, runs, {"import_run_id": "id"}, F.col("status") == "validated_evidence")
    return backed(out, sources, {"controlled_source_id": "id"} | {c: c for c in ("original_sha256", "archive_sha256", "converted_sha256")})


#: The gates of a quality report.
GATES = ("data_gate", "rule_gate", "fidelity_gate", "artifact_gate")


def bound_documents(documents: DataFrame, reports: DataFrame, validations: DataFrame) -> DataFrame:
    """Documents with a passed report, all gates passed, and a passed validation of exactly their content, question set, snapshot and role."""
    passed = reports.where(reduce(lambda a, g: a & (F.col(g) == "pass"), GATES, F.col("status") == "pass"))
    of = backed(validations.where("gate = 'pass'"), passed, {"quality_report_id": "id", "document_id": "document_id"})
    role = F.when(F.col("document_type") == "pdf", "pdf").otherwise(F.concat(F.lit("docx_"), F.col("audience")))
    hashes = ("content_hash", "question_set_hash", "snapshot_hash")
    return backed(documents.withColumn("artifact_role", role), of, {"id": "document_id", "artifact_role": "artifact_role"} | {h: h for h in hashes})
