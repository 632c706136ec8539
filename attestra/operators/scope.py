"""Whether a question's textbook mappings are in scope, by ordered chains of rules: data, of which the first that applies decides."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import column_or_null


class Rule(NamedTuple):
    """applies: a condition over a row, in SQL (null: it does not apply). reason: a text, or `=` and a column that has it."""

    applies: str
    status: str
    reason: str


#: What is told where a mapping stops, in this order.
MAPPING = (
    Rule("fit_status = 'rejected'", "fail", "教材映射已被拒绝"),
    Rule("classifier_run_id IS NOT NULL OR classification_method = 'candidate'", "unsupported", "分类器映射仅为候选建议，不能作为教材范围批准依据"),
    Rule("NOT fit_status <=> 'approved'", "unsupported", "教材映射尚未获自动批准"),
    Rule("curriculum_node_id IS NULL", "unsupported", "映射缺少课程节点"),
    Rule("NOT node_textbook_id <=> textbook_id OR NOT textbook_version <=> node_version", "fail", "教材与课程节点版本不一致"),
    Rule("NOT node_stage <=> stage", "fail", "题目学段与课程节点学段冲突"),
    Rule("NOT node_status <=> 'active'", "unsupported", "课程节点未启用"),
    Rule("release_id IS NULL OR NOT release_status <=> 'approved' OR coalesce(source_reference, '') = '' OR coalesce(source_hash, '') = ''", "unsupported", "缺少已批准且可追溯的教材目录发布记录"),
    Rule("NOT catalog_approved", "unsupported", "缺少已批准且可追溯的受控导入教材目录记录"),
    Rule("revised_status <> 'pass'", "unsupported", "=revised_reason"),
    Rule("revised_status = 'pass'", "pass", ""),
    Rule("NOT mapping_status <=> 'approved' OR mapping_run IS NULL OR coalesce(mapping_hash, '') = ''", "unsupported", "缺少已批准且可追溯的受控导入教材目录记录"),
    Rule("coalesce(size(knowledge_points), 0) < 1", "unsupported", "缺少与课程节点一致的已批准知识点映射"),
    Rule("true", "pass", ""),
)
REVISION = (
    Rule("snapshot_hash IS NULL OR invalidated_at IS NOT NULL", "unsupported", "p1_3c_approval_snapshot_missing_or_invalidated"),
    Rule("current_hash IS NULL", "unsupported", "p1_3c_approval_input_unavailable"),
    Rule("snapshot_hash <> current_hash", "unsupported", "p1_3c_approval_snapshot_stale"),
    Rule("NOT audited", "unsupported", "p1_3c_current_revision_audit_missing"),
    Rule("coalesce(size(knowledge_points), 0) < 1", "unsupported", "p1_3c_current_revision_knowledge_missing"),
    Rule("true", "pass", ""),
)
UNMAPPED = "缺少受控教材课程映射"


def first_match(rules: Sequence[Rule]) -> Column:
    """struct<rank (from 1), status, reason> of the first rule that applies; null if none does."""
    told = lambda k, r: F.struct(F.lit(k).alias("rank"), F.lit(r.status).alias("status"), (F.col(r.reason[1:]) if r.reason.startswith("=") else F.lit(r.reason)).alias("reason"))
    out = None
    for k, r in enumerate(rules, 1):
        applies = F.coalesce(F.expr(r.applies), F.lit(False))
        out = F.when(applies, told(k, r)) if out is None else out.when(applies, told(k, r))
    return out


def approved_points(points: DataFrame, node_points: DataFrame, known: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, curriculum_node_id and knowledge_points, for wanted (keys, curriculum_node_id): approved ones of rows (keys, knowledge_point_id) that belong to the node, in order.

    A point goes through shuffles once with the few nodes that it belongs to, not once a node; the wanted node is picked where both meet, and they are grouped there.
    """
    real = known.where("review_status = 'approved'").select(F.col("id").alias("knowledge_point_id")).distinct()
    nodes = node_points.groupBy("knowledge_point_id").agg(F.collect_set("curriculum_node_id").alias("_nodes")).join(real, "knowledge_point_id", "left_semi")
    met = points.join(nodes, "knowledge_point_id").join(wanted.select(*keys, "curriculum_node_id").distinct().repartition(*keys), list(keys)).where(F.array_contains("_nodes", F.col("curriculum_node_id")))
    return met.groupBy(*keys, "curriculum_node_id").agg(F.array_sort(F.collect_set("knowledge_point_id")).alias("knowledge_points"))


def revision_scope(revisions: DataFrame, snapshots: DataFrame, current: DataFrame, audits: DataFrame, points: DataFrame, node_points: DataFrame, known: DataFrame) -> DataFrame:
    """question_id, textbook_id, curriculum_node_id, status, reason, mapping_hash and knowledge_points of each current source revision.

    revisions: id, question_id, textbook_id, curriculum_node_id, mapping_hash. snapshots: question_id, input_hash, revision, invalidated_at. current: question_id,
    input_hash as it is now. audits: source_revision_id, question_id, textbook_id, curriculum_node_id, status, approval_input_hash,
    approval_snapshot_revision. points: source_revision_id, knowledge_point_id.
    """
    place = ["question_id", "textbook_id", "curriculum_node_id"]
    out = revisions.join(snapshots.select("question_id", F.col("input_hash").alias("snapshot_hash"), F.col("revision").alias("snapshot_revision"), "invalidated_at"), "question_id", "left")
    out = out.join(current.select("question_id", F.col("input_hash").alias("current_hash")), "question_id", "left")
    approved = audits.where("status = 'approved'").select(F.col("source_revision_id").alias("id"), *place, F.col("approval_input_hash").alias("snapshot_hash"), F.col("approval_snapshot_revision").alias("snapshot_revision")).distinct()
    out = out.join(approved.withColumn("audited", F.lit(True)), ["id", *place, "snapshot_hash", "snapshot_revision"], "left").withColumn("audited", F.coalesce("audited", F.lit(False)))
    held = approved_points(points.withColumnRenamed("source_revision_id", "id"), node_points, known, revisions, ["id"])
    out = out.join(held, ["id", "curriculum_node_id"], "left").withColumn("_m", first_match(REVISION))
    return out.select(*place, F.col("_m.status").alias("status"), F.col("_m.reason").alias("reason"), "mapping_hash", "knowledge_points")


def mapping_scope(
    questions: DataFrame, mappings: DataFrame, textbooks: DataFrame, nodes: DataFrame, releases: DataFrame, release_imports: DataFrame, runs: DataFrame, audits: DataFrame | None, mapping_imports: DataFrame, points: DataFrame, node_points: DataFrame, known: DataFrame, revised: DataFrame | None = None
) -> DataFrame:
    """question_id, textbook_id, curriculum_node_id, rank, status, reason and knowledge_points of each mapping of a known question.

    mappings may lack classifier_run_id and classification_method. Without an audits table, imports of the catalogue have to be approved themselves, else
    validated with an approved audit. revised: what revision_scope gives; a mapping that has it is judged by it alone from there on. points: question_id,
    knowledge_point_id, import_run_id, mapping_hash. All tables but the mappings are met by key in left joins.
    """
    place = ["question_id", "textbook_id", "curriculum_node_id"]
    own = mappings.select(*place, "fit_status", *(column_or_null(mappings, c).alias(c) for c in ("classifier_run_id", "classification_method")))
    out = own.join(questions.select(F.col("id").alias("question_id"), "stage"), "question_id").join(textbooks.select(F.col("id").alias("textbook_id"), F.col("catalog_version").alias("textbook_version")), "textbook_id")
    out = out.join(nodes.select(F.col("id").alias("curriculum_node_id"), F.col("textbook_id").alias("node_textbook_id"), F.col("stage").alias("node_stage"), F.col("catalog_version").alias("node_version"), F.col("status").alias("node_status")), "curriculum_node_id", "left")
    out = out.join(releases.select(F.col("id").alias("release_id"), "textbook_id", F.col("catalog_version").alias("textbook_version"), F.col("status").alias("release_status"), "source_reference", "source_hash"), ["textbook_id", "textbook_version"], "left")
    out = out.join(release_imports.select(F.col("catalog_release_id").alias("release_id"), F.col("import_run_id").alias("catalog_run")), "release_id", "left")
    status = lambda name: runs.select(F.col("id").alias(f"{name}_run"), F.col("status").alias(f"{name}_status"))
    out = out.join(status("catalog"), "catalog_run", "left")
    if audits is None:
        out = out.withColumn("catalog_approved", F.coalesce(F.col("catalog_status") == "approved", F.lit(False)))
    else:
        passed = audits.where("status = 'approved'").select(F.col("catalog_release_id").alias("release_id"), F.col("import_run_id").alias("catalog_run"), F.lit(True).alias("_audited"))
        out = out.join(passed, ["release_id", "catalog_run"], "left").withColumn("catalog_approved", F.coalesce((F.col("catalog_status") == "validated") & F.col("_audited"), F.lit(False)))
    imports = mapping_imports.select(*place, F.col("import_run_id").alias("_import"), "mapping_hash").join(status("mapping").withColumnRenamed("mapping_run", "_import").withColumn("mapping_run", F.col("_import")), "_import", "left").drop("_import")
    out = out.join(imports, place, "left")
    held = approved_points(points.select("question_id", "knowledge_point_id", F.col("import_run_id").alias("mapping_run"), "mapping_hash"), node_points, known, imports, ["question_id", "mapping_run", "mapping_hash"])
    out = out.join(held, ["question_id", "mapping_run", "mapping_hash", "curriculum_node_id"], "left")
    if revised is None:
        out = out.withColumns({"revised_status": F.lit(None).cast("string"), "revised_reason": F.lit(None).cast("string")})
    else:
        now = revised.select(*place, F.col("status").alias("revised_status"), F.col("reason").alias("revised_reason"), F.col("knowledge_points").alias("_points"))
        out = out.join(now, place, "left").withColumn("knowledge_points", F.when(F.col("revised_status").isNull(), F.col("knowledge_points")).otherwise(F.col("_points")))
    out = out.withColumn("_m", first_match(MAPPING))
    return out.select(*place, F.col("_m.rank").alias("rank"), F.col("_m.status").alias("status"), F.col("_m.reason").alias("reason"), F.when(F.col("_m.status") == "pass", F.col("knowledge_points")).alias("knowledge_points"))


def question_scope(questions: DataFrame, judged: DataFrame) -> DataFrame:
    """id, status and reasons (in order, each once) of each question: fail if some mapping fails, else pass if one passes, else unsupported."""
    has = lambda s: F.max((F.col("status") == s).cast("int"))
    per = judged.groupBy("question_id").agg(has("fail").alias("_f"), has("pass").alias("_p"), F.array_sort(F.collect_set(F.when(F.col("reason") != "", F.col("reason")))).alias("reasons"))
    out = questions.select("id").join(per.withColumnRenamed("question_id", "id"), "id", "left")
    status = F.when(F.col("_f") == 1, "fail").when(F.col("_p") == 1, "pass").otherwise("unsupported")
    return out.select("id", status.alias("status"), F.coalesce("reasons", F.array(F.lit(UNMAPPED))).alias("reasons"))
