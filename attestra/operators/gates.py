"""Verification quorum, admission, review and eligibility gates. Anything missing or unknown is not eligible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import latest_per_key


def quorum(log: DataFrame, item: str, kind: str, status: str, required: Sequence[str], order: Sequence[str]) -> DataFrame:
    """item, n_pass (distinct required kinds whose latest row passes), n_nonpass, quorum."""
    now = latest_per_key(log.where(F.col(kind).isin(*required)), [item, kind], order, [status])
    passed = F.count_if(F.col(status) == "pass")
    return now.groupBy(item).agg(passed.alias("n_pass"), F.count_if(F.coalesce(F.col(status) != "pass", F.lit(True))).alias("n_nonpass")).withColumn("quorum", (F.col("n_pass") == len(required)) & (F.col("n_nonpass") == 0))


def admission(log: DataFrame, item: str, kind: str, status: str, required: Sequence[str], order: Sequence[str], snapshots: DataFrame | None = None, input_hash: str = "input_hash") -> DataFrame:
    """item, missing, blockers (sorted arrays), eligible.

    missing: required kinds whose latest row is not a pass (of the item's current input hash, where snapshots are given:
    item, input_hash, live_hash, invalidated). blockers: any kind whose latest row is fail or unsupported, or is of another hash;
    `input_snapshot` where the snapshot is absent, invalidated or no longer hashes to its value, and then all kinds are missing.
    """
    values = [status] + ([input_hash] if snapshots is not None else [])
    now = latest_per_key(log, [item, kind], order, values)
    stale = F.lit(False)
    if snapshots is not None:
        now = now.join(snapshots.select(item, F.col(input_hash).alias("_hash")), item, "full")
        stale = ~F.coalesce(F.lower(input_hash) == F.lower("_hash"), F.lit(False))
    good = F.coalesce((F.col(status) == "pass") & ~stale, F.lit(False))
    bad = F.col(kind).isNotNull() & (F.col(status).isin("fail", "unsupported") | stale)
    out = now.groupBy(item).agg(F.collect_set(F.when(good, F.col(kind))).alias("_passed"), F.collect_set(F.when(bad, F.col(kind))).alias("blockers"))
    wanted = F.array(*(F.lit(k) for k in sorted(required)))
    out = out.withColumns({"missing": F.array_sort(F.array_except(wanted, "_passed")), "blockers": F.array_sort("blockers")})
    if snapshots is not None:
        live = F.coalesce(~F.col("invalidated") & (F.lower(input_hash) == F.lower("live_hash")), F.lit(False))
        out = out.join(snapshots.select(item, live.alias("_live")), item, "left").withColumn("_live", F.coalesce("_live", F.lit(False)))
        out = out.withColumns({"missing": F.when(F.col("_live"), F.col("missing")).otherwise(wanted), "blockers": F.when(F.col("_live"), F.col("blockers")).otherwise(F.array(F.lit("input_snapshot")))}).drop("_live")
    return out.select(item, "missing", "blockers", ((F.size("missing") == 0) & (F.size("blockers") == 0)).alias("eligible"))


def review_quorum(reviews: DataFrame, item: str, kind: str, decision: str, required: Sequence[str]) -> DataFrame:
    """item, missing (required types whose decisions are not exactly {approved}), blocking (types with a rejection or a wish for revision), approved."""
    per = reviews.groupBy(item, kind).agg(F.collect_set(decision).alias("_set"))
    clean = F.size("_set") == 1
    clean = clean & (F.element_at("_set", 1) == "approved")
    out = per.groupBy(item).agg(F.collect_set(F.when(clean, F.col(kind))).alias("_ok"), F.array_sort(F.collect_set(F.when(F.arrays_overlap("_set", F.array(F.lit("rejected"), F.lit("needs_revision"))), F.col(kind)))).alias("blocking"))
    out = out.withColumn("missing", F.array_sort(F.array_except(F.array(*(F.lit(k) for k in required)), "_ok")))
    return out.select(item, "missing", "blocking", ((F.size("missing") == 0) & (F.size("blocking") == 0)).alias("approved"))


def first_reason(pairs: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """The first code whose condition holds."""
    out = F.lit(otherwise)
    for code, cond in reversed(pairs):
        out = F.when(F.coalesce(cond, F.lit(False)), F.lit(code)).otherwise(out)
    return out


def eligibility(items: DataFrame, key: str, math: DataFrame, knowledge: DataFrame, difficulty: DataFrame) -> DataFrame:
    """key, content_eligible, reason: the first of three kinds of evidence that is missing."""
    out = items
    for flag, evidence in (("_m", math), ("_k", knowledge), ("_d", difficulty)):
        out = out.join(evidence.select(F.col(key)).distinct().withColumn(flag, F.lit(True)), key, "left")
    reason = first_reason([("mathematical_validation_missing_or_nonpassing", F.col("_m").isNull()), ("validated_primary_knowledge_mapping_missing", F.col("_k").isNull()), ("validated_difficulty_evidence_missing", F.col("_d").isNull())], "eligible_for_content_selection_only")
    return out.select(key, (F.col("_m").isNotNull() & F.col("_k").isNotNull() & F.col("_d").isNotNull()).alias("content_eligible"), reason.alias("reason"))


def all_and_complete(parents: DataFrame, children: DataFrame, key: str, good: Column, expected: str) -> DataFrame:
    """Parents with at least one child, none that is not good, and as many as `expected` says."""
    per = children.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.bool_and(F.coalesce(good, F.lit(False))).alias("_all"))
    return parents.join(per, key).where(F.col("_all") & (F.col("_n") == F.col(expected))).drop("_n", "_all")


def fold_by_precedence(rows: DataFrame, key: str, outcome: str, order: Sequence[str]) -> DataFrame:
    """key, outcome: the most severe one of its rows; order goes from most to least severe, and unknown outcomes are most severe of all."""
    rank = F.coalesce(F.element_at(F.create_map(*(x for i, o in enumerate(order) for x in (F.lit(o), F.lit(i)))), F.col(outcome)), F.lit(-1))
    worst = rows.groupBy(key).agg(F.min(rank).alias("_r"))
    return worst.select(key, F.when(F.col("_r") < 0, F.lit("unknown")).otherwise(F.element_at(F.array(*(F.lit(o) for o in order)), F.greatest(F.col("_r"), F.lit(0)) + 1)).alias(outcome))


def fold_outcomes(rows: DataFrame, key: str, outcome: str, loss: str, acceptable: str, not_comparable: str, equal: str) -> DataFrame:
    """key, outcome of its checks: loss if there is any; not_comparable if all are; else acceptable, then not_comparable, if there is any; else equal."""
    is_ = lambda x: F.coalesce(F.col(outcome) == x, F.lit(False))
    told = F.when(F.bool_or(is_(loss)), loss).when(F.bool_and(is_(not_comparable)), not_comparable).when(F.bool_or(is_(acceptable)), acceptable).when(F.bool_or(is_(not_comparable)), not_comparable).otherwise(equal)
    return rows.groupBy(key).agg(told.alias(outcome))


def status_sets(rows: DataFrame, item: str, kind: str, status: str, required: Sequence[str]) -> DataFrame:
    """item, kind, verdict, conflicting for each required kind: missing without rows, pass if all pass, unsupported before fail before nonpass."""
    per = rows.groupBy(item, kind).agg(F.collect_set(status).alias("_set"))
    wanted = rows.select(item).distinct().select(item, F.explode(F.array(*(F.lit(k) for k in required))).alias(kind))
    out = wanted.join(per, [item, kind], "left")
    has = lambda x: F.array_contains(F.col("_set"), x)
    n = F.coalesce(F.size("_set"), F.lit(0))
    verdict = F.when(n < 1, "missing").when((n == 1) & has("pass"), "pass").when(has("unsupported"), "unsupported").when(has("fail"), "fail").otherwise("nonpass")
    return out.select(item, kind, verdict.alias("verdict"), (n > 1).alias("conflicting"))


def applied(eligible: Column) -> Column:
    """struct<quality_status, review_status> that an admission gives: anything but eligible is isolated."""
    sure = F.coalesce(eligible, F.lit(False))
    return F.struct(F.when(sure, "approved").otherwise("blocked").alias("quality_status"), F.when(sure, "approved").otherwise("pending").alias("review_status"))
