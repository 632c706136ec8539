"""Input snapshots: one hash of everything that an item's evidence rests on, when it is stale, and what that voids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import closure


def input_hashes(items: DataFrame, key: str, sets: Mapping[str, tuple[DataFrame, Sequence[str]]], schema: str = "input-v1") -> DataFrame:
    """key, input_hash: SHA-256 of the JSON of the item's row (`item`), its rows in each set (key, name -> (rows, order)) and the schema's name,
    all names sorted, rows by their order. Sets are aggregated before they meet the items, so no set's rows are shuffled twice."""
    out = items.select(F.col(key), F.struct(*(F.col(c) for c in sorted(items.columns))).alias("item"))
    for name, (rows, order) in sets.items():
        values = [c for c in rows.columns if c != key]
        first = F.array_sort(F.collect_list(F.struct(*order, F.struct(*sorted(values)).alias("_row"))))
        out = out.join(rows.groupBy(key).agg(F.transform(first, lambda s: s["_row"]).alias(name)), key, "left")
        kind = rows.select(F.array(F.struct(*sorted(values)))).schema[0].dataType
        out = out.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    payload = F.struct(*(F.lit(schema).alias("schema") if c == "schema" else F.col(c) for c in sorted(["item", "schema", *sets])))
    return out.select(key, F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}), 256).alias("input_hash"))


#: Jackson writes these control characters with capital digits, the canonical form with small ones.
_CAPITALS = "ABCDEF"


def canonical(value: Column) -> Column:
    """The canonical JSON of a struct, array or map of whole numbers, texts and booleans: names sorted by the caller, no white space, nulls kept, other than
    ASCII characters as they are."""
    out = F.to_json(value, {"ignoreNullFields": "false"})
    lowered = out
    for digit in _CAPITALS:
        lowered = F.regexp_replace(lowered, rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}")
    return F.when(out.rlike(r"\\u00[01][A-F]"), lowered).otherwise(out)


def snapshot(items: DataFrame, key: str, item_name: str, sets: Mapping[str, tuple[DataFrame, Sequence[str]]], schema: str, schema_name: str = "snapshot_schema") -> DataFrame:
    """key, input_hash and set_hashes (map: the item's and each set's own hash).

    input_hash is the SHA-256 of the canonical JSON of all: the item's row under item_name, the rows of each set (name -> (rows with the key, order)) in
    their order and without the key, and the schema. Each level is kept: a set's hash says which one changed when the whole did.
    """
    out = items.select(F.col(key).alias("_key"), F.struct(*(F.col(c) for c in sorted(items.columns))).alias(item_name))
    for name, (rows, order) in sets.items():
        values = sorted(c for c in rows.columns if c != key)
        ordered = F.array_sort(F.collect_list(F.struct(*order, F.struct(*values).alias("_row"))))
        out = out.join(rows.groupBy(F.col(key).alias("_key")).agg(F.transform(ordered, lambda s: s["_row"]).alias(name)), "_key", "left")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(rows.select(F.array(F.struct(*values))).schema[0].dataType)))
    parts = sorted([item_name, *sets])
    payload = F.struct(*(F.lit(schema).alias(c) if c == schema_name else F.col(c) for c in sorted([*parts, schema_name])))
    hashes = F.map_from_arrays(F.array(*map(F.lit, parts)), F.array(*(F.sha2(canonical(F.col(c)), 256) for c in parts)))
    return out.select(F.col("_key").alias(key), F.sha2(canonical(payload), 256).alias("input_hash"), hashes.alias("set_hashes"))


def refreshed_snapshot(old: DataFrame, touched: DataFrame, items: DataFrame, key: str, item_name: str, sets: Mapping[str, tuple[DataFrame, Sequence[str]]], schema: str) -> DataFrame:
    """The snapshots after a change: key, input_hash, set_hashes, revision and changed (the names of the sets that did; null: not looked at).

    old: key, input_hash, set_hashes, revision. Only rows of touched keys (key) are read on from items and sets: filters before any aggregation. Touched keys
    without an item lose their snapshot; new ones begin at revision 1; others count up where the hash changed.
    """
    keys = touched.select(key).distinct()
    near = lambda df: df.join(keys, key, "left_semi")
    fresh = snapshot(near(items), key, item_name, {n: (near(rows), order) for n, (rows, order) in sets.items()}, schema)
    both = fresh.join(old.select(key, F.col("input_hash").alias("_was"), F.col("set_hashes").alias("_sets"), "revision"), key, "left")
    differ = F.filter(F.array_sort(F.map_keys("set_hashes")), lambda k: ~F.try_element_at(F.col("_sets"), k).eqNullSafe(F.try_element_at(F.col("set_hashes"), k)))
    same = F.coalesce(F.col("_was") == F.col("input_hash"), F.lit(False))
    now = both.select(key, "input_hash", "set_hashes", F.when(same, F.col("revision")).otherwise(F.coalesce(F.col("revision") + 1, F.lit(1))).alias("revision"), differ.alias("changed"))
    return old.join(keys, key, "left_anti").select(key, "input_hash", "set_hashes", "revision", F.lit(None).cast("array<string>").alias("changed")).unionByName(now)


def file_reasons(documents: DataFrame, files: DataFrame) -> DataFrame:
    """documents with actual_hash (of the file's bytes) and reason, null where it may count: question_source_not_trusted, question_source_intake_hashes_not_matched,
    question_source_missing or question_source_hash_mismatch.

    documents: relative_path, file_hash, trusted_source, intake_manifest_json. files: path and content, as binaryFile reads them; a file is hashed where it is read, and its
    bytes are not shuffled.
    """
    hashed = files.select(F.col("path").alias("relative_path"), F.sha2("content", 256).alias("actual_hash"))
    out = documents.join(hashed, "relative_path", "left")
    matched = F.coalesce(F.get_json_object("intake_manifest_json", "$.hashes_match") == "true", F.lit(False))
    reason = F.when(~F.coalesce(F.col("trusted_source") == 1, F.lit(False)), "question_source_not_trusted").when(~matched, "question_source_intake_hashes_not_matched").when(F.col("actual_hash").isNull(), "question_source_missing")
    return out.withColumn("reason", reason.when(~F.coalesce(F.lower("file_hash") == F.col("actual_hash"), F.lit(False)), "question_source_hash_mismatch"))


def refreshed(snapshots: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """key, input_hash, revision, invalidated after a refresh: new items begin at revision 1, others keep theirs and are valid again."""
    old = snapshots.select(key, "revision")
    return fresh.join(old, key, "left").select(key, "input_hash", F.coalesce("revision", F.lit(1)).alias("revision"), F.lit(False).alias("invalidated"))


def stale(snapshots: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """key, reason of the items whose evidence no longer counts: input_missing, snapshot_missing, snapshot_invalidated or input_changed."""
    both = snapshots.select(key, F.col("input_hash").alias("_was"), F.col("invalidated").alias("_bad")).join(fresh.select(key, F.col("input_hash").alias("_is")), key, "full")
    reason = F.when(F.col("_is").isNull(), "input_missing").when(F.col("_was").isNull(), "snapshot_missing").when(F.coalesce("_bad", F.lit(True)), "snapshot_invalidated").when(F.lower("_was") != F.lower("_is"), "input_changed")
    return both.select(key, reason.alias("reason")).where("reason IS NOT NULL")


def cascade(voided: DataFrame, key: str, dependants: Sequence[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """table, id of every row that a voided item takes with it, however many steps away: each dependant is (table, rows, id, key of what it rests on), in
    any order; rows may rest on the items or on rows of any dependant. Ids of all of them are one space of strings here; `closure.reached` keeps tables apart."""
    text = lambda c: F.col(c).cast("string")
    edges = None
    for name, rows, own, on in dependants:
        part = rows.select(F.lit("").alias("kind"), text(on).alias("id"), F.lit("").alias("to_kind"), text(own).alias("to_id"), F.lit(name).alias("table"))
        edges = part if edges is None else edges.unionByName(part)
    gone = closure.reached(voided.select(F.lit("").alias("kind"), text(key).alias("id"), text(key).alias("cause")), edges.drop("table")).select(F.col("id").alias("_gone"))
    return edges.join(gone, F.col("id") == F.col("_gone")).select("table", F.col("to_id").alias("id")).distinct()


def approval_lock(items: DataFrame, key: str, approved: str, quorum: DataFrame) -> DataFrame:
    """Approved items without a quorum of current passes (quorum: key, quorum)."""
    return items.where(F.col(approved)).join(quorum.where("quorum"), key, "left_anti").select(key)
