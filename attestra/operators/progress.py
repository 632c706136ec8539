"""Suggested mappings of questions to curriculum nodes, and whether a class's progress allows approved ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.items import label_anchors
from .latest import reasons

_LEAST = 4


def _blank(name: str):
    return F.length(F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))) == 0


def best_anchors(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """question_id, _best (node_id and its confidence c) and _top (the highest two confidences, the higher first), of questions whose text has an
    anchor of a node's name. Confidence is the longest such anchor of a node over five, one at most; of equal ones the smallest node_id is best.

    Questions and nodes share `catalog`. Texts and anchors meet at an anchor's first four characters, so that only pairs with those in common
    are compared; a text goes into the shuffle as its distinct runs of four Chinese characters, and is met again by its hash to check the rest.
    Equal texts are looked at once, and each anchor stands for its two smallest nodes alone: any other is behind these two wherever it is found.
    So rows are linear in texts and names, however many questions share a text or nodes a name.
    """
    grams = F.array_distinct(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - _LEAST + 1, F.lit(1))), lambda i: F.substring("text", i, _LEAST)), lambda g: g.rlike(f"^[一-鿿]{{{_LEAST}}}$")))
    hashed = questions.select("question_id", "catalog", "text", F.sha2("text", 256).alias("_h"))
    texts = hashed.select("catalog", "_h", "text").distinct()
    runs = texts.select("catalog", "_h", F.explode(grams).alias("gram"))
    every = nodes.select("catalog", "node_id", F.explode(label_anchors(F.col("name"), _LEAST)).alias("anchor")).distinct()
    place = F.row_number().over(Window.partitionBy("catalog", "anchor").orderBy("node_id"))
    anchors = every.withColumn("_p", place).where("_p <= 2").select("catalog", "node_id", "anchor", F.substring("anchor", 1, _LEAST).alias("gram"))
    met = runs.join(anchors, ["catalog", "gram"]).select("catalog", "_h", "node_id", "anchor")
    found = met.join(texts, ["catalog", "_h"]).where(F.contains("text", F.col("anchor")))
    scored = found.groupBy("catalog", "_h", "node_id").agg(F.least(F.lit(1.0), F.max(F.length("anchor")) / 5).alias("c"))
    first = F.row_number().over(Window.partitionBy("catalog", "_h").orderBy(F.desc("c"), "node_id"))
    two = scored.withColumn("_p", first).where("_p <= 2").drop("_p")
    each = hashed.select("question_id", "catalog", "_h").join(two, ["catalog", "_h"]).groupBy("question_id", "node_id").agg(F.max("c").alias("c"))
    return each.groupBy("question_id").agg(F.min_by(F.struct("node_id", "c"), F.struct(-F.col("c"), "node_id")).alias("_best"), F.slice(F.sort_array(F.collect_list("c"), asc=False), 1, 2).alias("_top"))


def suggest_mapping(questions: DataFrame, nodes: DataFrame, least: float = 0.75, margin: float = 0.15) -> DataFrame:
    """question_id, status (candidate or isolated), node_id, confidence, reasons (sorted).

    questions: question_id, text, textbook_id, catalog; nodes: catalog, node_id, name, textbook_id, catalog_version. Confidence is the longest
    anchor over five, one at most. A question is isolated if a field is missing, its catalog is empty, incomplete or of another textbook, no
    anchor is found, or the best node is not sure enough or too near the next. Nulls count as missing.
    """
    catalogs = nodes.groupBy("catalog").agg(F.min("textbook_id").alias("_low"), F.max("textbook_id").alias("_high"), F.bool_or(_blank("node_id") | _blank("name") | _blank("catalog_version")).alias("_holes"), F.bool_or(F.col("textbook_id").isNull()).alias("_nameless"))
    named = questions.join(catalogs, "catalog", "left")
    none = F.col("_holes").isNull()
    faults = reasons(
        missing_question_id=_blank("question_id"),
        missing_question_text=_blank("text"),
        missing_textbook_id=_blank("textbook_id"),
        no_catalog_nodes=none,
        incomplete_catalog_node=F.col("_holes"),
        cross_textbook_catalog_node=F.col("_nameless") | (~none & ~(F.col("_low").eqNullSafe(F.col("textbook_id")) & F.col("_high").eqNullSafe(F.col("textbook_id")))),
    )
    best = best_anchors(questions, nodes)
    out = named.withColumn("_faults", faults).join(best, "question_id", "left")
    c = F.col("_best.c")
    doubt = F.when(c.isNull(), "no_exact_catalog_anchor").when(c < least, "low_confidence").when(F.get("_top", 0) - F.get("_top", 1) < margin, "ambiguous_top_candidate")
    told = F.when(F.size("_faults") > 0, F.col("_faults")).when(doubt.isNotNull(), F.array(doubt)).otherwise(F.array().cast("array<string>"))
    sure = F.size("reasons") == 0
    return out.withColumn("reasons", told).select("question_id", F.when(sure, "candidate").otherwise("isolated").alias("status"), F.when(sure, F.col("_best.node_id")).alias("node_id"), F.when(sure, c).alias("confidence"), "reasons")


def decide_progress(pairs: DataFrame) -> DataFrame:
    """question_id, class_id, status (within_active_progress or blocked), reasons (sorted): every mapped node must be allowed.

    A row of pairs: question_id, mapping_status, provenance_hash, question_textbook_id, mapped (array), class_id, class_textbook_id,
    current_node, allowed (array). Null and blank node ids do not count.
    """
    real = lambda name: F.filter(F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    met = pairs.withColumns({"_mapped": real("mapped"), "_allowed": real("allowed")})
    why = reasons(
        missing_question_id=_blank("question_id"),
        mapping_not_approved=~F.col("mapping_status").eqNullSafe(F.lit("approved")),
        invalid_mapping_provenance=~F.coalesce(F.col("provenance_hash"), F.lit("")).rlike(r"\A[0-9a-fA-F]{64}\z"),
        missing_mapped_nodes=F.size("_mapped") == 0,
        incomplete_active_progress=_blank("class_id") | _blank("class_textbook_id") | _blank("current_node"),
        current_node_not_allowed=~F.array_contains("_allowed", F.coalesce(F.col("current_node"), F.lit(""))),
        textbook_mismatch=~F.col("question_textbook_id").eqNullSafe(F.col("class_textbook_id")),
        mapped_node_outside_active_progress=F.size(F.array_except("_mapped", "_allowed")) > 0,
    )
    out = met.withColumn("reasons", why)
    return out.select("question_id", "class_id", F.when(F.size("reasons") == 0, "within_active_progress").otherwise("blocked").alias("status"), "reasons")
