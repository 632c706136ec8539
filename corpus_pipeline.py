"""The corpus pipeline: language ID, line dedup, near-duplicate removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All stages but the last return docs'
own columns, whatever others those are beside doc_id, text, lang and source. Empty tables give empty tables in every stage. Long texts are
taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.jaccard import text_components
from attestra.llm.langid import fit, identify
from attestra.llm.lines import dedup_lines
from attestra.llm.mixing import genre, mix_to_targets
from attestra.llm.packing import pack_documents
from attestra.llm.shared import unused, written
from attestra.llm.tokens import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model (fitted on its own input) rejects go: null or letterless texts, and texts whose score or familiarity is below
    the calibrated limits. Rows that repeat an id or have none are judged by their texts; of a table without labels, nothing is left."""
    added = ["lang_pred", "lang_score", "lang_rejected"]
    if _clash(docs, added):
        return _renamed(spark, docs, added, sf_dir, language_id)
    return identify(docs, fit(docs)).where(~F.col("lang_rejected")).select(*(F.col(f"`{c}`") for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines they share with two documents or more; documents that only consisted of such lines go. n_chars follows. Rows
    that repeat an id are one document; rows with a null id, and null or empty texts, stay as they are."""
    added = ["n_lines", "n_dropped", "kept_text"]
    if _clash(docs, added):
        return _renamed(spark, docs, added, sf_dir, line_dedup)
    out = dedup_lines(docs).where((F.col("n_dropped") == 0) | (F.length("kept_text") > 0))
    changed = {"text": F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of links, the document of the smallest id stays. Rows with a null id go if a document with an id is in their component.
    Rows that repeat id and text are one; rows that repeat an id with texts of different components are documents of their own. Null,
    empty and wordless texts link with nothing and stay."""
    mine, its = unused(docs, "doc", "hash")
    found = written(text_components(docs), "near")
    gone = found.where(F.col("component_id").isNotNull() & (F.col("doc_id").isNull() | (F.col("component_id") != F.col("doc_id")))).select(F.col("doc_id").alias(mine), F.col("th").alias(its)).distinct()
    out = docs.withColumn("_".join([its, "text"]), F.xxhash64("text"))
    key = out.columns[-1]
    left = out.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(mine)) & (F.col(key) == F.col(its)), "left_anti")
    if not found.groupBy("doc_id", "th").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["doc_id", key])
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that token shares of sources, languages and topics have their targets. Null categories are one category of their
    own; null and empty texts weigh nothing; rows that repeat an id stay or go together."""
    added = ["tokens", "probability", "kept", "mix_source", "mix_lang", "mix_topic", "targets", "targets_off"]
    if _clash(docs, added):
        return _renamed(spark, docs, added, sf_dir, source_mix)
    margins = {"source": (F.col("source"), 0.7), "lang": (F.col("lang"), 0.9), "topic": (genre(F.col("text"), F.col("tokens")), 1.0)}
    return mix_to_targets(docs, margins).where("kept").select(*(F.col(f"`{c}`") for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, row by row, and their places in sequences of 1024 ids. A null or empty text is an end id."""
    return pack_documents(docs, vocabulary(), capacity=1024, end_id=2)


def _clash(docs: DataFrame, added: list[str]) -> bool:
    return any(c.lower() in added for c in docs.columns)


def _renamed(spark: SparkSession, docs: DataFrame, added: list[str], sf_dir: str, stage) -> DataFrame:
    """The stage over docs while its columns with names that the stage adds have others."""
    clashing = [c for c in docs.columns if c.lower() in added]
    free = dict(zip(clashing, unused(docs, *(f"own_{c}" for c in clashing)), strict=True))
    return stage(spark, docs.withColumnsRenamed(free), sf_dir).withColumnsRenamed({new: old for old, new in free.items()})


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("packing", packing)]

#: Language ID and packing are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
