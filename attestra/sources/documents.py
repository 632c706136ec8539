"""Document files as rows: intake checks, DOCX blocks and media, JSON manifests and JSON lines."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Parts without which a package is no word-processing document.
REQUIRED = ("[Content_Types].xml", "word/document.xml")


def _rows(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]))


def files(spark: SparkSession, path: str | list[str], recursive: bool = True) -> DataFrame:
    """path, length, extension, sha256 (lower case) and content of each file."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return df.select("path", "length", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), F.sha2("content", 256).alias("sha256"), "content")


def paragraphs(content: bytes) -> list[tuple[int, str, list[str]]]:
    """(index, text, relationship ids of its images) of each paragraph, tables included, in order; math text is kept in place."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for i, p in enumerate(root.iter(f"{W}p")):
        parts = []
        for e in p.iter():
            if e.tag in (f"{W}t", f"{M}t"):
                parts.append(e.text or "")
            elif e.tag == f"{W}tab":
                parts.append("\t")
            elif e.tag in (f"{W}br", f"{W}cr"):
                parts.append("\n")
        out.append((i, "".join(parts), [e.get(f"{R}embed") for e in p.iter(f"{A}blip") if e.get(f"{R}embed")]))
    return out


def media(content: bytes) -> list[tuple[int, str, str | None, str, str | None]]:
    """(paragraph, relationship, part, status, sha256) of each image; status: resolved, external, missing_relationship or missing_part."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        rels = {}
        if "word/_rels/document.xml.rels" in names:
            for e in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")):
                rels[e.get("Id")] = (e.get("Target"), e.get("TargetMode"))
        out = []
        for i, _, ids in paragraphs(content):
            for r in ids:
                target, mode = rels.get(r, (None, None))
                part = posixpath.normpath(posixpath.join("word", target)).lstrip("/") if target and not target.startswith("/") else (target or "").lstrip("/")
                if target is None:
                    out.append((i, r, None, "missing_relationship", None))
                elif mode == "External":
                    out.append((i, r, target, "external", None))
                elif part not in names:
                    out.append((i, r, part, "missing_part", None))
                else:
                    out.append((i, r, part, "resolved", hashlib.sha256(z.read(part)).hexdigest()))
        return out


def _safe(f, content: bytes | None):
    try:
        return f(content) if content is not None else []
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []


@F.pandas_udf(_rows(ordinal=T.IntegerType(), raw_text=T.StringType(), images=T.ArrayType(T.StringType())))
def _blocks(content: pd.Series) -> pd.Series:
    return content.map(lambda c: [dict(zip(("ordinal", "raw_text", "images"), b, strict=True)) for b in _safe(paragraphs, c)])


@F.pandas_udf(_rows(paragraph=T.IntegerType(), relationship=T.StringType(), part=T.StringType(), status=T.StringType(), sha256=T.StringType()))
def _media(content: pd.Series) -> pd.Series:
    return content.map(lambda c: [dict(zip(("paragraph", "relationship", "part", "status", "sha256"), m, strict=True)) for m in _safe(media, c)])


@F.pandas_udf(T.StringType())
def _package(content: pd.Series) -> pd.Series:
    def check(c: bytes) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(c)) as z:
                return None if all(p in z.namelist() for p in REQUIRED) else "missing_docx_parts"
        except zipfile.BadZipFile:
            return "invalid_docx"

    return content.map(check)


def docx_blocks(docs: DataFrame) -> DataFrame:
    """path, ordinal, raw_text, images, block_sha256 of the paragraphs with text or images."""
    b = docs.select("path", F.explode(_blocks("content")).alias("b")).select("path", "b.*")
    return b.where((F.trim("raw_text") != "") | (F.size("images") > 0)).withColumn("block_sha256", F.sha2("raw_text", 256))


def docx_media(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.explode(_media("content")).alias("m")).select("path", "m.*")


def intake(docs: DataFrame, root: str, archive: DataFrame | None = None) -> DataFrame:
    """path, sha256, reasons (sorted), accepted; approved is always false. archive: path, sha256 of the trusted copies."""
    out = docs.withColumn("_pkg", F.when(F.col("extension") == "docx", _package("content")))
    if archive is not None:
        out = out.join(archive.select("path", F.col("sha256").alias("_arch")), "path", "left")
    checks = {"path_outside_root": ~F.startswith("path", F.lit(root)) | F.contains("path", F.lit("/../"))}
    named = [F.when(c, F.lit(k)) for k, c in checks.items()] + [F.col("_pkg")]
    if archive is not None:
        named.append(F.when(F.col("_arch").isNull(), "archive_missing").when(F.lower("_arch") != F.lower("sha256"), "archive_hash_mismatch"))
    reasons = F.array_sort(F.filter(F.array(*named), lambda x: x.isNotNull()))
    return out.select("path", "length", "extension", "sha256", reasons.alias("reasons")).withColumns({"accepted": F.size("reasons") == 0, "approved": F.lit(False)})


def json_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, manifest_sha256 (of the raw bytes) and body of one JSON object a file; a byte order mark is no part of the body."""
    df = spark.read.format("binaryFile").load(path)
    return df.select("path", F.sha2("content", 256).alias("manifest_sha256"), F.regexp_replace(F.col("content").cast("string"), "^﻿", "").alias("body"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Well-formed lines only."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def todo(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a checkpoint of earlier runs has not got yet."""
    return work.join(done.select(*keys), keys, "left_anti")


def is_text_layer(pages: DataFrame, document: str, page: str, text: str, first: int = 3, least: int = 50) -> DataFrame:
    """document, mean_chars, kind: text if the first pages have `least` characters on average, else scanned."""
    some = pages.where(F.col(page) <= first).groupBy(document).agg(F.avg(F.length(F.coalesce(text, F.lit("")))).alias("mean_chars"))
    return some.withColumn("kind", F.when(F.col("mean_chars") >= least, "text").otherwise("scanned"))


def markdown(items: DataFrame, document: str, order: str, stem: str, options: str | None = None) -> DataFrame:
    """document and its Markdown: numbered items, options as a list."""
    line = F.concat(F.col(order).cast("string"), F.lit(". "), F.col(stem))
    if options:
        line = F.concat(line, F.when(F.size(options) > 0, F.concat(F.lit("\n   - "), F.array_join(options, "\n   - "))).otherwise(""))
    rows = items.select(document, F.struct(F.col(order), line.alias("line")).alias("_l"))
    return rows.groupBy(document).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_l")), lambda s: s["line"]), "\n\n").alias("markdown"))


def as_docx(lines: list[str]) -> bytes:
    """A small DOCX of plain paragraphs."""
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{esc(t)}</w:t></w:r></w:p>' for t in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def scores(lines: list[str]) -> list[int]:
    """Points named in numbered lines."""
    return [int(x) for t in lines for x in re.findall(r"[（(](\d+)\s*分[)）]", t)]


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("errorifexists").json(f"{path}/{name}")


def write_manifest(df: DataFrame, path: str) -> str:
    """A report as JSON lines in order, in one folder; returns the number of rows and an order-free hash of all of them."""
    lines = df.select(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}).alias("value"))
    lines.orderBy("value").write.mode("overwrite").text(path)
    n, total = df.sparkSession.read.text(path).agg(F.count(F.lit(1)), F.sum(F.conv(F.substring(F.sha2("value", 256), 1, 15), 16, 10).cast("decimal(38,0)"))).first()
    return f"{n}:{hashlib.sha256(str(total or 0).encode()).hexdigest()}"
