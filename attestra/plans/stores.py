"""Queries over what lies in stores: word-processing packages that tasks write from the driver's tables and the data source reads back, and views that are kept up to date
from ledgers."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..operators import deltas
from ..operators.deltas import Ledger, Must, View
from ..operators.tables import work_folder, written
from ..sources import documents, packages
from .catalogue import query, table
from .evidence import _LINES, INPUTS, made, twin

_NAMES = 'xmlns:w="{}" xmlns:r="{}" xmlns:a="{}"'.format(*(x[1:-1] for x in (documents.W, documents.R, documents.A)))
_IMAGE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/image"


def _package(key: int, name: str) -> bytes:
    """A supplier's package: its name, then an image in the body, a cell, a header and outside, as its key's divisors say."""
    blip = lambda i: f'<w:p><w:r><w:drawing><a:blip r:embed="{i}"/></w:drawing></w:r></w:p>'
    body = f"<w:p><w:r><w:t>{name}</w:t></w:r></w:p>" + blip("own") + f"<w:tbl><w:tr><w:tc>{blip('cell')}</w:tc></w:tr></w:tbl>" * (key % 3 == 0) + blip("far") * (key % 7 == 0) + blip("none") * (key % 11 == 0)
    relation = lambda i, target, mode="": f'<Relationship Id="{i}" Type="{_IMAGE}" Target="{target}"{mode}/>'
    relations = lambda *r: '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(r) + "</Relationships>"
    parts = {
        "[Content_Types].xml": "<Types/>",
        "word/document.xml": f"<w:document {_NAMES}><w:body>{body}</w:body></w:document>",
        "word/_rels/document.xml.rels": relations(relation("own", "media/own.png"), relation("cell", "media/cell.png"), relation("far", "https://example.test/far.png", ' TargetMode="External"')),
        "word/header1.xml": f"<w:hdr {_NAMES}>{blip('top')}</w:hdr>",
        "word/_rels/header1.xml.rels": relations(relation("top", "/word/media/own.png")),
        "word/media/own.png": name,
    }
    if key % 5:
        parts["word/media/cell.png"] = f"cell {key}"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for part, data in parts.items():
            z.writestr(part, data)
    return out.getvalue() if key % 17 else b"no package"


def _write(folder: str):
    def batches(frames):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for frame in frames:
            for key, name in zip(frame["s_suppkey"], frame["s_name"], strict=True):
                part = f"{base}/{key}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(_package(key, name))
                store.move(part, f"{base}/{key}.docx")  # retries replace each other
            yield pd.DataFrame({"n": [len(frame)]})

    return batches


def _packages(spark, sf_dir: str) -> str:
    """The folder of a package a supplier."""
    root = work_folder(spark)
    folder = f"{root if '://' in root else 'file://' + os.path.abspath(root.removeprefix('file:'))}/attestra-engine/packages-{uuid.uuid4().hex}"
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").mapInPandas(_write(folder), "n long").agg(F.sum("n")).collect()
    return folder


def _key():
    return F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("long").alias("s_suppkey")


@query("""WITH s AS (SELECT * FROM supplier WHERE s_suppkey % 17 <> 0),
    v AS (SELECT * FROM (VALUES ('own', 'body_paragraph', 1, 1), ('cell', 'table_cell', NULL, 3), ('far', 'body_paragraph', 2, 7), ('none', 'body_paragraph', NULL, 11), ('top', 'header', NULL, 1)) AS t(relationship_id, host_kind, place, every))
    SELECT s_suppkey, relationship_id, host_kind, CASE WHEN relationship_id = 'none' THEN 2 + CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END ELSE place END AS paragraph_index,
    CASE relationship_id WHEN 'far' THEN 'external_target' WHEN 'none' THEN 'missing_relationship' WHEN 'cell' THEN CASE WHEN s_suppkey % 5 = 0 THEN 'missing_media_part' ELSE 'resolved_internal' END ELSE 'resolved_internal' END AS relationship_status,
    CASE WHEN relationship_id IN ('own', 'top') THEN sha256(s_name) WHEN relationship_id = 'cell' AND s_suppkey % 5 <> 0 THEN sha256('cell ' || s_suppkey) END AS media_sha256
    FROM s JOIN v ON s_suppkey % every = 0""")
def package_images(spark, sf_dir):
    """Every reference to an image in the suppliers' packages, and where it leads."""
    columns = "path string, kind string, relationship_id string, host_kind string, paragraph_index int, relationship_status string, media_sha256 string"
    got = packages.read_packages(spark, _packages(spark, sf_dir), columns, ["image"]).where("kind = 'image'")
    return got.select(_key(), "relationship_id", "host_kind", "paragraph_index", "relationship_status", "media_sha256")


@query("""SELECT s_suppkey, 'problem' AS kind, NULL AS text, NULL AS media_path, NULL AS media_bytes, 'invalid_docx' AS problem FROM supplier WHERE s_suppkey % 17 = 0
    UNION ALL SELECT s_suppkey, 'paragraph', s_name, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 17 <> 0
    UNION ALL SELECT s_suppkey, 'media', NULL, 'word/media/cell.png', length('cell ' || s_suppkey), NULL FROM supplier WHERE s_suppkey % 17 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 3 <> 0""")
def package_inventory(spark, sf_dir):
    """Paragraphs, media that no image shows (left by an anti join within the package; no media is opened) and packages that cannot be read."""
    rows = packages.read_packages(spark, _packages(spark, sf_dir), "path string, kind string, text string, media_path string, media_bytes long, problem string")
    shown = rows.where("kind = 'image' AND media_path IS NOT NULL").select("path", "media_path")
    unused = rows.where("kind = 'media'").join(shown, ["path", "media_path"], "left_anti")
    return rows.where("kind IN ('paragraph', 'problem')").unionByName(unused.select(rows.columns)).select(_key(), "kind", "text", "media_path", "media_bytes", "problem")


#: Ledgers of revisions (an order's lines in turn), parts, brands and suppliers' blocks, and which of their rows came last.
INPUTS |= {
    "line_ledger": f"SELECT l_orderkey AS item, CAST(l_linenumber AS INT) AS version, l_partkey AS part, l_suppkey AS supplier, l_returnflag AS flag FROM {_LINES}",
    "part_ledger": "SELECT p_partkey AS part, 0 AS version, p_brand AS brand, CASE WHEN p_size > 40 THEN 'dead' ELSE 'live' END AS status FROM {part} UNION ALL SELECT p_partkey, 1, p_brand, CASE WHEN p_size > 40 THEN 'live' ELSE 'dead' END FROM {part} WHERE p_partkey % 50 = 0",
    "brand_ledger": "SELECT p_brand AS brand, 0 AS version, p_brand NOT LIKE '%1' AS open FROM {part} GROUP BY p_brand UNION ALL SELECT p_brand, 1, p_brand LIKE '%11' FROM {part} WHERE p_brand LIKE '%11' OR p_brand LIKE '%32' GROUP BY p_brand",
    "block_ledger": "SELECT l_suppkey AS supplier, 0 AS version, l_suppkey % 5 = 0 AS holds FROM {lineitem} GROUP BY l_suppkey UNION ALL SELECT l_suppkey, 1, l_suppkey % 4 = 0 FROM {lineitem} WHERE l_suppkey % 10 < 2 GROUP BY l_suppkey",
}
_LEDGERS = ("line_ledger", "part_ledger", "brand_ledger", "block_ledger")
_CAME = {n: "version > 5 AND item % 10 = 0" if n == "line_ledger" else "version = 1" for n in _LEDGERS}
_LINES_VIEW = View(
    Ledger("line_ledger", ("item",), ("version",)),
    "flag <> 'R'",
    (
        Must(View(Ledger("part_ledger", ("part",), ("version",)), "status = 'live'", (Must(View(Ledger("brand_ledger", ("brand",), ("version",)), "open"), {"brand": "brand"}),)), {"part": "part"}),
        Must(View(Ledger("block_ledger", ("supplier",), ("version",)), "holds"), {"supplier": "supplier"}, absent=True),
    ),
)


def _stands(name: str, but: bool) -> str:
    """What stands, of all rows or of all but those that came last."""
    last = lambda n, key: f"(SELECT * FROM {n} WHERE {f'NOT ({_CAME[n]})' if but else 'true'} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY version DESC) = 1)"
    parts, brands, blocks = last("part_ledger", "part"), last("brand_ledger", "brand"), last("block_ledger", "supplier")
    return f"{name} AS (SELECT i.* FROM {last('line_ledger', 'item')} i JOIN {parts} p ON p.part = i.part AND p.status = 'live' JOIN {brands} b ON b.brand = p.brand AND b.open WHERE i.flag <> 'R' AND i.supplier NOT IN (SELECT supplier FROM {blocks} WHERE holds))"


def _ledger_changes(spark, sf_dir):
    """(what stood, what the batch changes)"""
    # Every step reads the ledgers: they are stored, not grouped anew for each.
    whole = {n: written(t, n) for n, t in zip(_LEDGERS, made(spark, sf_dir, *_LEDGERS), strict=True)}
    before, batch = {n: t.where(f"NOT ({_CAME[n]})") for n, t in whole.items()}, {n: t.where(_CAME[n]) for n, t in whole.items()}
    state = written(deltas.standing(_LINES_VIEW, before), "state")
    return state, deltas.changes(_LINES_VIEW, state, before, batch)


@query(twin(_LEDGERS, _stands("was", True), _stands("is_now", False), "SELECT *, 1 AS sign FROM (SELECT * FROM is_now EXCEPT SELECT * FROM was) UNION ALL SELECT *, -1 FROM (SELECT * FROM was EXCEPT SELECT * FROM is_now)"))
def ledger_changes(spark, sf_dir):
    """What a batch of new rows in four ledgers changes in a view over them: signed rows, from the touched keys alone."""
    return _ledger_changes(spark, sf_dir)[1]


@query(twin(_LEDGERS, _stands("is_now", False), "SELECT * FROM is_now"))
def ledger_view(spark, sf_dir):
    """The view after that batch: what stood and what changed, summed."""
    state, changed = _ledger_changes(spark, sf_dir)
    return deltas.current(state.withColumn("sign", F.lit(1)).unionByName(changed))
