"""Word-processing packages as a Python data source: a row a paragraph, an image reference and a stored media file. A package's directory is read
first; of its parts only those that are asked for, and bytes of media only where a wanted column rests on them.

Kinds and parts are options of the read, not pushed filters: Spark keeps what a filter pushed into a Python source for all uses of the same DataFrame, so that a second use with
another filter would lose rows."""

from __future__ import annotations

import hashlib
import posixpath
import re
import zipfile
import zlib
from collections.abc import Collection, Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .documents import M, R, REQUIRED, W

#: kind: paragraph, image, media (a stored file) or problem.
SCHEMA = (
    "path string, kind string, package_part string, host_kind string, host_location string, paragraph_index int, text string, relationship_id string, relationship_target string, "
    "relationship_status string, media_path string, media_bytes long, drawing_layout map<string,string>, media_sha256 string, content binary, problem string"
)
#: The kinds of rows. Problems are always told.
KINDS = ("paragraph", "image", "media")
#: The parts that hold text or images, the kinds of place by part and by what encloses an image, and the names of image elements.
_PART = re.compile(r"word/(document|footnotes|endnotes|comments|header[^/]*|footer[^/]*)\.xml")
_PLACES = {"header": "header", "footer": "footer", "footnotes": "footnote", "endnotes": "endnote", "comments": "comment"}
_INSIDE = {"txbxContent": "textbox", "tc": "table_cell"}
_IMAGES = ("blip", "imagedata")
_RELATION = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
_BROKEN = (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, RuntimeError, NotImplementedError, EOFError)
#: Bytes of media held at once while they are hashed, and of rows before they are handed on.
_STEP, _HELD = 1 << 20, 8 << 20


def opened(uri: str):
    """A seekable binary stream of a local (shared) path or of any file system that pyarrow knows."""
    if uri.startswith("file:") or "://" not in uri:
        return open(re.sub("^file:(//)?(?=/)", "", uri), "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _relations(z: zipfile.ZipFile, part: str, names: set[str]) -> dict[str, tuple[str | None, str | None]]:
    """(target, mode) of a part's relationships to images, by id."""
    where = "{}/_rels/{}.rels".format(*posixpath.split(part))
    if where not in names:
        return {}
    every = ElementTree.fromstring(z.read(where)).iter(_RELATION)
    return {e.get("Id"): (e.get("Target"), e.get("TargetMode")) for e in every if "image" in e.get("Type", "").lower()}


def _told(part: str, relation: tuple[str | None, str | None] | None, names: set[str]) -> dict:
    """What a relationship leads to."""
    target, mode = relation or (None, None)
    out = {"relationship_target": target, "media_path": None}
    if relation is None:
        return out | {"relationship_status": "missing_relationship"}
    if mode == "External":
        return out | {"relationship_status": "external_target"}
    if not target:
        return out | {"relationship_status": "missing_relationship_target"}
    path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(part), target))
    return out | {"media_path": path, "relationship_status": "resolved_internal" if path in names else "missing_media_part"}


def _layout(drawing: ElementTree.Element | None) -> dict[str, str]:
    """What an anchor or inline drawing declares of its place."""
    if drawing is None:
        return {}
    kind = _name(drawing.tag)
    out = {"drawing_kind": kind} | {f"{kind}.@{_name(k)}": v for k, v in drawing.attrib.items()}
    for child in drawing if kind == "anchor" else ():
        way = {"positionH": "horizontal", "positionV": "vertical"}.get(_name(child.tag))
        if way and f"anchor.{way}" not in out:
            said = {"relative_from": child.get("relativeFrom")} | {_name(c.tag): c.text and c.text.strip() for c in child if _name(c.tag) in ("align", "posOffset")}
            out |= {f"anchor.{way}.{k}": v for k, v in said.items() if v is not None}
    return out


def part_rows(stream, part: str, relations: dict, names: set[str], kinds: Collection[str]) -> list[dict]:
    """The paragraphs with text and the image references of a part, in order. The part is read as a stream: a paragraph's elements go when it ends. Text belongs to
    the innermost paragraph around it. paragraph_index counts the body's own paragraphs alone; those in cells, boxes and other parts have none."""
    rows: list[dict] = []
    path: list[dict] = []  # the open elements: name, location, children by name
    paragraphs: list[dict] = []
    waiting: list[tuple[ElementTree.Element | None, dict]] = []
    drawings: list[ElementTree.Element] = []
    body = 0
    fixed = _PLACES.get(re.match(r"word/([a-z]+)", part)[1])
    for event, e in ElementTree.iterparse(stream, ("start", "end")):
        name = _name(e.tag)
        if event == "start":
            seen = path[-1]["children"] if path else {}
            seen[name] = seen.get(name, 0) + 1
            at = f"{path[-1]['at'] if path else ''}/{name}[{seen[name]}]"
            inside = {_INSIDE[p["name"]] for p in path if p["name"] in _INSIDE}
            path.append({"name": name, "at": at, "children": {}})
            place = {"package_part": part, "host_kind": fixed or ("textbox" if "textbox" in inside else "table_cell" if inside else "body_paragraph"), "host_location": at}
            if name == "p":
                own = len(path) == 3 and path[1]["name"] == "body"
                paragraphs.append(place | {"kind": "paragraph", "paragraph_index": body if own else None, "text": []})
                body += own
                if "paragraph" in kinds:
                    rows.append(paragraphs[-1])
            elif name in ("anchor", "inline"):
                drawings.append(e)
            elif name in _IMAGES and "image" in kinds and (own := e.get(f"{R}embed") or e.get(f"{R}id")):
                row = place | {"kind": "image", "paragraph_index": paragraphs[-1]["paragraph_index"] if paragraphs else None, "relationship_id": own} | _told(part, relations.get(own), names)
                rows.append(row)
                waiting.append((drawings[-1] if drawings else None, row))
            continue
        path.pop()
        if name == "p" and paragraphs:
            paragraphs[-1]["text"] = "".join(paragraphs[-1]["text"])
            paragraphs.pop()
            if not drawings:
                e.clear()
        elif name in ("anchor", "inline"):
            drawings.pop()
            for _, row in (w for w in waiting if w[0] is e):
                row["drawing_layout"] = _layout(e)
            waiting = [w for w in waiting if w[0] is not e and w[0] is not None]
        elif paragraphs and e.tag in (f"{W}t", f"{M}t"):
            paragraphs[-1]["text"].append(e.text or "")
        elif paragraphs and e.tag in (f"{W}tab", f"{W}br", f"{W}cr"):
            paragraphs[-1]["text"].append("\t" if name == "tab" else "\n")
    return [r | {"drawing_layout": r.get("drawing_layout", {})} for r in rows if r["kind"] == "image" or r["text"].strip()]


def package_rows(file, columns: Collection[str], kinds: Collection[str] = KINDS, parts: tuple[str, ...] = ()) -> Iterator[dict]:
    """The rows of one package: of these kinds, and of parts whose names begin with one of `parts` (none: all)."""
    try:
        with zipfile.ZipFile(file) as z:
            names = set(z.namelist())
            if not set(REQUIRED) <= names:
                yield {"kind": "problem", "problem": "missing_docx_parts"}
            hashes: dict[str, str | None] = {}

            def hashed(path: str) -> str | None:
                if path not in hashes:
                    digest = hashlib.sha256()
                    try:
                        with z.open(path) as media:
                            while piece := media.read(_STEP):
                                digest.update(piece)
                        hashes[path] = digest.hexdigest()
                    except _BROKEN:
                        hashes[path] = None
                return hashes[path]

            def full(row: dict) -> dict:
                path = row["media_path"]
                if path in names:
                    row["media_bytes"] = z.getinfo(path).file_size
                    if "media_sha256" in columns:
                        row["media_sha256"] = hashed(path)
                    if "content" in columns:
                        row["content"] = z.read(path)
                return row

            mine = sorted(n for n in names if n.startswith(parts)) if parts else sorted(names)
            for part in (n for n in mine if _PART.fullmatch(n) and not {"paragraph", "image"}.isdisjoint(kinds)):
                try:
                    relations = _relations(z, part, names) if "image" in kinds else {}
                    with z.open(part) as stream:
                        rows = part_rows(stream, part, relations, names, kinds)
                    for row in rows:
                        yield full(row) if row["kind"] == "image" else row
                except _BROKEN:
                    yield {"kind": "problem", "package_part": part, "problem": "invalid_part"}
            for path in (n for n in mine if "media" in kinds and n.startswith("word/media/") and not n.endswith("/")):
                try:
                    yield full({"kind": "media", "package_part": path, "media_path": path})
                except _BROKEN:
                    yield {"kind": "problem", "package_part": path, "problem": "invalid_part"}
    except _BROKEN:
        yield {"kind": "problem", "problem": "invalid_docx"}


class PackageReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.root = options.get("path")
        self.most = int(options.get("partition_bytes", 64 << 20))
        self.schema = schema
        self.kinds = tuple(k for k in options.get("kinds", "").split(",") if k) or KINDS
        self.parts = tuple(p for p in options.get("parts", "").split("\n") if p)

    def partitions(self) -> list[InputPartition]:
        """Files under the path by size: as many a partition as fill it (a file counts 64 kB at least)."""
        from pyarrow import fs

        local = self.root.startswith("file:") or "://" not in self.root
        store, base = (fs.LocalFileSystem(), re.sub("^file:(//)?(?=/)", "", self.root)) if local else fs.FileSystem.from_uri(self.root)
        scheme = "" if local else self.root.split("://")[0] + "://"
        groups: list[list[str]] = []
        size = self.most
        for f in sorted(store.get_file_info(fs.FileSelector(base, recursive=True)), key=lambda f: f.path):
            uri = scheme + f.path
            if f.type == fs.FileType.File and f.path.lower().endswith(".docx"):
                if size + f.size > self.most:
                    groups.append([])
                    size = 0
                groups[-1].append(uri)
                size += max(f.size, 1 << 16)
        return [InputPartition(g) for g in groups]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, names = to_arrow_schema(self.schema), self.schema.names
        batch = lambda rows: pa.RecordBatch.from_pylist(rows, schema=schema)
        rows, held = [], 0
        for uri in partition.value if partition is not None else ():
            with opened(uri) as file:
                for row in package_rows(file, set(names), self.kinds, self.parts):
                    row["path"] = uri
                    rows.append({k: list(row[k].items()) if k == "drawing_layout" and k in row else row.get(k) for k in names})
                    held += 500 + len(row.get("text") or "") + len(row.get("content") or b"")
                    if held > _HELD:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)


class PackageSource(DataSource):
    """spark.read.format("word_package"). A schema given by the user is the list of columns wanted of SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "word_package"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PackageReader:
        return PackageReader(self.options, schema)


def read_packages(spark: SparkSession, path: str, columns: str = SCHEMA, kinds: Sequence[str] = KINDS, parts: Sequence[str] = (), partition_bytes: int = 64 << 20) -> DataFrame:
    """The rows of all .docx files under path. columns: a DDL list out of SCHEMA; without media_sha256 and content no media is opened. kinds: the rows wanted; parts: beginnings of the names
    of parts wanted (none: all). A file that is no package, or a part that cannot be read, is a row of kind problem."""
    spark.dataSource.register(PackageSource)
    read = spark.read.format("word_package").schema(columns).option("partition_bytes", str(partition_bytes))
    return read.option("kinds", ",".join(kinds)).option("parts", "\n".join(parts)).load(path)
