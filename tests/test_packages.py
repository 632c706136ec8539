"""Word-processing packages: what is read of them, and what the rows say."""

import hashlib
import io
import zipfile

import pytest

from attestra.sources import packages

W, R, A = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/drawingml/2006/main"
NAMES = f'xmlns:w="{W}" xmlns:r="{R}" xmlns:a="{A}" xmlns:v="urn:schemas-microsoft-com:vml" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"'
BODY = """<w:p><w:r><w:t>one</w:t><w:tab/><w:drawing><wp:anchor behindDoc="0"><a:blip r:embed="body"/><wp:positionH relativeFrom="column"><wp:posOffset>123</wp:posOffset></wp:positionH>
<wp:positionV relativeFrom="paragraph"><wp:align> top </wp:align></wp:positionV></wp:anchor></w:drawing></w:r></w:p><w:p/>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t><w:pict><v:imagedata r:id="cell"/></w:pict></w:r></w:p></w:tc></w:tr></w:tbl>
<w:p><w:r><w:t>around</w:t><w:pict><w:txbxContent><w:p><w:r><w:t>box</w:t><a:blip r:embed="lost"/></w:r></w:p></w:txbxContent></w:pict><w:t> it</w:t></w:r></w:p>
<w:p><a:blip r:embed="absent"/><a:blip r:embed="far"/><a:blip r:embed="link"/><a:blip/><a:blip r:embed="blank"/></w:p>"""
BIG = bytes(range(256)) * 8000


def relations(**targets):
    one = lambda i, t: f'<Relationship Id="{i}" Type="{"x/hyperlink" if i == "link" else "x/image"}" {"" if t is None else f"Target=\"{t}\""}{" TargetMode=\"External\"" if (t or "").startswith("http") else ""}/>'
    return '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(one(i, t) for i, t in targets.items()) + "</Relationships>"


def package(**more) -> bytes:
    parts = {
        "[Content_Types].xml": "<Types/>",
        "word/document.xml": f"<w:document {NAMES}><w:body>{BODY}</w:body></w:document>",
        "word/_rels/document.xml.rels": relations(body="media/body.png", cell="/word/media/../media/cell.png".replace("/../media", ""), lost="media/lost.png", far="https://example.test/a.png", link="media/body.png", blank=None),
        "word/header2.xml": f'<w:hdr {NAMES}><w:p><a:blip r:embed="top"/><w:r><w:t>head</w:t></w:r></w:p></w:hdr>',
        "word/_rels/header2.xml.rels": relations(top="media/body.png"),
        "word/footnotes.xml": f"<w:footnotes {NAMES}><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnotes>",
        "word/media/body.png": BIG,
        "word/media/cell.png": b"cell-image",
        "word/media/spare.png": b"spare",
    } | more
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in parts.items():
            if data is not None:
                z.writestr(name, data)
    return out.getvalue()


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


def rows(data: bytes, columns=("media_sha256", "content"), kinds=packages.KINDS, parts=()):
    file = Counted(data)
    return list(packages.package_rows(file, columns, kinds, parts)), file.taken


def test_every_image_reference_and_where_it_leads():
    images = {r["relationship_id"]: r for r in rows(package())[0] if r["kind"] == "image"}
    assert {i: (r["host_kind"], r["relationship_status"], r["paragraph_index"]) for i, r in images.items()} == {
        "body": ("body_paragraph", "resolved_internal", 0), "cell": ("table_cell", "resolved_internal", None), "lost": ("textbox", "missing_media_part", None), "absent": ("body_paragraph", "missing_relationship", 3),
        "far": ("body_paragraph", "external_target", 3), "link": ("body_paragraph", "missing_relationship", 3), "blank": ("body_paragraph", "missing_relationship_target", 3), "top": ("header", "resolved_internal", None),
    }
    assert images["body"]["drawing_layout"] == {
        "drawing_kind": "anchor", "anchor.@behindDoc": "0", "anchor.horizontal.relative_from": "column", "anchor.horizontal.posOffset": "123", "anchor.vertical.relative_from": "paragraph", "anchor.vertical.align": "top",
    }
    assert images["cell"]["drawing_layout"] == {} and images["top"]["package_part"] == "word/header2.xml"
    assert images["top"]["media_sha256"] == images["body"]["media_sha256"] == hashlib.sha256(BIG).hexdigest() and images["body"]["content"] == BIG
    assert images["cell"]["host_location"] == "/document[1]/body[1]/tbl[1]/tr[1]/tc[1]/p[1]/r[1]/pict[1]/imagedata[1]"


def test_text_belongs_to_its_innermost_paragraph():
    texts = [(r["package_part"], r["host_kind"], r["paragraph_index"], r["text"]) for r in rows(package())[0] if r["kind"] == "paragraph"]
    assert texts == [
        ("word/document.xml", "body_paragraph", 0, "one\t"), ("word/document.xml", "table_cell", None, "cell"), ("word/document.xml", "body_paragraph", 2, "around it"),
        ("word/document.xml", "textbox", None, "box"), ("word/footnotes.xml", "footnote", None, "note"), ("word/header2.xml", "header", None, "head"),
    ]


def test_media_are_read_only_where_asked_for():
    data = package()
    told, taken = rows(data, ())
    assert taken < len(data) // 20 and {r["media_path"]: r["media_bytes"] for r in told if r["kind"] == "media"} == {"word/media/body.png": len(BIG), "word/media/cell.png": 10, "word/media/spare.png": 5}
    assert rows(data, ("media_sha256",), ["paragraph"])[1] < len(data) // 20
    assert len(BIG) < rows(data, ("media_sha256",), ["image"])[1] < 1.1 * len(BIG)  # once, though two images show it
    one = rows(data, (), parts=("word/header",))
    assert {r["package_part"] for r in one[0]} == {"word/header2.xml"} and one[1] < taken


@pytest.mark.parametrize(
    "data,problem,others",
    [
        (b"", "invalid_docx", 0), (b"no zip", "invalid_docx", 0), (package(**{"word/document.xml": None}), "missing_docx_parts", 1), (package(**{"word/footnotes.xml": "<open>"}), "invalid_part", 1),
        (package(**{"word/document.xml": ""}), "invalid_part", 1), (package()[:-40], "invalid_docx", 0),
    ],
)
def test_what_cannot_be_read_is_a_row(data, problem, others):
    got = rows(data)[0]
    assert [r["problem"] for r in got if r["kind"] == "problem"] == [problem] and (len(got) > 1) == bool(others)


def test_source_prunes_and_pushes_down(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("a.docx", "deep/b.DOCX", "c.txt"):
        (tmp_path / name).write_bytes(package())
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    whole = packages.read_packages(spark, str(tmp_path), partition_bytes=3 << 20)  # a.docx with broken.docx, then b.DOCX
    assert whole.rdd.getNumPartitions() == 2
    assert {(r["kind"], r["count"]) for r in whole.groupBy("kind").count().collect()} == {("image", 16), ("paragraph", 12), ("media", 6), ("problem", 1)}
    image = whole.where("kind = 'image' AND relationship_id = 'body'").select("drawing_layout", "content").first()
    assert image["drawing_layout"]["anchor.horizontal.posOffset"] == "123" and bytes(image["content"]) == BIG
    heads = packages.read_packages(spark, f"file://{tmp_path}", "path string, package_part string, kind string, text string", ["paragraph"], ["word/header", "word/endnotes"])
    assert sorted((r["kind"], r["text"]) for r in heads.collect()) == [("paragraph", "head"), ("paragraph", "head"), ("problem", None)]
    (tmp_path / "none").mkdir()
    assert packages.read_packages(spark, str(tmp_path / "none")).count() == 0


def test_one_table_serves_several_filters(spark, tmp_path):
    """Spark would share what the first filter pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    (tmp_path / "a.docx").write_bytes(package())
    table = packages.read_packages(spark, str(tmp_path), "path string, kind string, media_path string")
    both = table.where("kind = 'image'").unionByName(table.where("kind = 'media'")).groupBy("kind").count()
    assert {tuple(r) for r in both.collect()} == {("image", 8), ("media", 3)} and table.count() == 17
