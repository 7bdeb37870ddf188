import io
import zipfile

import pytest

from corpusloom.sources import docx, tables

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:v="urn:schemas-microsoft-com:vml" xmlns:mc="urn:mc"'
REL = '<Relationship Id="{}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/image" Target="{}"{}/>'


def made(body, rels="", files=(), name="word/document.xml"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        if rels is not None:
            z.writestr("word/_rels/document.xml.rels", f"<Relationships>{rels}</Relationships>")
        for path, content in files:
            z.writestr(path, content)
    return out.getvalue()


def p(*runs):
    return "<w:p>" + "".join(f"<w:r>{r}</w:r>" for r in runs) + "</w:p>"


def t(s):
    return f"<w:t>{s}</w:t>"


def blip(rid, how="embed"):
    return f'<w:drawing><a:blip r:{how}="{rid}"/></w:drawing>'


def marker(name):
    return f"[Figure: {name}]\n\nImage Description:\n<empty>"


def parsed(*args, **kw):
    return docx.parse("d", made(*args, **kw))


def test_paragraphs_and_breaks():
    body = p(t(" one"), "<w:tab/>" + t("two") + "<w:br/>" + t("three ")) + p(t("  ")) + p(t("four"))
    assert parsed(body)["text"] == "one\ttwo\nthree\n\nfour"


def test_tabs_count_only_in_runs():
    body = f"<w:p><w:ins><w:r>{t('a')}<w:tab/>{t('b')}</w:r></w:ins></w:p>"
    assert parsed(body)["text"] == "ab"


def test_hyperlinks_keep_order():
    body = f"<w:p><w:r>{t('see ')}</w:r><w:hyperlink><w:r>{t('here')}<w:tab/></w:r></w:hyperlink><w:r>{t('now')}</w:r></w:p>"
    assert parsed(body)["text"] == "see here\tnow"


def test_tables():
    cell = lambda x: f"<w:tc>{x}</w:tc>"
    row = lambda *x: f"<w:tr>{''.join(map(cell, x))}</w:tr>"
    inner = f"<w:tbl>{row(p(t('x')), p(t('y')))}</w:tbl>"
    body = f"<w:tbl>{row(p(t('a')) + p(t('b')), p(), p(t('c')))}{row(p(), p(t(' ')))}{row(inner + p(t('z')))}</w:tbl>"
    assert parsed(body)["text"] == "a b | c\n\nx | y z"


def test_only_direct_blocks_of_the_body():
    assert parsed(f"<w:sdt>{p(t('lost'))}</w:sdt>{p(t('kept'))}")["text"] == "kept"


def test_figures():
    rels = REL.format("r1", "media/a.PNG", "") + REL.format("r2", "http://x/y.png", ' TargetMode="External"') + REL.format("r3", "media/raw", "") + REL.format("r4", "../media/b.jpg", "")
    files = [("word/media/a.PNG", b"1"), ("word/media/raw", b"2"), ("media/b.jpg", b"3")]
    body = p(t("x") + blip("r1") + t("y"), blip("r2"), blip("nope")) + p(blip("r3"), '<w:pict><v:imagedata r:id="r4"/></w:pict>') + p(blip("r1", "link"))
    out = parsed(body, rels, files)
    names = ["d_000001.png", "d_000002.bin", "d_000003.jpg", "d_000004.png"]
    assert out["text"] == "\n\n".join(["x", marker(names[0]), "y", *map(marker, names[1:])])
    assert [i["filename"] for i in out["images"]] == names
    assert [i["content"] for i in out["images"]] == [b"1", b"2", b"3", b"1"]
    assert [i["position"] for i in out["images"]] == [1, 2, 3, 4]
    assert out["images"][2]["source_path"] == "media/b.jpg"


def test_alternate_content_gives_a_picture_twice():
    body = p(f'<mc:AlternateContent><mc:Choice>{blip("r1")}</mc:Choice><mc:Fallback><w:pict><v:imagedata r:id="r1"/></w:pict></mc:Fallback></mc:AlternateContent>')
    out = parsed(body, REL.format("r1", "media/a.png", ""), [("word/media/a.png", b"1")])
    assert len(out["images"]) == 2


def test_no_relationships_no_body():
    assert parsed(p(t("a"), blip("r1")), None)["text"] == "a"
    assert docx.parse("d", made("", name="other.xml"))["error"].startswith("KeyError")
    assert docx.parse("d", b"nonsense")["text"] is None


def test_broken_in_all_ways():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, zipfile.ZipFile(io.BytesIO(made(p(t("a" * 5000))))) as plain:
        z.writestr("word/document.xml", plain.read("word/document.xml"))
    whole = out.getvalue()
    at = whole.index(b"word/document.xml") + len(b"word/document.xml")
    corrupt = whole[: at + 5] + bytes(x ^ 0x55 for x in whole[at + 5 : at + 15]) + whole[at + 15 :]
    locked, odd = bytearray(whole), bytearray(whole)
    for sign, flag, method in ((b"PK\x03\x04", 6, 8), (b"PK\x01\x02", 8, 10)):
        where = whole.rindex(sign)
        locked[where + flag] |= 1
        odd[where + method] = 99
    for content in (corrupt, bytes(locked), bytes(odd), b"", whole[:-30]):
        row = docx.parse("d", content)
        assert row["error"] and row["text"] is None and row["images"] == []
    assert docx.parse("d", whole)["error"] is None


def test_files_and_figures(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.docx").write_bytes(made(p(t("a"), blip("r1")), REL.format("r1", "media/a.png", ""), [("word/media/a.png", b"png")]))
    (tmp_path / "in" / "deep" / "b.docx").write_bytes(b"broken")
    (tmp_path / "in" / "c.txt").write_text("no")
    rows = docx.read_docx(spark, str(tmp_path / "in"))
    got = {r.document_name: r for r in rows.collect()}
    assert set(got) == {"a.docx", "b.docx"} and got["b.docx"].error and got["a.docx"].text.startswith("a\n\n[Figure: ")
    figures = tables.figures(rows)
    assert [bytes(r.content) for r in tables.read_figure(figures, "a.docx_000001.png").collect()] == [b"png"]
    assert tables.read_figure(figures, "none").collect() == []
    assert [tuple(r) for r in tables.export_figures(rows, str(tmp_path / "figures")).collect()] == [("a.docx_000001.png", 3)]
    assert (tmp_path / "figures" / "a.docx_000001.png").read_bytes() == b"png"
    tables.write_markdown(rows, str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md"), wholetext=True).count() == 1


@pytest.mark.parametrize("text", ["a\nb", "  x\n\n y ", ""])
def test_round_trip(text):
    from corpusloom.plans.queries import _as_docx

    assert docx.parse("d", _as_docx(text))["text"] == "\n\n".join(x.strip() for x in text.split("\n") if x.strip())
