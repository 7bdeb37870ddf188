import pytest
from pyspark.sql import functions as F

from corpusloom.models import EchoGenerator, HashEmbedder, OverlapReranker, RuleRouter
from corpusloom.operators.catalog import Conflict, NotFound
from corpusloom.service import Library
from tests.test_docx import REL, blip, made, p, t


@pytest.fixture
def library(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    figure = [("word/media/a.png", b"png")]
    (folder / "alpha.docx").write_bytes(made(p(t("alpha beta gamma"), blip("r1")) + p(t("long " * 400)), REL.format("r1", "media/a.png", ""), figure))
    (folder / "delta_1.docx").write_bytes(made(p(t("delta epsilon zeta"))))
    out = Library(spark, str(tmp_path / "library"), HashEmbedder(), OverlapReranker(), RuleRouter(), EchoGenerator())
    (folder / "broken.docx").write_bytes(b"PK")
    said = out.upload(str(folder))
    assert (said.documents, said.images) == (2, 1) and said.chunks == said.vectors > 3
    assert [r.document_name for r in said.errors.collect()] == ["broken.docx"]
    return out


def test_documents(library, tmp_path):
    page, total = library.documents(1, 1)
    assert [r.document_name for r in page.collect()] == ["alpha.docx"] and total == 2
    hits, total = library.search("DELTA")
    (row,) = hits.collect()
    assert total == 1 and library.document(row.id).first().document_name == "delta_1.docx"
    assert bytes(library.download(row.id).first().content) == (tmp_path / "in" / "delta_1.docx").read_bytes()
    asked = library.spark.createDataFrame([(1, "delta epsilon")], "query_id long, question string")
    assert library.similar(asked, 1).first().chunk_id == f"{row.id}:0"
    assert {r.chunk_id for r in library.similar(asked, 1, F.col("document_id") != row.id).collect()}.isdisjoint({f"{row.id}:0"})
    assert library.table("chunks").count() == library.table("vectors").count() > 3
    assert bytes(library.image("alpha.docx_000001.png").first().content) == b"png"
    with pytest.raises(Conflict):
        library.upload(str(tmp_path / "in" / "delta_1.docx"))
    library.delete_document(row.id)
    assert library.documents()[1] == 1 and library.table("vectors").filter(f"document_id = '{row.id}'").count() == 0
    for missing in (lambda: library.download(row.id), lambda: library.delete_document(row.id), lambda: library.image("none")):
        with pytest.raises(NotFound):
            missing()
    assert library.upload(str(tmp_path / "in" / "delta_1.docx")).documents == 1 and library.documents()[1] == 2
    assert library.health() == {"status": "ok"}


def test_vacuum_deletes_for_good(library, tmp_path):
    row = library.search("alpha")[0].first()
    library.delete_document(row.id)
    everywhere = lambda: b"".join(x.read_bytes() for x in (tmp_path / "library").rglob("*") if x.is_file())
    assert b"alpha.docx_000001" in everywhere()
    assert library.vacuum() > 0 and library.vacuum() == 0
    assert b"alpha.docx_000001" not in everywhere() and library.documents()[1] == 1
    assert library.upload(str(tmp_path / "in" / "alpha.docx")).documents == 1


def test_a_writer_that_died_is_in_nobodys_way(library, tmp_path):
    number = library.chat([(None, "hello")]).first().conversation_id
    (tmp_path / "library" / "manifests" / "_unfinished").write_bytes(b"{")
    (tmp_path / "library" / "manifests" / "00000009").mkdir()
    (tmp_path / "library" / "manifests" / "00000009").rmdir()
    (tmp_path / "library" / "documents" / "half").mkdir()
    library.rename(number, "x")
    assert library.conversation(number).first().title == "x" and library.documents()[1] == 2


def test_the_second_of_two_writers_fails(library):
    number = library.chat([(None, "hello")]).first().conversation_id
    base = library._version()
    library.rename(number, "first")
    with pytest.raises(Conflict):
        library._change(base, {"messages": library.table("messages", base).limit(0)})
    assert library.conversation(number).first().title == "first" and library.table("messages").count() == 2


def test_seconds_of_stages(library):
    took = {}
    (row,) = library.chat([(None, "alpha beta gamma")], took).collect()
    assert row.use_rag and list(took) == ["history", "router", "retrieval", "llm", "total"]
    assert all(round(v, 2) == v >= 0 for v in took.values()) and took["total"] > 0


def test_conversations(library):
    (first,) = library.chat([(None, "  alpha beta gamma ")]).collect()
    assert first.use_rag and first.response.references[0].document_name == "alpha.docx"
    number = first.conversation_id
    assert library.conversations().first().title == "alpha beta gamma"
    library.chat([(number, "translate that please now"), (None, "hello")])
    row = library.conversation(number).first()
    assert [m.role for m in row.messages] == ["user", "assistant"] * 2
    assert row.messages[2].content == "translate that please now"
    library.rename(number, " renamed ")
    assert library.conversation(number).first().title == "renamed"
    library.delete_conversation(number)
    assert [r.title for r in library.conversations().collect()] == ["hello"]
    assert library.table("messages").filter(f"conversation_id = {number}").count() == 0
    for missing in (lambda: library.conversation(number), lambda: library.rename(number, "x"), lambda: library.chat([(number, "x")])):
        with pytest.raises(NotFound):
            missing()
