"""Word documents as rows: ordered text with figure markers, and the figures themselves."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructType

from corpusloom.schema import PARSED_DOCX
from corpusloom.sources import loose

# Namespaces and the relationship type of the file format, and the marker that stands for a figure.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
V = "{urn:schemas-microsoft-com:vml}"
IMAGE_TYPE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/image"
MARKER = "[Figure: {}]\n\nImage Description:\n<empty>"
_BREAKS = {W + "tab": "\t", W + "br": "\n", W + "cr": "\n"}
_PICTURES = {W + "drawing", W + "pict"}
#: Files that are parsed before their rows are sent on.
ROWS = 64


@dataclass
class Figure:
    """What stands for a picture in a paragraph until it has a name."""

    relationship: str


@dataclass
class Package:
    """A zip with one document in it; figures are named as they come up, the same picture anew each time."""

    name: str
    zip: zipfile.ZipFile
    figures: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.targets: dict[str, str] = {}
        if "word/_rels/document.xml.rels" in self.zip.namelist():
            for rel in ElementTree.fromstring(self.zip.read("word/_rels/document.xml.rels")):
                # An external target has no bytes here, so its pictures leave no trace.
                if rel.get("Type") == IMAGE_TYPE and rel.get("TargetMode") != "External":
                    self.targets[rel.get("Id")] = posixpath.normpath(posixpath.join("word", rel.get("Target")))

    def marker(self, figure: Figure) -> str:
        path = self.targets.get(figure.relationship)
        if path is None:
            return ""
        position = len(self.figures) + 1
        ending = posixpath.splitext(posixpath.basename(path))[1].lower() or ".bin"
        filename = f"{self.name}_{position:06d}{ending}"
        self.figures.append({"filename": filename, "relationship_id": figure.relationship, "source_path": path, "position": position, "content": self.zip.read(path)})
        return MARKER.format(filename)


def _pictures(node: ElementTree.Element) -> Iterator[Figure]:
    named = [x.get(R + "embed") or x.get(R + "link") for x in node.iterfind(f".//{A}blip")]
    named += [x.get(R + "id") for x in node.iterfind(f".//{V}imagedata")]
    yield from (Figure(n) for n in named if n)


def _inline(node: ElementTree.Element, level: str) -> Iterator[str | Figure]:
    """Texts and figures below node in order. Tabs and breaks count at the level of a run only, not further down."""
    for child in node:
        if child.tag in _PICTURES:
            yield from _pictures(child)
        elif level == "paragraph" and child.tag == W + "r":
            yield from _inline(child, "run")
        elif level == "paragraph" and child.tag == W + "hyperlink":
            yield from _inline(child, "paragraph")
        elif level == "run" and child.tag in _BREAKS:
            yield _BREAKS[child.tag]
        else:
            if child.tag == W + "t":
                yield child.text or ""
            yield from _inline(child, "below")


def _paragraph(node: ElementTree.Element, package: Package) -> Iterator[str]:
    """The paragraph's texts, stripped, with each figure's marker as a block between them."""
    text = ""
    for part in _inline(node, "paragraph"):
        if isinstance(part, str):
            text += part
        elif marker := package.marker(part):
            yield from filter(None, (text.strip(), marker))
            text = ""
    yield from filter(None, (text.strip(),))


def _blocks(parent: ElementTree.Element, package: Package) -> Iterator[str]:
    """Blocks of the paragraphs and tables directly below parent; a table has one block for each row with any text."""
    for child in parent:
        if child.tag == W + "p":
            yield from _paragraph(child, package)
        elif child.tag == W + "tbl":
            for row in child.iterfind(W + "tr"):
                cells = [" ".join(_blocks(cell, package)).strip() for cell in row.iterfind(W + "tc")]
                if any(cells):
                    yield " | ".join(filter(None, cells))


def parse(name: str, content: bytes) -> dict:
    """One document's row; what is not a readable document, for whatever reason, has a null text and an error."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as file:
            package = Package(name, file)
            body = ElementTree.fromstring(file.read("word/document.xml")).find(W + "body")
            text = "\n\n".join(_blocks(body, package)) if body is not None else ""
            return {"document_name": name, "text": text, "images": package.figures, "error": None}
    # Files come from anywhere: corrupt streams, passwords and unknown compression raise what the libraries below raise.
    except Exception as e:  # noqa: BLE001
        return {"document_name": name, "text": None, "images": [], "error": f"{type(e).__name__}: {e}"}


def _parsed(batches: Iterator[pa.RecordBatch], content: bool) -> Iterator[pa.RecordBatch]:
    """(document_name, content) to rows of PARSED_DOCX, ROWS at a time: what a worker holds doesn't grow with its task."""
    kind = to_arrow_schema(PARSED_DOCX)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            rows = [parse(n, c or b"") for n, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
            out = pa.RecordBatch.from_pylist(rows, schema=kind)
            yield out.append_column("content", part.column(1)) if content else out


def parsed(found: DataFrame, content: bool = False) -> DataFrame:
    """found (document_name, content) to rows of PARSED_DOCX, a row for each file; with content, the file's bytes as well."""
    columns = StructType([*PARSED_DOCX.fields]).add("content", BinaryType()) if content else PARSED_DOCX
    return found.select("document_name", F.col("content").cast("binary")).mapInArrow(lambda batches: _parsed(batches, content), columns)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(document_name, content) of all .docx files at path, a file, a folder or a glob; folders are searched to any depth."""
    return loose.read(spark, path, "*.docx").select(F.regexp_extract("path", r"([^/]*)$", 1).alias("document_name"), "content")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """All .docx files at path, parsed."""
    return parsed(files(spark, path))
