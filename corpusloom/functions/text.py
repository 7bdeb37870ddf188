"""Scalar functions on texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a token is a run of a-z and 0-9, with single dots, dashes and underscores inside ("db-117", "v7.4.2").
TOKEN = r"[a-z0-9]+(?:[-._][a-z0-9]+)*"
DEFAULT_TITLE, TITLE_LENGTH = "New Conversation", 100
CHUNK_CHARS, OVERLAP_CHARS = 1000, 300
SEPARATORS = ("\n\n", "\n", " ", "")
#: Texts that are cut at a time.
ROWS = 64


def tokens(text: Column) -> Column:
    """All tokens in order, repeats included; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def title(text: Column) -> Column:
    """A conversation's title: stripped, and the default if nothing is left."""
    return F.coalesce(F.nullif(stripped(text), F.lit("")), F.lit(DEFAULT_TITLE))


def title_of_question(question: Column) -> Column:
    return title(F.substring(question, 1, TITLE_LENGTH))


def standalone_query(rewritten: Column, question: Column) -> Column:
    """The rewritten query, or the question where that is null or empty."""
    return F.coalesce(F.nullif(rewritten, F.lit("")), question)


def chunk_id(document_id: Column, index: Column) -> Column:
    return F.concat_ws(":", document_id.cast("string"), index.cast("string"))


def figure_refs(text: Column) -> Column:
    """The names in all figure markers, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[Figure: ([^\]]+)\]"), F.lit(1))


def suffix(path: Column, default: str = ".bin") -> Column:
    found = F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(default))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def cosine_unit(a: Column, b: Column) -> Column:
    """The dot product in double precision: the cosine, if both have length one."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def seconds(value: Column) -> Column:
    """Two decimals, halves to even."""
    return F.bround(value, 2)


def _pieces(text: str, separators: tuple[str, ...]) -> tuple[list[str], tuple[str, ...]]:
    """text cut before each occurrence of the first separator that it holds, and the separators after that one."""
    for k, sep in enumerate(separators):
        if not sep:
            return list(text), ()
        if sep in text:
            head, *rest = text.split(sep)
            return [p for p in (head, *(sep + r for r in rest)) if p], separators[k + 1 :]
    return [text], ()


def _packed(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Pieces put together up to size; a chunk begins with the last pieces of the one before, up to overlap."""
    out, first, held = [], 0, 0
    for i, piece in enumerate(pieces):
        if held and held + len(piece) > size:
            out.append("".join(pieces[first:i]).strip())
            while held > overlap or held and held + len(piece) > size:
                held -= len(pieces[first])
                first += 1
        held += len(piece)
    out.append("".join(pieces[first:]).strip())
    return [c for c in out if c]


def split_text(text: str | None, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Overlapping chunks of at most size characters, cut at paragraphs if possible, else at lines, spaces, anywhere."""
    if not text:
        return []
    pieces, finer = _pieces(text, separators)
    out, run = [], []
    for piece in pieces:
        if len(piece) < size or not finer and len(piece) <= size:
            run.append(piece)
            continue
        if run:
            out += _packed(run, size, overlap)
            run = []
        out += split_text(piece, size, overlap, finer) if finer else [piece]
    return out + (_packed(run, size, overlap) if run else [])


def cut_texts(texts: pa.Array, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> pa.Array:
    """A list of each text's chunks; ROWS texts at a time are Python's, the others stay as Arrow."""
    kind = pa.list_(pa.string())
    parts = [pa.array([split_text(t, size, overlap) for t in texts.slice(at, ROWS).to_pylist()], kind) for at in range(0, len(texts), ROWS)]
    return pa.concat_arrays([pa.array([], kind), *parts])


def chunks(text: Column, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return cut_texts(texts, size, overlap)

    return cut(text)
