"""Schemas of the persistent tables and of nested results."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType, TimestampType

_STRINGS = ArrayType(StringType())


def _columns(**columns) -> StructType:
    out = StructType()
    for name, kind in columns.items():
        out.add(name, kind if isinstance(kind, (ArrayType, StructType)) else kind())
    return out


DOCUMENT = _columns(id=StringType, document_name=StringType)
DOCUMENT_IMAGE = _columns(id=LongType, document_id=StringType, filename=StringType)
CHUNK = _columns(id=StringType, document_id=StringType, chunk_index=IntegerType, text=StringType)
CONVERSATION = _columns(id=LongType, title=StringType, updated_at=TimestampType)
MESSAGE = _columns(id=LongType, conversation_id=LongType, role=StringType, content=StringType)
VECTOR = _columns(id=LongType, vector=ArrayType(FloatType()), document_id=StringType, chunk_id=StringType)
POSTING = _columns(chunk_id=StringType, term=StringType, tf=LongType, dl=LongType)
TERM = _columns(term=StringType, df=LongType, idf=DoubleType)
IMAGE = _columns(filename=StringType, relationship_id=StringType, source_path=StringType, position=IntegerType, content=BinaryType)
PARSED_DOCX = _columns(document_name=StringType, text=StringType, images=ArrayType(IMAGE), error=StringType)
REFERENCE = _columns(document_name=StringType, images=_STRINGS)
ANSWER = _columns(answer=StringType, references=ArrayType(REFERENCE))
ROUTE = _columns(use_rag=BooleanType, rewritten_query=StringType)
QUESTION_SET = _columns(question=StringType, keywords=_STRINGS, reference_answer=StringType, category=StringType)
ROUTER_SET = _columns(question=StringType, history=StringType, expected_use_rag=BooleanType)
CONVERSATION_SET = _columns(id=StringType, category=StringType, questions=_STRINGS)
