"""A library of documents and conversations on shared storage: what the routes of a question-answering service do.

A table is a list of Parquet folders, and a manifest names those of all tables. A change writes its new folders first
and then the next manifest, under another name that is then changed to the next number, so readers see all of a change
or nothing, and what a writer that died leaves is in nobody's way; appending adds a folder and rewrites none. A change
builds on the manifest that its operation read first: if another writer was faster, it is an error, and nothing
changes. vacuum() deletes what the latest manifest doesn't name.

Requests are the few that one call brings; everything else is DataFrames.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from corpusloom import schema
from corpusloom.functions import text
from corpusloom.models import Embedder, Generator, Reranker, Router, embedded
from corpusloom.operators import catalog, chat, vector
from corpusloom.sources import docx
from corpusloom.sources.shared import settled

IMAGES = StructType([*schema.DOCUMENT_IMAGE.fields]).add("content", BinaryType())
FILE = StructType().add("document_id", "string").add("content", BinaryType())
TABLES = {"documents": schema.DOCUMENT, "files": FILE, "images": IMAGES, "chunks": schema.CHUNK, "vectors": schema.VECTOR, "conversations": schema.CONVERSATION, "messages": schema.MESSAGE}


@dataclass
class Uploaded:
    """What an upload has written, and errors (document_name, error) of the files that it could not read."""

    documents: int
    images: int
    chunks: int
    vectors: int
    errors: DataFrame


class Library:
    def __init__(self, spark: SparkSession, root: str, embedder: Embedder, reranker: Reranker, router: Router, generator: Generator):
        self.spark, self.root = spark, root.rstrip("/")
        self.embedder, self.reranker, self.router, self.generator = embedder, reranker, router, generator

    # Storage

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _version(self) -> int:
        """The number of the latest manifest, -1 if there is none; manifests that aren't finished have no number."""
        path, store = self._path("manifests")
        if not store.exists(path):
            return -1
        names = [s.getPath().getName() for s in store.listStatus(path)]
        return max((int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()), default=-1)

    def _folders(self, version: int | None = None) -> dict[str, list[str]]:
        found: dict[str, list[str]] = {name: [] for name in TABLES}
        version = self._version() if version is None else version
        if version >= 0:
            (text_,) = self.spark.read.text(f"{self.root}/manifests/{version:08d}.json", wholetext=True).first()
            found |= json.loads(text_)
        return found

    def table(self, name: str, version: int | None = None) -> DataFrame:
        folders = self._folders(version)[name]
        if not folders:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.root}/{f}" for f in folders])

    def _change(self, base: int, replaced: dict[str, DataFrame] | None = None, added: dict[str, DataFrame] | None = None) -> None:
        """Writes new versions and additions, then the manifest after base; an error if there is one by now."""
        folders = self._folders(base)
        for frames, keep in ((replaced or {}, False), (added or {}, True)):
            for name, frame in frames.items():
                folder = f"{name}/{uuid.uuid4().hex}"
                frame.select([F.col(f.name).cast(f.dataType) for f in TABLES[name]]).write.parquet(f"{self.root}/{folder}")
                folders[name] = [*(folders[name] if keep else []), folder]
        path, store = self._path(f"manifests/_{uuid.uuid4().hex}")
        out = store.create(path)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())
        never_over = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(path, self._path(f"manifests/{base + 1:08d}.json")[0], never_over)
        except Py4JJavaError as e:
            store.delete(path, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise catalog.Conflict("another writer has changed the library") from e
            raise

    def vacuum(self) -> int:
        """Deletes all folders and manifests but those of the latest version, for good; gives the number of folders deleted."""
        version = self._version()
        keep, gone = {f for own in self._folders(version).values() for f in own}, 0
        for name in TABLES:
            path, store = self._path(name)
            for status in store.listStatus(path) if store.exists(path) else ():
                if f"{name}/{status.getPath().getName()}" not in keep:
                    store.delete(status.getPath(), True)
                    gone += 1
        path, store = self._path("manifests")
        for status in store.listStatus(path) if store.exists(path) else ():
            if status.getPath().getName() != f"{version:08d}.json":
                store.delete(status.getPath(), True)
        return gone

    def health(self) -> dict[str, str]:
        """Whether the library can be read; an error if not."""
        self._folders()
        return {"status": "ok"}

    # Documents

    def documents(self, page: int = 1, page_size: int = 10) -> tuple[DataFrame, int]:
        """One page by name, and the number of all documents."""
        every = self.table("documents")
        return catalog.page(every, "document_name", "id", page, page_size), every.count()

    def search(self, keyword: str, page: int = 1, page_size: int = 10) -> tuple[DataFrame, int]:
        hits = catalog.matching(self.table("documents"), "document_name", keyword)
        return catalog.page(hits, "document_name", "id", page, page_size), hits.count()

    def upload(self, path: str) -> Uploaded:
        """Ingests all Word files at path; a name that is there already, or comes twice, stops it before anything is written."""
        base = self._version()
        # Files are read and parsed once; what is made of them is settled, so that no table reads them again.
        every = settled(docx.parsed(docx.files(self.spark, path), content=True).withColumn("id", F.md5("document_name")))
        parsed = every.filter("error is null")
        taken = catalog.known(parsed.select("id"), self.table("documents", base), "id")
        twice = parsed.groupBy("id").count().filter("count > 1").select("id")
        if not taken.unionByName(twice).isEmpty():
            raise catalog.Conflict("a document of that name exists")
        cut = parsed.select(F.col("id").alias("document_id"), F.posexplode(text.chunks(F.col("text"))).alias("chunk_index", "text"))
        chunks = cut.withColumn("id", text.chunk_id(F.col("document_id"), F.col("chunk_index")))
        points = chunks.select(F.xxhash64("id").alias("id"), embedded(self.embedder, F.col("text")).alias("vector"), "document_id", F.col("id").alias("chunk_id"))
        images = parsed.select(F.col("id").alias("document_id"), F.explode("images").alias("i")).select(F.xxhash64("i.filename").alias("id"), "document_id", "i.filename", "i.content")
        bytes_ = parsed.select(F.col("id").alias("document_id"), "content")
        self._change(base, added={"documents": parsed, "files": bytes_, "images": images, "chunks": chunks, "vectors": points})
        errors = self.spark.createDataFrame(every.filter("error is not null").select("document_name", "error").collect(), "document_name string, error string")
        new = {name: self.spark.read.parquet(f"{self.root}/{own[-1]}").count() for name, own in self._folders(base + 1).items() if name in ("documents", "images", "chunks", "vectors")}
        return Uploaded(**new, errors=errors)

    def document(self, document_id: str) -> DataFrame:
        """The document's row; an error if there is none."""
        return catalog.required(self.table("documents"), "id", document_id)

    def download(self, document_id: str) -> DataFrame:
        """(document_name, content): the file as it was uploaded; an error if there is none."""
        row = self.document(document_id).select(F.col("id").alias("document_id"), "document_name")
        return row.join(self.table("files"), "document_id").select("document_name", "content")

    def image(self, filename: str) -> DataFrame:
        return catalog.required(self.table("images"), "filename", filename)

    def similar(self, questions: DataFrame, k: int = 10, where: Column | None = None) -> DataFrame:
        """questions (query_id, question) to (query_id, rank, chunk_id, score); where: on document_id, chunk_id and id of points."""
        asked = questions.select("query_id", embedded(self.embedder, F.col("question")).alias("vector"))
        points = self.table("vectors")
        near = vector.knn_batch(asked, points, k, id_col="id", vector_col="vector", where=where)
        return near.join(points.select("id", "chunk_id"), "id").select("query_id", "rank", "chunk_id", "score")

    def delete_document(self, document_id: str) -> None:
        base = self._version()
        catalog.required(self.table("documents", base), "id", document_id)
        keys = {"documents": "id", "files": "document_id", "images": "document_id", "chunks": "document_id", "vectors": "document_id"}
        # One row that the planner knows to be one: it is broadcast, and no table is shuffled.
        gone = self.spark.range(1).select(F.lit(document_id).alias("id"))
        self._change(base, catalog.without({name: (self.table(name, base), key) for name, key in keys.items()}, gone))

    # Conversations

    def conversations(self) -> DataFrame:
        return catalog.by_updated(self.table("conversations"))

    def conversation(self, conversation_id: int) -> DataFrame:
        return catalog.with_messages(catalog.required(self.table("conversations"), "id", conversation_id), self.table("messages"))

    def rename(self, conversation_id: int, title: str) -> None:
        base = self._version()
        known = self.table("conversations", base)
        catalog.required(known, "id", conversation_id)
        self._change(base, {"conversations": catalog.renamed(known, conversation_id, title)})

    def delete_conversation(self, conversation_id: int) -> None:
        base = self._version()
        catalog.required(self.table("conversations", base), "id", conversation_id)
        gone = self.spark.range(1).select(F.lit(conversation_id).cast("long").alias("id"))
        keys = {"conversations": "id", "messages": "conversation_id"}
        self._change(base, catalog.without({name: (self.table(name, base), key) for name, key in keys.items()}, gone))

    def chat(self, requests: list[tuple[int | None, str]], seconds: dict[str, float] | None = None) -> DataFrame:
        """Answers (conversation_id, question), one a conversation; without an id it starts one. Rows are those of chat.chat().

        New ids follow the largest of the version that the call read first; if another call has changed the library
        meanwhile, this one fails, so ids never clash. seconds: see chat.chat().
        """
        base = self._version()
        known, past = self.table("conversations", base), self.table("messages", base)
        ids = [c for c, _ in requests if c is not None]
        if len(set(ids)) < len(ids):
            raise ValueError("one question for each conversation at a time")
        if catalog.by_ids(known, "id", ids).count() < len(ids):
            raise catalog.NotFound("no such conversation")
        last = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        asked, fresh = [], []
        for c, question in requests:
            if c is None:
                c = last = last + 1
                fresh.append((c, question))
            asked.append((c, question))
        now = F.lit(datetime.now(timezone.utc))
        frame = self.spark.createDataFrame(asked, "conversation_id long, question string")
        chunks = self.table("chunks", base).join(self.table("documents", base).select(F.col("id").alias("document_id"), "document_name"), "document_id", "left").select("id", "document_name", "text")
        answered = chat.chat(frame, past, self.table("vectors", base), chunks, self.embedder, self.reranker, self.router, self.generator, seconds).persist()
        top = past.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        # Two messages for each request of this call: few rows, numbered in one task.
        added = chat.new_messages(answered).withColumn("id", F.row_number().over(Window.orderBy("conversation_id", "nth")) + top)
        started = self.spark.createDataFrame(fresh, "id long, question string").select("id", text.title_of_question(F.col("question")).alias("title"), now.alias("updated_at"))
        touched = known.withColumn("updated_at", F.when(F.col("id").isin(ids), now).otherwise(F.col("updated_at")))
        self._change(base, {"conversations": touched.unionByName(started)}, {"messages": added})
        return answered
