"""Readers and writers of the engine's tables: question sets, texts, figures, vectors and lexical indexes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import schema
from corpusloom.functions import text
from corpusloom.operators.bm25 import Index
from corpusloom.sources import loose
from corpusloom.sources.shared import settled


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON Lines set of questions with keywords, reference answers and categories."""
    return spark.read.schema(schema.QUESTION_SET).json(path)


def read_router_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.ROUTER_SET).json(path)


def read_conversation_set(spark: SparkSession, path: str) -> DataFrame:
    """A file with one JSON array of conversations, or with one conversation."""
    return spark.read.schema(schema.CONVERSATION_SET).option("multiLine", True).json(path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(document_name, text) of all files below path whose names end in md; one without a byte has no row."""
    files = loose.read(spark, path, "*md").filter(F.octet_length("content") > 0)
    return files.select(text.basename(F.col("path")).alias("document_name"), F.col("content").cast("string").alias("text"))


def write_markdown(parsed: DataFrame, path: str) -> None:
    """Each document's text in a folder of its own name, UTF-8."""
    parsed.filter(F.col("text").isNotNull()).select("document_name", "text").write.partitionBy("document_name").option("lineSep", "\n").mode("overwrite").text(path)


def figures(parsed: DataFrame) -> DataFrame:
    """A row for each figure of parsed documents."""
    return parsed.select("document_name", F.explode("images").alias("i")).select("document_name", "i.*")


def read_figure(figures_: DataFrame, filename: str) -> DataFrame:
    """The figure's row; no row if there is none."""
    return figures_.filter(F.col("filename") == filename).limit(1)


def create_table(spark: SparkSession, path: str, columns: T.StructType) -> None:
    """An empty table, where there is none yet."""
    spark.createDataFrame([], columns).write.mode("ignore").parquet(path)


def append(rows: DataFrame, path: str, columns: T.StructType) -> None:
    rows.select([F.col(f.name).cast(f.dataType) for f in columns]).write.mode("append").parquet(path)


def vector_points(chunks: DataFrame, vector: str = "vector") -> DataFrame:
    """Chunks with vectors as points; a point's id comes from its chunk's, so ingesting again replaces it."""
    return chunks.select(F.xxhash64(F.col("id")).alias("id"), vector, "document_id", F.col("id").alias("chunk_id"))


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of old and new, of each key the newest; within new, rows are told apart by their other columns' order."""
    both = old.withColumn("__age", F.lit(1)).unionByName(new.withColumn("__age", F.lit(0)))
    newest = Window.partitionBy(key).orderBy("__age", *[c for c in old.columns if c != key])
    return both.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n", "__age")


def save_index(index: Index, path: str) -> None:
    """A lexical index as Parquet; postings lie by term, so a query's scan skips most row groups."""
    index.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    index.terms.sparkSession.createDataFrame([(index.n_docs, index.avgdl)], "n_docs long, avgdl double").write.mode("overwrite").parquet(f"{path}/stats")


def load_index(spark: SparkSession, path: str) -> Index:
    stats = spark.read.parquet(f"{path}/stats").first()
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), stats["n_docs"], stats["avgdl"])


def write_files(files: DataFrame, folder: str, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Writes each row's bytes to folder/path and gives (path, bytes) back; executors write, to any store of pyarrow.fs.

    A file is written under another name first and then moved, so that a task that runs again leaves no half of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[str] = set()
        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, content in zip(names, batch.column(1)):
                target, raw = f"{root}/{name}", content.as_py() or b""
                if (own := target.rsplit("/", 1)[0]) not in made:
                    store.create_dir(own, recursive=True)
                    made.add(own)
                part = f"{target}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(raw)
                store.move(part, target)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])

    written = files.select(F.col(path_col).cast("string"), F.col(content_col).cast("binary")).mapInArrow(run, "path string, bytes long")
    return settled(written)


def export_figures(parsed: DataFrame, folder: str) -> DataFrame:
    """The figures of parsed documents as files of their own: (path, bytes)."""
    return write_files(figures(parsed), folder, "filename", "content")
