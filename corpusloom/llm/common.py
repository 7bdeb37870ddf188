"""What several corpus operators share: reading texts, cutting lineage, task-side Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.shared import shared_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut: rows come from the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def placed(df: DataFrame, n: int, key: str, *order: str) -> DataFrame:
    """df settled in n partitions by key, sorted by key and order, so that what joins it by key later moves to it.

    A plan's partitioning outlives a checkpoint only if the plan is not adaptive, so this one is planned without.
    """
    spark = df.sparkSession
    shared_dir(spark)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.repartition(n, key).sortWithinPartitions(key, *order).checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def partitions(df: DataFrame) -> int:
    """Partitions for data of about df's size: what the session asks for, or df's own count if that is higher."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def bodies(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body, *more): the whole text as UTF-8 bytes, null as no bytes."""
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body")
    return docs.select(F.col(id_col).alias("doc_id"), body, *more)


def whole_rows(docs: DataFrame) -> Column:
    """All columns of docs as one, so that none clashes with a name that an operator adds; row.* gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def text_sha(text_col: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")), 256))


def chosen(docs: DataFrame, keep: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of docs, with their own columns, one row for each of keep (doc_id, sha, n), settled: the row with that id and text.

    n is how many rows of docs have this id and text; which of them stays, if their other columns differ, is open.
    """
    rows = docs.select(whole_rows(docs), F.col(id_col).cast("long").alias("id"), text_sha(text_col).alias("own"))
    met = rows.join(keep, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("sha")))
    once = met.filter("n = 1").select("row.*")
    if keep.filter("n > 1").isEmpty():
        return once
    return once.unionByName(met.filter("n > 1").dropDuplicates(["id", "own"]).select("row.*"))


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20, col: str = "body") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about most_bytes of texts, never fewer than one row."""
    for batch in batches:
        # Lengths only: the texts themselves would be in memory twice.
        sizes = pc.binary_length(column(batch, col)).to_pylist()
        at, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most_bytes:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < batch.num_rows:
            yield batch.slice(at)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
