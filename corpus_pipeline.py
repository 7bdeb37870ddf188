"""A pipeline from documents to training tokens.

Low-quality documents go, of exact copies and of near copies one stays, the sources are mixed to their target weights,
and what is left is encoded. Each stage takes all rows that its predecessor kept; between stages rows are written as
Parquet in the shared folder and read again, so a lost executor never costs more than a stage, and a driver that is
started again goes on where the last one broke off, if it is given the same folder.

For all stages: a null text counts as empty, and texts are taken whole. Rows are told apart by id and text, so a
repeated id loses none of its unlike texts. Ties are broken by ids, then by content. Columns of documents, whatever
their names, pass unchanged until the last stage. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, exact_dedup, gam, mixing, simhash
from corpusloom.llm.common import read
from corpusloom.sources.shared import removed, scratch, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives a score of 0.3 or more; without usable labels all scores are 0.5 and all stay.

    A row with a null id is scored like any other, and repeated rows alike.
    """
    return gam.keep_good(docs, read(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id, a null id being the smallest; of a row that is repeated one."""
    return exact_dedup.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose fingerprints are linked the row with the smallest id, a null id being the largest."""
    return simhash.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, from never to three times; a row without words has no effect on the words due."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): a row for each row of docs; an empty text has no tokens."""
    coded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mix", mix), ("encode", encode)]

#: SQL can express neither the classifier nor the balanced sample; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The rows of the last stage. folder: where stages are written, a new one in the shared folder if none is given.

    A stage that is complete in folder is not run again. The rows of a stage are deleted once the next is written; those
    of the last stay in a folder that was given, and go with the driver otherwise.
    """
    folder = folder or scratch(spark, "pipeline")
    done = [n for n, (name, _) in enumerate(STAGES) if written(spark, f"{folder}/{name}")]
    for n, (name, stage) in enumerate(STAGES):
        if done and n <= done[-1]:
            continue
        docs = spark.read.parquet(f"{folder}/{STAGES[n - 1][0]}") if n else read(spark, sf_dir, "documents")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        if n:
            removed(spark, f"{folder}/{STAGES[n - 1][0]}")
    return spark.read.parquet(f"{folder}/{STAGES[-1][0]}")
