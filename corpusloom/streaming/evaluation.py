"""Evaluation of a stream of questions: results of each batch are there before the next is looked at."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def evaluated(questions: DataFrame, evaluate: Callable[[DataFrame], DataFrame], folder: str) -> StreamingQuery:
    """Starts a query that evaluates what is there now and ends; each batch's rows go to folder/results/batch=n.

    A batch that runs again after a failure writes the same folder anew, so no question counts twice.
    """

    def store(batch: DataFrame, number: int) -> None:
        evaluate(batch).write.mode("overwrite").parquet(f"{folder}/results/batch={number}")

    return questions.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(store).trigger(availableNow=True).start()


def progress(results: DataFrame, questions: DataFrame, query_col: str = "query_id") -> DataFrame:
    """One row: how many of the questions have results so far, and which share of all that is."""
    n = results.select(query_col).distinct().agg(F.count("*").alias("done"))
    every = questions.agg(F.count("*").alias("questions"))
    return n.join(F.broadcast(every)).withColumn("share", F.when(F.col("questions") > 0, F.col("done") / F.col("questions")).otherwise(1.0))
