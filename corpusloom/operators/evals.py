"""Evaluation of retrieval, answers and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 10
# From where on a metric is green, and from where on orange.
GREEN_ORANGE = {"mrr": (0.9, 0.75), "ndcg": (0.9, 0.75), "coverage": (90.0, 75.0), "accuracy": (4.5, 4.0), "completeness": (4.5, 4.0), "relevance": (4.5, 4.0)}


def by_keyword(results: DataFrame, questions: DataFrame, k: int = DEPTH, query_col: str = "query_id") -> DataFrame:
    """results (query_col, rank, text), questions (query_col, keywords) to (query_col, nth, keyword, mrr, ndcg).

    A keyword is found in a text that holds it, in any case, words or not. The ideal order of ndcg takes the retrieved
    texts alone, so a single hit at rank r gives 1 / log2(r + 1). mrr looks at all ranks, ndcg at the first k.
    """
    asked = questions.select(query_col, F.posexplode("keywords").alias("nth", "keyword"))
    hit = F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lower("keyword"))
    met = asked.join(results.select(query_col, "rank", "text"), query_col, "left")
    each = met.groupBy(query_col, "nth", "keyword").agg(
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.coalesce(F.sum(F.when(hit & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
        F.count_if(hit).alias("hits"),
    )
    ideal = F.aggregate(F.when(F.col("hits") > 0, F.sequence(F.lit(1).cast("long"), F.least(F.col("hits"), F.lit(k).cast("long")))).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda s, j: s + 1 / F.log2(j + 1))
    return each.select(query_col, "nth", "keyword", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.when(F.col("hits") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def by_question(each: DataFrame, questions: DataFrame, query_col: str = "query_id") -> DataFrame:
    """Means over a question's keywords; a question without keywords has zeros."""
    means = each.groupBy(query_col).agg(F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg"), F.count_if(F.col("mrr") > 0).alias("keywords_found"), F.count("*").alias("total_keywords"))
    zero = {"mrr": 0.0, "ndcg": 0.0, "keywords_found": 0, "total_keywords": 0}
    out = questions.drop("keywords").join(means, query_col, "left").fillna(zero)
    share = F.when(F.col("total_keywords") > 0, 100.0 * F.col("keywords_found") / F.col("total_keywords")).otherwise(0.0)
    return out.withColumn("keyword_coverage", share)


def means(scored: DataFrame, metrics: list[str], *by: str) -> DataFrame:
    """Means of metrics, over everything or by columns."""
    return scored.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def color(value: Column, metric: str) -> Column:
    if metric not in GREEN_ORANGE:
        return F.lit("black")
    green, orange = GREEN_ORANGE[metric]
    return F.when(value >= green, "green").when(value >= orange, "orange").otherwise("red")


def formatted(value: Column, percent: bool = False, out_of_five: bool = False) -> Column:
    return F.format_string("%.1f%%" if percent else "%.2f/5" if out_of_five else "%.4f", value)


def tile(label: str, value: Column, metric: str, percent: bool = False, out_of_five: bool = False) -> Column:
    """A metric as a line of HTML in its colour."""
    shade = color(value, metric)
    return F.concat(F.lit('<div class="metric" style="color: '), shade, F.lit(f'">{label}: '), formatted(value, percent, out_of_five), F.lit("</div>"))


def report(results: DataFrame, questions: DataFrame, query_col: str = "query_id", category_col: str = "category") -> dict[str, DataFrame]:
    """A question set evaluated in one call: results (query_col, rank, text), questions (query_col, keywords, category_col).

    Gives "questions", a row for each, "categories", the mean of mrr in each, and "summary", one row of means.
    """
    each = by_question(by_keyword(results, questions, query_col=query_col), questions, query_col)
    return {"questions": each, "categories": means(each, ["mrr"], category_col), "summary": means(each, ["mrr", "ndcg", "keyword_coverage"])}


def routed(predicted: DataFrame) -> DataFrame:
    """predicted (expected, predicted, ...) with what each row counts as in confusion(), and whether it is right."""
    e, p = F.col("expected"), F.col("predicted")
    kind = F.when(e & p, "tp").when(~e & ~p, "tn").when(~e & p, "fp").when(e & ~p, "fn")
    return predicted.withColumn("outcome", kind).withColumn("correct", e == p)


def confusion(predicted: DataFrame) -> DataFrame:
    """predicted (expected, predicted, latency) to one row: tp, tn, fp, fn, accuracy, latency."""
    e, p = F.col("expected"), F.col("predicted")
    return predicted.agg(
        F.count_if(e & p).alias("tp"), F.count_if(~e & ~p).alias("tn"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"),
        F.avg((e == p).cast("double")).alias("accuracy"), F.avg("latency").alias("latency"),
    )
