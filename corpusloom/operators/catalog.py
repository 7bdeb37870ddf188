"""The catalog of documents and conversations: lookups, pages, search, and changes as new versions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import stripped

ROLES, HISTORY = ("user", "assistant"), 10


class NotFound(LookupError):
    """There is no such row."""


class Conflict(ValueError):
    """There is such a row already."""


def _checked(page: int, page_size: int) -> int:
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    return (page - 1) * page_size


def by_value(table: DataFrame, column: str, value) -> DataFrame:
    """The row with the value, or none."""
    return table.filter(F.col(column) == F.lit(value)).limit(1)


def by_ids(table: DataFrame, column: str, ids: list) -> DataFrame:
    return table.filter(F.col(column).isin(ids))


def page(table: DataFrame, order: str, tie: str, page: int = 1, page_size: int = 10) -> DataFrame:
    return table.orderBy(order, tie).offset(_checked(page, page_size)).limit(page_size)


def total(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("total"))


def matching(table: DataFrame, column: str, keyword: str) -> DataFrame:
    """Rows whose column holds the keyword, in any case; % and _ in it are wildcards."""
    return table.filter(F.col(column).ilike(f"%{keyword}%"))


def required(table: DataFrame, column: str, value) -> DataFrame:
    """The row with the value; an error if there is none."""
    found = by_value(table, column, value)
    if found.isEmpty():
        raise NotFound(f"no {column} {value!r}")
    return found


def absent(table: DataFrame, column: str, value) -> None:
    """An error if there is a row with the value; to be called before anything is written."""
    if not by_value(table, column, value).isEmpty():
        raise Conflict(f"{column} {value!r} exists")


def known(rows: DataFrame, table: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """rows whose key is in table: many existence checks at once."""
    return rows.join(table.select(F.col(other or key).alias(key)), key, "left_semi")


def unknown(rows: DataFrame, table: DataFrame, key: str, other: str | None = None) -> DataFrame:
    return rows.join(table.select(F.col(other or key).alias(key)), key, "left_anti")


def with_images(documents: DataFrame, images: DataFrame) -> DataFrame:
    """Documents with all their images; none is an empty list."""
    listed = images.groupBy(F.col("document_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("id").alias("image_id"), "filename"))).alias("images"))
    empty = F.array().cast("array<struct<image_id:bigint,filename:string>>")
    return documents.join(listed, "id", "left").withColumn("images", F.coalesce("images", empty))


def without(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame, id_col: str = "id") -> dict[str, DataFrame]:
    """New versions of tables (table, key) without the rows of ids: one cascade over all that hang on a document or conversation.

    All are to be written before any replaces its old version, so that readers never see a part of the change.
    """
    gone = ids.select(F.col(id_col).alias("__gone")).distinct()
    return {name: t.join(gone, F.col(key) == F.col("__gone"), "left_anti") for name, (t, key) in tables.items()}


def renamed(conversations: DataFrame, id_value, new_title: str, at: Column | None = None) -> DataFrame:
    """Conversations with one title changed and its time touched; a title of white space is refused."""
    if not new_title.strip():
        raise ValueError("a title can't be empty")
    if len(new_title) > 100:
        raise ValueError("a title has 100 characters at most")
    this = F.col("id") == F.lit(id_value)
    out = conversations.withColumn("title", F.when(this, stripped(F.lit(new_title))).otherwise(F.col("title")))
    return out.withColumn("updated_at", F.when(this, F.current_timestamp() if at is None else at).otherwise(F.col("updated_at")))


def bad_roles(messages: DataFrame) -> DataFrame:
    return messages.filter(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)))


def good_roles(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("role").isin(*ROLES))


def appended(conversations: DataFrame, messages: DataFrame, new: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Messages with new ones of valid roles and existing conversations, and conversations with their time touched."""
    fit = known(good_roles(new), conversations, "conversation_id", "id")
    touched = fit.select(F.col("conversation_id").alias("id")).distinct().withColumn("__now", at)
    moved = conversations.join(touched, "id", "left").withColumn("updated_at", F.coalesce("__now", "updated_at")).drop("__now")
    return moved, messages.unionByName(fit.select(messages.columns))


def recent(messages: DataFrame, n: int = HISTORY, key: str = "conversation_id", order: str = "id") -> DataFrame:
    """The last n messages of each conversation, to be read by rising order."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return messages.withColumn("__n", F.row_number().over(last)).filter(F.col("__n") <= n).drop("__n")


def with_messages(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with all their messages by rising id; none is an empty list."""
    listed = messages.groupBy(F.col("conversation_id").alias("__of")).agg(F.sort_array(F.collect_list(F.struct("id", "role", "content"))).alias("messages"))
    empty = F.array().cast("array<struct<id:bigint,role:string,content:string>>")
    return conversations.join(listed, F.col("id") == F.col("__of"), "left").drop("__of").withColumn("messages", F.coalesce("messages", empty))


def by_updated(conversations: DataFrame) -> DataFrame:
    return conversations.orderBy(F.desc("updated_at"), "id")
