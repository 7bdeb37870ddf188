"""The engine's queries over the driver's tables.

A document is one chunk here where a query has an oracle; its name is source_id.docx. A conversation's time is its
largest turn, a message's id its turn. A question is a row of benchmark, its keywords the first three tokens of five
letters or more.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom import schema
from corpusloom.functions import text
from corpusloom.models import EchoGenerator, HashEmbedder, OverlapJudge, OverlapReranker, RuleRouter, embedded
from corpusloom.operators import bm25, catalog, chat, evals, retrieve, vector
from corpusloom.service import Library, Uploaded
from corpusloom.sources import docx, loose, tables
from corpusloom.sources.shared import scratch
from corpusloom.sources.tables import load
from corpusloom.streaming import evaluation, history

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("document_name"), "text")


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").select(F.col("turn").alias("id"), F.col("conv_id").alias("conversation_id"), "role", F.col("text").alias("content"))


def _conversations(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("title"), F.max("turn").alias("updated_at"))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return _asked(load(spark, sf, "benchmark"))


def _asked(benchmark: DataFrame) -> DataFrame:
    asked = benchmark.select(F.col("item_id").alias("query_id"), "text")
    return asked.withColumn("keywords", F.slice(F.array_distinct(F.filter(text.tokens(F.col("text")), lambda t: F.length(t) >= 5)), 1, 3))


def _vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector with an id divisible by 100; its question is the document of the same id."""
    near = load(spark, sf, "embeddings").filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return near.join(load(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question")), "query_id")


@query
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.topk(_questions(spark, sf).select("query_id", "text"), load(spark, sf, "documents"))


@query
def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    return bm25.frequencies(bm25.document_frequencies(docs), docs.count()).select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_saved_index(spark: SparkSession, sf: str) -> DataFrame:
    """The same as bm25_topk from an index that is written, and read again."""
    docs, folder = load(spark, sf, "documents"), scratch(spark, "index")
    tables.save_index(bm25.build(docs), folder)
    return bm25.topk_of(_questions(spark, sf).select("query_id", "text"), tables.load_index(spark, folder), docs.select("doc_id"))


@query
def tokenize_docs(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


@query
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "embeddings")
    return vector.knn(rows.filter("vec_id = 0").select(F.col("embedding").alias("vector")), rows, 20)


@query
def knn_topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "embeddings")
    return vector.knn_batch(rows.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), rows, 20)


@query
def knn_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest rows among those with one label only."""
    rows = load(spark, sf, "embeddings")
    asked = rows.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector.knn_batch(asked, rows, 5, where=F.col("label") == 3)


@query
def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's vector by a test double, as its number of parts that aren't zero and its length."""
    v = embedded(HashEmbedder(), F.col("text"))
    parts = load(spark, sf, "documents").select("doc_id", v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return parts.select("doc_id", F.size("v").cast("long").alias("size"), F.round(norm, 4).alias("norm"))


@query
def ordered_id_lookup(spark: SparkSession, sf: str) -> DataFrame:
    ids = spark.range(1).select(F.array(*[F.lit(i).cast("long") for i in (42, 7, -1, 7, 19, 0)]).alias("ids"))
    return retrieve.ordered_lookup(ids, load(spark, sf, "documents").select("doc_id", "source")).select(F.col("pos").cast("long").alias("pos"), "doc_id", "source")


def _retrieved(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _documents(spark, sf).withColumnRenamed("id", "doc_id")
    return retrieve.retrieve(_vector_queries(spark, sf), load(spark, sf, "embeddings"), chunks, OverlapReranker())


@query
def retrieve_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return _retrieved(spark, sf).select("query_id", "rank", "doc_id", "vector_rank", "vector_score", "rerank_score")


@query
def build_context(spark: SparkSession, sf: str) -> DataFrame:
    return retrieve.build_context(_retrieved(spark, sf).withColumn("chunk_id", text.chunk_id(F.col("doc_id"), F.lit(0))))


@query
def list_documents_page(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.page(_documents(spark, sf), "document_name", "id", 2, 20).select("id", "document_name")


@query
def list_documents_total(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.total(_documents(spark, sf))


@query
def search_documents_page(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.page(catalog.matching(load(spark, sf, "pages"), "url", "BLOG"), "url", "page_id", 2, 10).select("page_id", "url")


@query
def search_documents_total(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.total(catalog.matching(load(spark, sf, "pages"), "url", "BLOG"))


@query
def document_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.by_value(_documents(spark, sf), "id", 7)


@query
def document_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.by_value(_documents(spark, sf), "document_name", "src3_3.docx").select("id", "document_name")


@query
def chunks_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    chunks = docs.select(text.chunk_id(F.col("id"), F.lit(0)).alias("chunk_id"), F.col("id").alias("document_id"))
    return retrieve.with_document(catalog.by_ids(chunks, "chunk_id", ["3:0", "5:0", "none"]), docs).select("chunk_id", "document_id", "document_name")


@query
def chunk_by_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    chunks = docs.select(text.chunk_id(F.col("id"), F.lit(0)).alias("chunk_id"), F.col("id").alias("document_id"), "text")
    return retrieve.with_document(catalog.by_value(chunks, "chunk_id", "7:0"), docs).select("chunk_id", "document_id", "document_name", "text")


@query
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Base names and endings of the paths of all pages."""
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return load(spark, sf, "pages").select("page_id", text.basename(path).alias("basename"), text.suffix(path).alias("suffix"))


@query
def prompts_with_question(spark: SparkSession, sf: str) -> DataFrame:
    """A context of one source with the question after it, for every question."""
    block = retrieve.source_block(F.concat(F.lit("q_"), F.col("query_id").cast("string")), text.chunk_id(F.col("query_id"), F.lit(2)), F.concat("text", F.lit("!")))
    return _questions(spark, sf).select("query_id", F.md5(retrieve.with_question(block, F.col("text"))).alias("md5"))


@query
def point_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of chunks with their vectors in one row: as many as documents, none twice."""
    chunks = load(spark, sf, "documents").select(text.chunk_id(F.col("doc_id"), F.lit(0)).alias("id"), F.col("doc_id").cast("string").alias("document_id"), embedded(HashEmbedder(8), F.col("text")).alias("vector"))
    points = tables.vector_points(chunks)
    return points.agg(F.count("*").alias("points"), F.countDistinct("id").alias("ids"), F.count_if(F.col("chunk_id") == F.concat("document_id", F.lit(":0"))).alias("paired"), F.count_if(F.size("vector") == 8).alias("whole"))


@query
def request_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Which pages and titles are refused."""

    def refused(work: Callable[[], object]) -> bool:
        try:
            work()
        except ValueError:
            return True
        return False

    docs, convs = _documents(spark, sf), _conversations(spark, sf)
    found = [("page", str(n), refused(lambda: catalog.page(docs, "document_name", "id", n, 5))) for n in (0, 1)]
    found += [("page_size", str(n), refused(lambda: catalog.page(docs, "document_name", "id", 1, n))) for n in (-1, 5)]
    found += [("title", str(n), refused(lambda: catalog.renamed(convs, 1, "x" * n, F.lit(1).cast("long")))) for n in (0, 1, 100, 101)]
    return spark.createDataFrame(found, "what string, value string, refused boolean")


@query
def documents_with_images(spark: SparkSession, sf: str) -> DataFrame:
    """Pages stand for images: page k belongs to document k modulo 100."""
    images = load(spark, sf, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 100).alias("document_id"), F.col("url").alias("filename"))
    out = catalog.with_images(_documents(spark, sf).select("id", "document_name"), images)
    return out.select("id", "document_name", F.size("images").cast("long").alias("n_images"), F.array_join(F.transform("images", lambda i: i["filename"]), ",").alias("filenames"))


@query
def unknown_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without labels: many existence checks at once."""
    return catalog.unknown(load(spark, sf, "documents").select("doc_id"), load(spark, sf, "labels"), "doc_id")


@query
def delete_document_vectors(spark: SparkSession, sf: str) -> DataFrame:
    gone = spark.range(3, 4)
    return catalog.without({"v": (load(spark, sf, "embeddings"), "label")}, gone)["v"].select("vec_id", "label")


@query
def delete_document_cascade(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    gone = docs.filter("document_name like 'src3#_%' escape '#'").select("id")
    left = catalog.without({"documents": (docs, "id"), "labels": (load(spark, sf, "labels"), "doc_id"), "vectors": (load(spark, sf, "embeddings"), "vec_id")}, gone)
    counts = [t.agg(F.lit(name).alias("table_name"), F.count("*").alias("n")) for name, t in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def delete_conversation(spark: SparkSession, sf: str) -> DataFrame:
    left = catalog.without({"m": (_messages(spark, sf), "conversation_id"), "c": (_conversations(spark, sf), "id")}, spark.range(3, 4))
    return left["m"].groupBy("conversation_id").agg(F.count("*").alias("n")).join(left["c"].select(F.col("id").alias("conversation_id"), "title"), "conversation_id")


@query
def rename_conversation(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.renamed(_conversations(spark, sf), 3, " \tA new title\n", F.lit(1000).cast("long"))


@query
def append_message(spark: SparkSession, sf: str) -> DataFrame:
    """A message for each conversation and for one that doesn't exist; those of odd conversations have a bad role."""
    conversations, messages = _conversations(spark, sf), _messages(spark, sf)
    ids = conversations.select("id").unionByName(spark.range(999_999_999, 1_000_000_000))
    new = ids.select(F.lit(500).cast("long").alias("id"), F.col("id").alias("conversation_id"), F.when(F.col("id") % 2 == 0, "user").otherwise("system").alias("role"), F.lit("ok").alias("content"))
    moved, grown = catalog.appended(conversations, messages, new, F.lit(500).cast("long"))
    n = grown.groupBy(F.col("conversation_id").alias("id")).agg(F.count("*").alias("n"))
    return moved.join(n, "id").select("id", "updated_at", "n")


@query
def upsert_vectors(spark: SparkSession, sf: str) -> DataFrame:
    old = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"))
    new = old.filter("id % 3 = 0").select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 100_000_000).alias("id"), (F.col("label") + 100).alias("label"))
    return tables.upserted(old, new)


def _recent(spark: SparkSession, sf: str, n: int) -> DataFrame:
    return catalog.recent(_messages(spark, sf), n).select("conversation_id", "id", "role", "content")


@query
def recent_messages(spark: SparkSession, sf: str) -> DataFrame:
    return _recent(spark, sf, 10)


@query
def recent_messages_3(spark: SparkSession, sf: str) -> DataFrame:
    return _recent(spark, sf, 3)


@query
def stream_recent_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The same last three messages from a stream of all conversations, of each conversation its last update."""
    path, folder = f"{sf}/conversations.parquet", scratch(spark, "stream")
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    rows = rows.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"))

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream = history.last_messages(rows, 3).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(store)
    stream.trigger(availableNow=True).start().awaitTermination()
    every = spark.read.parquet(f"{folder}/out")
    last = every.withColumn("newest", F.max("batch").over(Window.partitionBy("conversation_id"))).filter("batch = newest")
    return last.select("conversation_id", "id", "role", "content")


@query
def conversation_with_messages(spark: SparkSession, sf: str) -> DataFrame:
    out = catalog.with_messages(_conversations(spark, sf), _messages(spark, sf))
    return out.select("id", "title", F.array_join(F.transform("messages", lambda m: F.concat(m["id"].cast("string"), F.lit(":"), m["role"])), ",").alias("messages"))


@query
def conversation_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.with_messages(catalog.by_value(_conversations(spark, sf), "id", 2), _messages(spark, sf)).select("id", "title", F.size("messages").cast("long").alias("n"))


@query
def conversations_by_updated(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.by_updated(_conversations(spark, sf)).select("id", "title", "updated_at")


@query
def invalid_roles(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.bad_roles(_messages(spark, sf)).select("conversation_id", "id", "role")


@query
def conversation_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles made of each conversation's first message."""
    first = Window.partitionBy("conversation_id").orderBy("id")
    rows = _messages(spark, sf).withColumn("n", F.row_number().over(first)).filter("n = 1")
    return rows.select("conversation_id", text.title_of_question(F.col("content")).alias("title"))


@query
def chat_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts for each conversation's last message, after the three before it."""
    last = Window.partitionBy("conversation_id").orderBy(F.desc("id"))
    rows = _messages(spark, sf).withColumn("n", F.row_number().over(last))
    asked = rows.filter("n = 1").select("conversation_id", F.col("content").alias("question"))
    full = asked.join(chat.histories(rows.filter("n > 1"), 3), "conversation_id", "left")
    none = F.array().cast("array<struct<role:string,content:string>>")
    full = full.withColumn("route", RuleRouter().route(F.col("question"), F.col("history")))
    query_ = text.standalone_query(F.col("route.rewritten_query"), F.col("question"))
    full = full.withColumn("m", chat.prompt(F.col("route.use_rag"), F.coalesce("history", none), query_))
    flat = F.array_join(F.transform(F.slice("m", 2, 100), lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")
    return full.select("conversation_id", F.col("route.use_rag").alias("use_rag"), F.size("m").cast("long").alias("n_messages"), F.md5(flat).alias("md5"))


def _by_keyword(spark: SparkSession, sf: str) -> DataFrame:
    found = F.broadcast(bm25_topk(spark, sf)).join(load(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return evals.by_keyword(found, _questions(spark, sf))


def _by_question(spark: SparkSession, sf: str) -> DataFrame:
    return evals.by_question(_by_keyword(spark, sf), _questions(spark, sf).select("query_id", "keywords"))


@query
def eval_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return _by_keyword(spark, sf).select("query_id", "keyword", F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"))


@query
def eval_questions(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(_by_question(spark, sf))


def _scored(each: DataFrame) -> DataFrame:
    return each.select("query_id", F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"), F.col("keywords_found").cast("long").alias("keywords_found"), F.col("total_keywords").cast("long").alias("total_keywords"), F.round("keyword_coverage", 6).alias("keyword_coverage"))


@query
def stream_eval_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The same as eval_questions from a stream of the questions, each batch evaluated when it comes."""
    path, folder = f"{sf}/benchmark.parquet", scratch(spark, "stream")
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")
    docs = load(spark, sf, "documents")
    index = bm25.build(docs)

    def evaluate(batch: DataFrame) -> DataFrame:
        asked = _asked(batch)
        found = F.broadcast(bm25.topk_of(asked.select("query_id", "text"), index, docs.select("doc_id"))).join(docs.select("doc_id", "text"), "doc_id")
        return evals.report(found, asked.select("query_id", "keywords", F.lit("").alias("category")))["questions"]

    evaluation.evaluated(rows, evaluate, folder).awaitTermination()
    return _scored(spark.read.parquet(f"{folder}/results"))


@query
def eval_by_category(spark: SparkSession, sf: str) -> DataFrame:
    """A question's category is its id modulo 4."""
    scored = _by_question(spark, sf).withColumn("category", (F.col("query_id") % 4).cast("string"))
    return evals.means(scored, ["mrr"], "category").select("category", F.round("mrr", 6).alias("mrr"))


@query
def eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    m = evals.means(_by_question(spark, sf), ["mrr", "ndcg", "keyword_coverage"])
    return m.select(F.round("mrr", 6).alias("mrr"), evals.color(F.col("mrr"), "mrr").alias("mrr_color"), evals.color(F.col("ndcg"), "ndcg").alias("ndcg_color"), evals.formatted(F.round("keyword_coverage", 6), percent=True).alias("coverage"), evals.color(F.col("keyword_coverage"), "coverage").alias("coverage_color"))


@query
def eval_progress(spark: SparkSession, sf: str) -> DataFrame:
    """How far an evaluation has come with each question, by rising id within its category."""
    own = Window.partitionBy("category")
    rows = _questions(spark, sf).select("query_id", (F.col("query_id") % 4).cast("string").alias("category"))
    return rows.withColumn("done", F.round(F.row_number().over(own.orderBy("query_id")) / F.count("*").over(own), 6))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """Answers are the best document's text, references the question's; a test double judges."""
    found = F.broadcast(bm25_topk(spark, sf).filter("rank = 1")).join(load(spark, sf, "documents").select("doc_id", F.col("text").alias("answer")), "doc_id")
    asked = found.join(_questions(spark, sf).select("query_id", F.col("text").alias("question")), "query_id")
    return asked.withColumn("j", OverlapJudge().judge(F.col("question"), F.col("answer"), F.col("question"))).select("query_id", (F.col("query_id") % 4).cast("string").alias("category"), "j.*")


@query
def eval_answers(spark: SparkSession, sf: str) -> DataFrame:
    m = evals.means(_judged(spark, sf), ["accuracy", "completeness", "relevance"])
    return m.select(*[F.round(c, 5).alias(c) for c in ("accuracy", "completeness", "relevance")], evals.color(F.col("accuracy"), "accuracy").alias("color"))


@query
def eval_answers_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return evals.means(_judged(spark, sf), ["accuracy"], "category").select("category", F.round("accuracy", 5).alias("accuracy"))


@query
def router_confusion(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id")
    route = RuleRouter().route(F.col("text"), F.lit(None))
    rows = docs.select((F.col("quality") == 1).alias("expected"), route["use_rag"].alias("predicted"), F.col("n_chars").cast("double").alias("latency"))
    out = evals.confusion(rows)
    return out.select("tp", "tn", "fp", "fn", F.round("accuracy", 6).alias("accuracy"), text.seconds(F.col("latency")).alias("latency"))


@query
def router_details(spark: SparkSession, sf: str) -> DataFrame:
    """Each row of router_confusion by itself."""
    docs = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id")
    route = RuleRouter().route(F.col("text"), F.lit(None))
    rows = docs.select("doc_id", (F.col("quality") == 1).alias("expected"), route["use_rag"].alias("predicted"), route["rewritten_query"].alias("query"))
    return evals.routed(rows).select("doc_id", "expected", "predicted", "outcome", "correct", F.md5(F.coalesce("query", F.lit(""))).alias("query_md5"))


@query
def stage_seconds(spark: SparkSession, sf: str) -> DataFrame:
    """Which stages of a batch of chats are timed, and whether their times add up to the whole's and have two digits."""
    last = Window.partitionBy("conversation_id").orderBy(F.desc("id"))
    rows = _messages(spark, sf).withColumn("n", F.row_number().over(last))
    asked = rows.filter("n = 1").select("conversation_id", F.col("content").alias("question"))
    vectors = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), text.chunk_id(F.col("vec_id"), F.lit(0)).alias("chunk_id"))
    docs = _documents(spark, sf)
    chunks = docs.select(text.chunk_id(F.col("id"), F.lit(0)).alias("id"), "document_name", "text")
    took: dict[str, float] = {}
    size = len(vectors.first()["vector"])
    chat.chat(asked, rows.filter("n > 1"), vectors, chunks, HashEmbedder(size), OverlapReranker(), RuleRouter(), EchoGenerator(), took)
    parts = sum(v for k, v in took.items() if k != "total")
    return spark.createDataFrame([(k, round(v, 2) == v and 0 <= v <= took["total"] + 0.05, parts <= took["total"] + 0.05) for k, v in took.items()], "stage string, fits boolean, add_up boolean")


@query
def chat_answers(spark: SparkSession, sf: str) -> DataFrame:
    """What the test double says to each conversation's last message without retrieval: its first 200 characters."""
    last = Window.partitionBy("conversation_id").orderBy(F.desc("id"))
    rows = _messages(spark, sf).withColumn("n", F.row_number().over(last)).filter("n = 1")
    none = F.array().cast("array<struct<role:string,content:string>>")
    said = EchoGenerator().answer(chat.prompt(F.lit(False), none, F.col("content")))
    return rows.select("conversation_id", said["answer"].alias("answer"), F.size(said["references"]).cast("long").alias("n_references"))


@query
def figure_refs(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.concat(F.lit("See [Figure: img_"), F.col("doc_id").cast("string"), F.lit(".png] and [Figure: "), F.col("source"), F.lit("] but not [Figure: ] "), F.coalesce("text", F.lit("")))
    return load(spark, sf, "documents").select("doc_id", F.array_join(text.figure_refs(marked), ",").alias("figures"))


def _chunked(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    cut = docs.select("doc_id", F.col("text").alias("whole"), F.posexplode(text.chunks(F.col("text"))).alias("chunk_index", "text"))
    return cut.withColumn("id", text.chunk_id(F.col("doc_id"), F.col("chunk_index")))


@query
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _chunked(spark, sf).select("id", "doc_id", "chunk_index", "text")


@query
def chunk_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Of each document with any text: chunks are short, stripped, parts of it, and numbered without gaps."""
    ok = (F.length("text") <= 1000) & F.contains("whole", "text") & (text.stripped(F.col("text")) == F.col("text")) & (F.length("text") > 0)
    return _chunked(spark, sf).groupBy("doc_id").agg(F.bool_and(ok).alias("fit"), (F.max("chunk_index") + 1 == F.count("*")).alias("numbered"))


def _zipped(body: str, *parts: tuple[str, str | bytes]) -> bytes:
    names = f'xmlns:w="{docx.W[1:-1]}" xmlns:a="{docx.A[1:-1]}" xmlns:r="{docx.R[1:-1]}" xmlns:v="{docx.V[1:-1]}"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {names}><w:body>{body}</w:body></w:document>")
        for name, content in parts:
            z.writestr(name, content)
    return out.getvalue()


def _as_docx(lines: str) -> bytes:
    return _zipped("".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in lines.split("\n")))


def _rich_docx(name: str, number: int, source: str) -> bytes:
    """A document with tabs, breaks, a link, a table with empty cells and a table inside, content that only the fallback
    reads, a picture that is used twice, one by the older way, one without an ending, an external one and an unknown one."""
    n, s = str(number), escape(source or "")
    t = lambda x: f'<w:t xml:space="preserve">{x}</w:t>'
    p = lambda *runs: f"<w:p>{''.join(runs)}</w:p>"
    r = lambda *inside: f"<w:r>{''.join(inside)}</w:r>"
    cell = lambda *inside: f"<w:tc>{''.join(inside)}</w:tc>"
    row = lambda *cells: f"<w:tr>{''.join(cells)}</w:tr>"
    picture = lambda rel, how="embed": f'<w:drawing><a:blip r:{how}="{rel}"/></w:drawing>'
    inner = f"<w:tbl>{row(cell(p(r(t('in')))), cell(p(r(t(n)))))}</w:tbl>"
    body = p(r(t(f" doc {n}"), "<w:tab/>", t("after tab"), "<w:br/>", t("after break"), "<w:cr/>", t("end ")))
    body += p(r(t("see ")), f"<w:hyperlink>{r(t(s), '<w:tab/>')}</w:hyperlink>", f"<w:ins>{r(t('kept'), '<w:tab/>', t('flat'))}</w:ins>")
    body += f"<w:tbl>{row(cell(p(r(t('a')))), cell(p()), cell(p(r(t(n))), p(r(t('b')))))}{row(cell(p()), cell(p(r(t(' ')))))}{row(cell(inner, p(r(t('z')))))}</w:tbl>"
    body += f"<w:sdt>{p(r(t('lost')))}</w:sdt>" + p() + p(r(t("before "), picture("r1"), t(" between"), picture("r2", "link")), r(picture("r3")), r(picture("r9")), r(t("after")))
    body += p(r('<w:pict><v:imagedata r:id="r4"/></w:pict>'), r(picture("r1")))
    kind = f'Type="{docx.IMAGE_TYPE}"'
    rels = f'<Relationship Id="r1" {kind} Target="media/one.PNG"/><Relationship Id="r2" {kind} Target="../other/two"/><Relationship Id="r3" {kind} Target="http://x/y.png" TargetMode="External"/><Relationship Id="r4" {kind} Target="media/./old.jpeg"/><Relationship Id="r5" Type="styles" Target="styles.xml"/>'
    return _zipped(body, ("word/_rels/document.xml.rels", f"<Relationships>{rels}</Relationships>"), ("word/media/one.PNG", b"1" * (number + 1)), ("other/two", (source or "").encode()), ("word/media/old.jpeg", b"old"))


def _made_docx(rows: DataFrame, make: Callable[..., bytes]) -> DataFrame:
    """rows (document_name, ...) to (document_name, content): make of each row's columns, the name first if it takes it."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, docx.ROWS):
                part = batch.slice(at, docx.ROWS)
                content = [make(*x) for x in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(content, pa.binary())], ["document_name", "content"])

    return rows.mapInArrow(made, "document_name string, content binary")


def _rich(spark: SparkSession, sf: str) -> DataFrame:
    return _made_docx(load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_name"), (F.col("doc_id") % 1000).alias("number"), "source"), _rich_docx)


@query
def parse_docx_details(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a Word file with all that the parser knows: the whole text."""
    return docx.parsed(_rich(spark, sf)).select(F.col("document_name").cast("long").alias("doc_id"), "text", "error")


@query
def parse_docx_figures(spark: SparkSession, sf: str) -> DataFrame:
    """The figures of these files, written as files of their own and read again."""
    parsed, folder = docx.parsed(_rich(spark, sf)), scratch(spark, "figures")
    tables.write_files(tables.figures(parsed).select(loose.spread(F.col("filename")).alias("path"), "content"), folder)
    files = loose.read(spark, folder, "*_0*").select(text.basename(F.col("path")).alias("filename"), F.md5("content").alias("md5"))
    return tables.figures(parsed).join(files, "filename").select("filename", "relationship_id", "source_path", F.col("position").cast("long").alias("position"), "md5")


@query
def broken_docx(spark: SparkSession, sf: str) -> DataFrame:
    """A file cut at all lengths, what is no file, no document, no XML, and whole ones: a row for each, with an error but for the whole ones."""
    whole = _zipped("<w:p/>")
    files = [whole[: len(whole) * k // 20] for k in range(21)] + [whole, None, _zipped("<w:p>"), b"PK", whole.replace(b"word/document.xml", b"word/documents.xm")]
    rows = docx.parsed(spark.createDataFrame([(str(i), c) for i, c in enumerate(files)], "document_name string, content binary"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("error").isNull()).alias("fine"), F.count_if(F.col("text").isNull()).alias("without_text"))


@query
def markdown_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of the largest ids' source written as Markdown, a folder for each, and read again."""
    folder, docs = scratch(spark, "markdown"), load(spark, sf, "documents")
    parsed = docs.select(F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("document_name"), "text")
    tables.write_files(parsed.select(F.concat(F.lit("deep/"), loose.spread(F.col("document_name"))).alias("path"), F.coalesce("text", F.lit("")).alias("content")), folder)
    return tables.read_markdown(spark, folder).select("document_name", F.md5("text").alias("md5"))


@query
def question_set_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Question sets as JSON Lines, written and read with their schemas."""
    folder, asked = scratch(spark, "questions"), _questions(spark, sf)
    asked.select(F.col("text").alias("question"), "keywords", F.concat(F.lit("It is: "), "text").alias("reference_answer"), (F.col("query_id") % 4).cast("string").alias("category"), F.lit(1).alias("more")).write.json(folder)
    asked.select(F.col("text").alias("question"), F.lit("").alias("history"), (F.col("query_id") % 2 == 0).alias("expected_use_rag")).write.json(f"{folder}-router")
    first, second = tables.read_questions(spark, folder), tables.read_router_set(spark, f"{folder}-router")
    both = first.join(second.dropDuplicates(), "question").dropDuplicates()
    return both.select("question", F.array_join("keywords", ",").alias("keywords"), F.md5("reference_answer").alias("answer_md5"), "category", "history", "expected_use_rag")


@query
def conversation_set_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as files with one JSON array each."""
    folder = scratch(spark, "sets")
    rows = _messages(spark, sf).groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("id", "content"))).alias("m"))
    made = rows.select(F.col("conversation_id").cast("string").alias("id"), (F.col("conversation_id") % 3).cast("string").alias("category"), F.transform("m", lambda x: x["content"]).alias("questions"))
    blocks = made.groupBy((F.col("id").cast("long") % 8).alias("block")).agg(F.sort_array(F.collect_list(F.struct("*"))).alias("all"))
    tables.write_files(blocks.select(F.concat(F.col("block").cast("string"), F.lit(".json")).alias("path"), F.to_json("all").alias("content")), folder)
    return tables.read_conversation_set(spark, folder).select("id", "category", F.size("questions").cast("long").alias("n"), F.md5(F.array_join("questions", "|")).alias("md5"))


@query
def create_collection(spark: SparkSession, sf: str) -> DataFrame:
    """A collection made twice, filled in between; the second time changes nothing."""
    path = f"{scratch(spark, 'collection')}/vectors"
    rows = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("document_id"), F.lit("").alias("chunk_id"))
    tables.create_table(spark, path, schema.VECTOR)
    before = spark.read.parquet(path).count()
    tables.append(rows, path, schema.VECTOR)
    tables.create_table(spark, path, schema.VECTOR)
    return spark.read.parquet(path).agg(F.lit(before).cast("long").alias("before"), F.count("*").alias("points"), F.countDistinct("document_id").alias("documents"))


def _library(spark: SparkSession, sf: str) -> tuple[Library, Uploaded]:
    """A library of all documents as Word files with their first figure, and of one file that isn't a document."""
    root = scratch(spark, "library")
    docs = load(spark, sf, "documents").select(F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("document_name"), (F.col("doc_id") % 1000).alias("number"), "source")
    files = _made_docx(docs, _rich_docx).unionByName(spark.createDataFrame([("broken.docx", b"broken")], "document_name string, content binary"))
    tables.write_files(files.select(F.concat(F.lit("in/"), loose.spread(F.col("document_name"))).alias("path"), "content"), root)
    out = Library(spark, f"{root}/library", HashEmbedder(16), OverlapReranker(), RuleRouter(), EchoGenerator())
    return out, out.upload(f"{root}/in")


@query
def library_upload(spark: SparkSession, sf: str) -> DataFrame:
    """What an upload says that it has written, against what is there."""
    out, said = _library(spark, sf)
    there = lambda name: F.lit(out.table(name).count())
    error = said.errors.select("document_name", F.col("error").isNotNull().alias("error"))
    return error.select("document_name", "error", F.lit(said.documents).cast("long").alias("documents"), F.lit(said.images).cast("long").alias("images"), F.lit(said.chunks).cast("long").alias("chunks"), F.lit(said.vectors).cast("long").alias("vectors"), *[there(n).cast("long").alias(f"{n}_there") for n in ("documents", "images", "chunks", "vectors", "files")], F.lit(out.health()["status"]).alias("health"))


@query
def library_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Pages, search, one file as it was uploaded, one image."""
    out, _ = _library(spark, sf)
    page, total = out.documents(2, 5)
    hits, found = out.search("SRC3_", 1, 4)
    one = out.table("documents").filter("document_name = 'src3_3.docx'").first()["id"]
    name, content = out.download(one).first()
    text_ = docx.parse(name, bytes(content))["text"].split("\n")[0]
    image = out.image("src3_3.docx_000001.png").first()["content"]
    rows = page.select(F.lit("page").alias("what"), "document_name", F.lit(total).cast("long").alias("n")).unionByName(hits.select(F.lit("search").alias("what"), "document_name", F.lit(found).cast("long").alias("n")))
    return rows.unionByName(spark.createDataFrame([("download", f"{name}|{text_}", 1), ("image", bytes(image).decode(), 1)], rows.schema))


@query
def library_delete(spark: SparkSession, sf: str) -> DataFrame:
    """One document deleted, then what no version needs: rows that are left, and folders on disk."""
    out, _ = _library(spark, sf)
    out.delete_document(out.table("documents").filter("document_name = 'src3_3.docx'").first()["id"])
    gone = out.vacuum()
    lone = out.table("images").join(out.table("documents").select(F.col("id").alias("document_id")), "document_id", "left_anti").count()
    rows = [(name, out.table(name).count()) for name in ("documents", "files", "images")]
    return spark.createDataFrame([*rows, ("lone images", lone), ("folders gone", gone)], "what string, n long")


@query
def library_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """A question without retrieval from every conversation: answers, a second question, renaming, deletion."""
    asked = [r[0] for r in load(spark, sf, "benchmark").select("item_id").orderBy("item_id").collect()]
    out = Library(spark, f"{scratch(spark, 'library')}/library", HashEmbedder(16), OverlapReranker(), RuleRouter(), EchoGenerator())
    numbers = [r.conversation_id for r in out.chat([(None, f"hello {i}") for i in asked]).orderBy("conversation_id").collect()]
    out.chat([(n, "thanks a lot") for n in numbers[1:]])
    out.rename(numbers[1], "  renamed ")
    out.delete_conversation(numbers[2])
    one = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")
    m = out.table("messages").groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("id", "role", "content"))).alias("m"))
    listed = out.conversations().select(F.col("id").alias("conversation_id"), "title")
    return listed.join(m, "conversation_id").select("conversation_id", "title", one.alias("messages"))


@query
def parse_docx_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a Word file with a paragraph for each line, parsed again."""
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0B-\x1F]", "")
    rows = load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_name"), clean.alias("text"))
    parsed = docx.parsed(_made_docx(rows, lambda _, lines: _as_docx(lines)))
    return parsed.select(F.col("document_name").cast("long").alias("doc_id"), F.md5("text").alias("md5"), F.size("images").cast("long").alias("n_images"))
