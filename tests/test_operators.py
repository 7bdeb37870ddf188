import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import schema
from corpusloom.models import EchoGenerator, HashEmbedder, OverlapReranker, RuleRouter, embedded
from corpusloom.operators import bm25, catalog, chat, evals, retrieve, vector
from corpusloom.sources import tables


def brute_bm25(query, docs):
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: r if r >= 0 else 0.25 * mean for w, r in raw.items()}
    return [sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in query) for d in docs]


def test_bm25_with_repeats_unknown_words_and_no_match(spark):
    texts = ["the cat sat", "the dog the dog", "the cat and the dog ran far", "", "the bird"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = spark.createDataFrame([(1, "cat cat dog xyzzy"), (2, "nothing here")], "query_id long, text string")
    got = {(r.query_id, r.doc_id): (r.rank, r.score) for r in bm25.topk(queries, docs, k=4).collect()}
    want = brute_bm25(["cat", "cat", "dog", "xyzzy"], [t.split() for t in texts])
    best = sorted(range(5), key=lambda i: (-round(want[i], 6), -i))[:4]
    assert [d for (q, d), _ in sorted(got.items(), key=lambda x: x[1]) if q == 1] == best
    for d in best:
        assert got[1, d][1] == pytest.approx(want[d], abs=1e-6)
    assert sorted(d for q, d in got if q == 2) == [1, 2, 3, 4] and all(got[2, d][1] == 0 for d in (1, 2, 3, 4))


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x y x"), ("b", "y"), ("c", None)], "chunk_id string, text string")
    index = bm25.build(docs, "chunk_id")
    tables.save_index(index, str(tmp_path))
    again = tables.load_index(spark, str(tmp_path))
    assert (again.n_docs, again.avgdl) == (index.n_docs, index.avgdl) == (3, 4 / 3)
    assert again.postings.exceptAll(index.postings).count() == 0 and again.terms.count() == 2
    assert set(again.postings.columns) == set(schema.POSTING.names) and set(again.terms.columns) == set(schema.TERM.names)
    assert bm25.build(docs.limit(0), "chunk_id").avgdl == 0


def test_knn_of_unlike_sizes_and_by_shares(spark, monkeypatch):
    rows = [(i, [math.cos(i), math.sin(i)]) for i in range(50)] + [(60, [1.0]), (61, []), (62, [None, 1.0]), (63, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0]), (8, [2.0]), (7, [1.0, 0.0, 0.0]), (6, None)], "query_id long, vector array<double>")
    got = sorted(map(tuple, vector.knn_batch(asked, table, 3).collect()))
    assert [r[:3] for r in got if r[0] == 8] == [(8, 1, 60)] and {r[0] for r in got} == {8, 9}
    monkeypatch.setattr(vector, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, vector.knn_batch(asked, table, 3).collect())) == got
    odd = vector.knn_batch(asked, table, 3, where=F.col("vec_id") % 2 == 1).collect()
    assert {r.vec_id % 2 for r in odd} == {1} and len(odd) == 3


def test_knn_forms_agree(spark):
    rows = [(i, [math.cos(i), math.sin(i)]) for i in range(50)] + [(50, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = vector.knn(spark.createDataFrame([([1.0, 0.0],)], "vector array<double>"), table.filter("embedding is not null"), 5)
    many = vector.knn_batch(spark.createDataFrame([(9, [1.0, 0.0]), (8, [0.0, 1.0])], "query_id long, vector array<double>"), table, 5, block=1)
    want = sorted(range(50), key=lambda i: (-round(math.cos(i), 6), i))[:5]
    assert [r.vec_id for r in one.orderBy("rank").collect()] == want
    assert [r.vec_id for r in many.filter("query_id = 9").orderBy("rank").collect()] == want


@pytest.mark.parametrize("share", [False, True])
def test_knn_batch_is_brute_force_over_many_blocks(spark, monkeypatch, share):
    """Ties, copies, a long and a tiny vector, zeros; each task sends k rows of a query at most."""
    monkeypatch.setattr(vector, "ROW_BLOCK", 32)
    monkeypatch.setattr(vector, "SPREAD_BYTES", 0)
    if share:
        monkeypatch.setattr(vector, "BROADCAST_BYTES", -1)
    rng = np.random.default_rng(5)
    b = rng.normal(size=(700, 8))
    b /= np.linalg.norm(b, axis=1)[:, None]
    b[100:300], b[300:340], b[350], b[351] = b[7], np.round(b[300:340], 1), b[9] * 1e18, b[9] * 1e-40
    a = np.concatenate([b[:40], rng.normal(size=(5, 8)), np.zeros((1, 8))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "query_id long, vector array<double>")
    got = vector.knn_batch(asked, table, 6, block=7)
    score = np.round(a @ b.T, 6)
    want = [(q, n, int(i)) for q in range(len(a)) for n, i in enumerate(np.lexsort((np.arange(700), -score[q]))[:6], 1)]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got.collect()) == want
    best = vector._Best(np.arange(len(a)), 6)
    for at in range(0, 700, 32):
        best.add(a, np.arange(at, min(at + 32, 700)), b[at : at + 32])
    sent = best.rows(["q", "i", "s"])
    assert sent.num_rows == 6 * len(a) and sorted(zip(sent[0].to_pylist(), sent[1].to_pylist())) == sorted((q, i) for q, _, i in want)
    odd = vector._Best(np.arange(2), 3)
    odd.add(np.array([[1.0], [np.nan]]), np.array([4, 5]), np.array([[2.0], [np.inf]]))
    assert odd.rows(["q", "i", "s"]).column(1).to_pylist() == [5, 4, 4, 5]


def test_retrieve_prepares_each_text_once(spark, monkeypatch):
    """Forty questions meet the same twenty chunks; a chunk's copies for its questions come to five."""
    monkeypatch.setattr(retrieve, "HOT", 8)
    made = spark.sparkContext.accumulator(0)

    class Counting(OverlapReranker):
        def prepared(self, text):
            @F.udf("array<string>")
            def run(x):
                made.add(1)
                return sorted(set((x or "").split()))

            return run(text)

    asked = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} x", [1.0, 0.1 * i]) for i in range(40)], "query_id long, question string, vector array<double>")
    rows = spark.createDataFrame([(i, [1.0, float(i % 5)]) for i in range(20)], "vec_id long, embedding array<double>")
    chunks = spark.createDataFrame([(i, f"w{i} w{i % 4} y" if i else None) for i in range(20)], "doc_id long, text string").coalesce(1)
    got = retrieve.retrieve(asked, rows, chunks, Counting()).select("query_id", "rank", "doc_id", "vector_rank", "rerank_score", "question", "text").persist()
    # A question is prepared where it is, and may be again where a plan repeats its scan.
    assert got.count() == 200 and made.value <= 20 + 2 * 40
    pairs = vector.knn_batch(asked, rows, 20).withColumnRenamed("vec_id", "doc_id").join(chunks, "doc_id").join(asked.select("query_id", "question"), "query_id")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(map(tuple, retrieve.rerank(pairs, OverlapReranker()).select(got.columns).collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_retrieve_counts_each_row_of_a_chunk_and_sends_texts_of_the_best_only(spark, monkeypatch, few):
    monkeypatch.setattr(retrieve, "BROADCAST_ROWS", few)
    asked = spark.createDataFrame([(i, "x y", [1.0, 0.0]) for i in range(400)], "query_id long, question string, vector array<double>")
    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "vec_id long, embedding array<double>")
    rng = np.random.default_rng(1)
    chunks = spark.createDataFrame([(i, "x y " * (i % 3) + rng.bytes(3000).hex()) for i in [*range(20), 19]] + [(2, "x y"), (2, "x y")], "doc_id long, text string")

    def work():
        found = retrieve.retrieve(asked, rows, chunks, OverlapReranker()).select("query_id", "rank", "doc_id", "rerank_score", "text", "question").collect()
        # The two rows that are the same come first, then those with the next score by the ranks of their vectors.
        assert [(r.rank, r.doc_id, r.text == "x y") for r in sorted(found) if r.query_id == 7] == [(1, 2, True), (2, 2, True), (3, 1, False), (4, 2, False), (5, 4, False)]
        assert len(found) == 2000 and {r.question for r in found} == {"x y"}

    assert _sent(spark, work) < 15_000_000


def test_rerank_is_stable_and_empty(spark):
    rows = [(1, r, "a b", t) for r, t in enumerate(["b", "a", "a b", "c"], 1)]
    c = spark.createDataFrame(rows, "query_id long, rank long, question string, text string")
    assert [r.text for r in retrieve.rerank(c, OverlapReranker(), 3).orderBy("rank").collect()] == ["a b", "b", "a"]
    assert retrieve.rerank(c.limit(0), OverlapReranker()).count() == 0


def test_lookup_keeps_order_and_repeats(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    got = retrieve.ordered_lookup(spark.createDataFrame([([2, 5, 1, 2],)], "ids array<long>"), t).orderBy("pos").collect()
    assert [(r.pos, r.text) for r in got] == [(0, "b"), (2, "a"), (3, "b")]


def test_pages_and_guards(spark):
    t = spark.createDataFrame([(i, f"n{i % 3}%") for i in range(7)], "id long, name string")
    assert [r.id for r in catalog.page(t, "name", "id", 2, 3).collect()] == [1, 4, 2]
    assert catalog.page(t, "name", "id", 9, 3).collect() == []
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            catalog.page(t, "name", "id", *bad)
    assert catalog.matching(t, "name", "N1").count() == 2 and catalog.matching(t, "name", "%").count() == 7
    with pytest.raises(catalog.NotFound):
        catalog.required(t, "id", 99)
    with pytest.raises(catalog.Conflict):
        catalog.absent(t, "name", "n1%")
    catalog.absent(t, "name", "new")


def test_rename(spark):
    c = spark.createDataFrame([(1, "a", None), (2, "b", None)], "id long, title string, updated_at timestamp")
    got = {r.id: r for r in catalog.renamed(c, 2, " x\t").collect()}
    assert got[2].title == "x" and got[2].updated_at and got[1].title == "a" and got[1].updated_at is None
    for bad in (" \n", "y" * 101):
        with pytest.raises(ValueError):
            catalog.renamed(c, 2, bad)


def test_tables(spark, tmp_path):
    path = str(tmp_path / "v")
    tables.create_table(spark, path, schema.VECTOR)
    tables.create_table(spark, path, schema.VECTOR)
    chunks = spark.createDataFrame([("d:0", "d", [1.0]), ("d:1", "d", [2.0])], "id string, document_id string, vector array<float>")
    points = tables.vector_points(chunks)
    tables.append(points, path, schema.VECTOR)
    again = tables.upserted(spark.read.parquet(path), points.withColumn("vector", F.array(F.lit(3.0).cast("float"))))
    assert sorted(r.vector for r in again.collect()) == [[3.0], [3.0]]


def test_question_sets(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"question": "q", "keywords": ["a", "b"], "reference_answer": "r", "category": "c"}\n')
    (tmp_path / "r.jsonl").write_text('{"question": "q", "history": "", "expected_use_rag": true}\n')
    (tmp_path / "c.json").write_text('[\n{"id": "1", "category": "c", "questions": ["x", "y"]}\n]')
    (tmp_path / "one.json").write_text('{\n"id": "1", "category": "c", "questions": ["x"]\n}')
    assert tables.read_questions(spark, str(tmp_path / "q.jsonl")).first().keywords == ["a", "b"]
    assert tables.read_router_set(spark, str(tmp_path / "r.jsonl")).first().expected_use_rag is True
    assert tables.read_conversation_set(spark, str(tmp_path / "c.json")).first().questions == ["x", "y"]
    assert tables.read_conversation_set(spark, str(tmp_path / "one.json")).count() == 1
    (tmp_path / "m" / "n").mkdir(parents=True)
    (tmp_path / "m" / "n" / "a.md").write_text("x\ny")
    assert [tuple(r) for r in tables.read_markdown(spark, str(tmp_path / "m")).collect()] == [("a.md", "x\ny")]


def test_metrics_by_hand(spark):
    results = spark.createDataFrame([(1, 1, "none"), (1, 2, "Cached"), (1, 3, "cache x"), (2, 1, "a")], "query_id long, rank long, text string")
    questions = spark.createDataFrame([(1, ["cache", "zzz"]), (2, []), (3, ["k"])], "query_id long, keywords array<string>")
    each = evals.by_keyword(results, questions)
    got = {r.query_id: r for r in evals.by_question(each, questions).collect()}
    dcg = 1 / math.log2(3) + 1 / math.log2(4)
    assert got[1].mrr == pytest.approx(0.25) and got[1].ndcg == pytest.approx(dcg / (1 + 1 / math.log2(3)) / 2)
    assert (got[1].keywords_found, got[1].total_keywords, got[1].keyword_coverage) == (1, 2, 50.0)
    assert (got[2].mrr, got[2].ndcg, got[2].total_keywords, got[2].keyword_coverage) == (0, 0, 0, 0)
    assert (got[3].mrr, got[3].keyword_coverage) == (0, 0)


def test_depth_limits_ndcg_only(spark):
    results = spark.createDataFrame([(1, r, "k" if r == 12 else "") for r in range(1, 13)], "query_id long, rank long, text string")
    row = evals.by_keyword(results, spark.createDataFrame([(1, ["k"])], "query_id long, keywords array<string>")).first()
    assert row.mrr == pytest.approx(1 / 12) and row.ndcg == 0


@pytest.mark.parametrize("metric, value, want", [("mrr", 0.9, "green"), ("ndcg", 0.75, "orange"), ("coverage", 74.9, "red"), ("accuracy", 4.5, "green"), ("relevance", 3.9, "red"), ("other", 1.0, "black")])
def test_colors(spark, metric, value, want):
    row = spark.range(1).select(evals.color(F.lit(value), metric).alias("c"), evals.tile("T", F.lit(value), metric).alias("t")).first()
    assert row.c == want and f"{value:.4f}" in row.t and want in row.t


def test_formats(spark):
    row = spark.range(1).select(evals.formatted(F.lit(87.25), percent=True).alias("p"), evals.formatted(F.lit(4.456), out_of_five=True).alias("f")).first()
    assert row.p in ("87.2%", "87.3%") and row.f == "4.46/5"


def test_chat(spark):
    docs = ["alpha beta gamma [Figure: a.png]", "delta epsilon zeta", "eta theta iota"]
    chunks = spark.createDataFrame([(f"d{i}:0", f"d{i}.docx", t) for i, t in enumerate(docs)], "id string, document_name string, text string")
    vectors = chunks.select(F.xxhash64("id").alias("id"), embedded(HashEmbedder(), F.col("text")).alias("vector"), F.col("id").alias("chunk_id"))
    messages = spark.createDataFrame([(i, 1, "user" if i % 2 else "assistant", f"m{i}") for i in range(1, 14)], "id long, conversation_id long, role string, content string")
    requests = spark.createDataFrame([(1, "alpha beta gamma"), (2, "translate this text please")], "conversation_id long, question string")
    out = chat.chat(requests, messages, vectors, chunks, HashEmbedder(), OverlapReranker(), RuleRouter(), EchoGenerator()).cache()
    got = {r.conversation_id: r for r in out.collect()}
    assert got[1].use_rag and not got[2].use_rag
    assert [m.content for m in got[1].messages[1:-1]] == [f"m{i}" for i in range(4, 14)]
    last = got[1].messages[-1].content
    assert last.startswith("\n===== SOURCE =====\nDocument: d0.docx\nChunk: d0:0\n\nalpha") and last.endswith("This is user question:\nalpha beta gamma")
    assert got[1].response.references[0].document_name == "d0.docx" and got[1].response.references[0].images == ["a.png"]
    assert [m.role for m in got[2].messages] == ["system", "user"] and got[2].messages[-1].content == "translate this text please"
    added = chat.new_messages(out).filter("conversation_id = 2").orderBy("nth").collect()
    assert [(m.role, m.content) for m in added] == [("user", "translate this text please"), ("assistant", "translate this text please")]


def test_no_request_needs_retrieval(spark):
    chunks = spark.createDataFrame([("d:0", "d", "t")], "id string, document_name string, text string")
    vectors = chunks.select(F.xxhash64("id").alias("id"), embedded(HashEmbedder(), F.col("text")).alias("vector"), F.col("id").alias("chunk_id"))
    none = spark.createDataFrame([], "id long, conversation_id long, role string, content string")
    out = chat.chat(spark.createDataFrame([(1, "hello")], "conversation_id long, question string"), none, vectors, chunks, HashEmbedder(), OverlapReranker(), RuleRouter(), EchoGenerator())
    assert [r.use_rag for r in out.collect()] == [False]


def test_confusion(spark):
    rows = [(True, True, 1.0), (True, False, 2.0), (False, False, 3.0), (False, True, 6.0), (True, True, 3.0)]
    row = evals.confusion(spark.createDataFrame(rows, "expected boolean, predicted boolean, latency double")).first()
    assert tuple(row) == (2, 1, 1, 1, 0.6, 3.0)
    assert evals.confusion(spark.createDataFrame([], "expected boolean, predicted boolean, latency double")).first().accuracy is None


def _sent(spark, work):
    """Bytes that the stages of work have shuffled."""

    def total():
        jvm = spark.sparkContext
        stages = jvm._jsc.sc().statusStore().stageList(None, False, False, jvm._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    work()
    return total() - before


def test_bm25_sends_no_postings(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "array_join(transform(sequence(1, 100), x -> concat('word', (x * (id % 89 + 1)) % 199)), ' ') as text").persist()
    queries = spark.createDataFrame([(i, f"word{i} word{i + 1} word7") for i in range(20)], "query_id long, text string")
    docs.count()
    assert _sent(spark, lambda: bm25.topk(queries, docs).collect()) < 1_000_000


def test_bm25_of_ids_that_come_again(spark):
    rows = [(1, "cat dog"), (1, "cat bird"), (1, "cat"), (2, "dog dog fish"), (3, "cat fish bird cow"), (4, None), (5, "cow cow cow dog ox")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "cat cat bird"), (2, "dog"), (3, "none")], "query_id long, text string")
    one = sorted(tuple(r) for r in bm25.topk(queries, docs, 3).collect())
    assert one == sorted(tuple(r) for r in bm25.topk_of(queries, bm25.build(docs), docs.select("doc_id").distinct(), 3).collect())
    post = {(r.doc_id, r.term, r.dl): r.tf for r in bm25.postings(docs).collect()}
    assert post[1, "cat", 2] == 2 and post[1, "cat", 1] == 1 and len(post) == 13


def test_bm25_rounds_as_sql(spark):
    values = [0.0000005, 1.0000015, 2.5e-7, 123.4567885, 3.1234565, -0.0000015, -2.0000005]
    want = [r[0] for r in spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, i int").orderBy("i").select(F.round("v", 6)).collect()]
    assert (bm25._key(np.array(values)) / 10**6).tolist() == want
