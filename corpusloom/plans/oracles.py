"""SQL for the engine's queries, as DuckDB runs it over the same tables."""

from __future__ import annotations

from corpusloom.functions.text import CHUNK_CHARS, OVERLAP_CHARS, SEPARATORS, TOKEN
from corpusloom.models import RuleRouter

_DOCS = "(SELECT doc_id AS id, source || '_' || doc_id || '.docx' AS document_name, text FROM documents)"
_CONVERSATIONS = "(SELECT conv_id AS id, 'conversation ' || conv_id AS title, max(turn) AS updated_at FROM conversations GROUP BY conv_id)"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{TOKEN}')"


_BM25 = f"""
d AS (SELECT doc_id, {_tokens("text")} AS toks FROM documents),
tok AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d),
post AS (SELECT doc_id, term, dl, count(*) AS tf FROM tok GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(toks)) AS a FROM d),
raw AS (SELECT term, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post, st GROUP BY term, n),
terms AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_tokens("text")}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score
      FROM q JOIN terms USING (term) JOIN post USING (term), st GROUP BY ALL),
every AS (SELECT b.item_id AS query_id, d.doc_id, round(coalesce(s.score, 0), 6) AS score
          FROM benchmark b CROSS JOIN documents d LEFT JOIN s ON s.query_id = b.item_id AND s.doc_id = d.doc_id),
top AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank, doc_id, score
        FROM every QUALIFY rank <= 10)
"""
_KEYWORDS = f"""
kw AS (SELECT query_id, keyword, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS nth FROM (
         SELECT query_id, keyword, min(pos) AS pos FROM (
           SELECT item_id AS query_id, unnest({_tokens("text")}) AS keyword, generate_subscripts({_tokens("text")}, 1) AS pos FROM benchmark)
         WHERE length(keyword) >= 5 GROUP BY ALL) QUALIFY nth <= 3),
hit AS (SELECT kw.query_id, keyword, rank, contains(lower(coalesce(text, '')), lower(keyword)) AS h
        FROM kw LEFT JOIN top USING (query_id) LEFT JOIN documents USING (doc_id)),
each AS (SELECT query_id, keyword, coalesce(1.0 / min(rank) FILTER (h), 0) AS mrr, coalesce(sum(1 / log2(rank + 1)) FILTER (h), 0) AS dcg, count(*) FILTER (h) AS m FROM hit GROUP BY ALL),
scored AS (SELECT query_id, keyword, mrr, CASE WHEN m > 0 THEN dcg / list_sum(list_transform(range(1, m + 1), lambda j: 1 / log2(j + 1))) ELSE 0 END AS ndcg FROM each),
asked AS (SELECT b.item_id AS query_id, coalesce(avg(mrr), 0) AS mrr, coalesce(avg(ndcg), 0) AS ndcg, count(*) FILTER (mrr > 0) AS keywords_found, count(keyword) AS total_keywords,
          CASE WHEN count(keyword) > 0 THEN 100.0 * count(*) FILTER (mrr > 0) / count(keyword) ELSE 0 END AS keyword_coverage
          FROM benchmark b LEFT JOIN scored ON query_id = b.item_id GROUP BY b.item_id)
"""
_NEAR = """
vq AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0),
near AS (SELECT query_id, vec_id, round(list_dot_product(v::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM vq CROSS JOIN embeddings)
"""


def _overlap(a: str, b: str) -> str:
    a, b = _tokens(a), _tokens(b)
    return f"coalesce(round(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 6), 0)"


_RETRIEVED = f"""{_NEAR},
best AS (SELECT near.query_id, row_number() OVER (PARTITION BY near.query_id ORDER BY score DESC, vec_id) AS vector_rank, vec_id AS doc_id, score AS vector_score
         FROM near JOIN documents ON doc_id = query_id QUALIFY vector_rank <= 20),
ranked AS (SELECT best.*, c.text, c.source, {_overlap("q.text", "c.text")} AS rerank_score FROM best JOIN documents c USING (doc_id) JOIN documents q ON q.doc_id = query_id),
found AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, vector_rank) AS rank, doc_id, vector_rank, vector_score, rerank_score, text, source FROM ranked QUALIFY rank <= 5)
"""


def _plain(x: str) -> str:
    words = ", ".join(f"'{w}'" for w in RuleRouter.WORDS)
    return f"(list_has_any({_tokens(x)}, [{words}]) OR len({_tokens(x)}) < 3)"


_JUDGED = f"""{_BM25},
j AS (SELECT query_id, (query_id % 4)::VARCHAR AS category,
      round(1 + 4 * {_overlap("c.text", "b.text")}, 6) AS accuracy, round(1 + 4 * {_overlap("b.text", "c.text")}, 6) AS completeness, round(1 + 4 * {_overlap("b.text", "c.text")}, 6) AS relevance
      FROM top JOIN documents c USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE rank = 1)
"""


def _color(x: str, green: float, orange: float) -> str:
    return f"CASE WHEN {x} >= {green} THEN 'green' WHEN {x} >= {orange} THEN 'orange' ELSE 'red' END"


def _recent(n: int) -> str:
    return f"SELECT conv_id AS conversation_id, turn AS id, role, text AS content FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {n}"


def _chunks(size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, separators: tuple[str, ...] = SEPARATORS) -> str:
    """CTEs that end in chunk (doc_id, chunk_index, text): a stage for each separator, then pieces put together.

    A stage cuts the texts that hold its separator before each place of it; pieces that are too long go to the next
    stage, neighbours among the others are a run. place: where a piece lies, as a list with a number for each stage.
    """
    ctes, runs = ["t1 AS (SELECT doc_id, []::BIGINT[] AS place, text AS t FROM documents WHERE text <> '')"], []
    for k, sep in enumerate(separators, 1):
        quoted = "''" if not sep else " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in sep)
        cut = f"list_transform(string_split(t, {quoted}), lambda x, i: CASE WHEN i = 1 THEN x ELSE {quoted} || x END)" if sep else "list_transform(range(1, length(t) + 1), lambda i: substring(t, i, 1))"
        holds = f"contains(t, {quoted})" if sep else "true"
        small = f"length(p) < {size}" if sep else f"length(p) <= {size}"
        ctes.append(f"""c{k} AS (SELECT doc_id, place, list_filter({cut}, lambda x: x <> '') AS ps FROM t{k} WHERE {holds}),
p{k} AS (SELECT doc_id, place, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS n FROM c{k}),
m{k} AS (SELECT *, {small} AS small, n - count(*) FILTER ({small}) OVER (PARTITION BY doc_id, place ORDER BY n) AS run FROM p{k}),
r{k} AS (SELECT doc_id, list_append(place, min(n)) AS place, list(p ORDER BY n) AS ps FROM m{k} WHERE small GROUP BY doc_id, m{k}.place, run)""")
        runs.append(f"SELECT * FROM r{k}")
        if k < len(separators):
            ctes.append(f"t{k + 1} AS (SELECT doc_id, list_append(place, n) AS place, p AS t FROM m{k} WHERE NOT small UNION ALL SELECT doc_id, list_append(place, 0), t FROM t{k} WHERE NOT ({holds}))")
    return ",\n".join(ctes) + f""",
sized AS (SELECT doc_id, place, array_to_string(ps, '') AS t, list_prepend(0, list_transform(range(1, len(ps) + 1), lambda i: list_sum(list_transform(ps[:i], lambda x: length(x)))::BIGINT)) AS e
          FROM ({" UNION ALL ".join(runs)})),
packed AS (SELECT doc_id, place, t, e, list_reduce(list_transform(range(0, len(e)), lambda i: {{'i': i, 'f': 0::BIGINT, 'o': []::BIGINT[][]}}), lambda s, y:
             CASE WHEN e[y.i] > e[s.f + 1] AND e[y.i + 1] - e[s.f + 1] > {size}
             THEN {{'i': y.i, 'o': list_append(s.o, [s.f, y.i - 1]), 'f': list_filter(range(s.f, y.i), lambda f: e[y.i] - e[f + 1] <= {overlap} AND (e[y.i] = e[f + 1] OR e[y.i + 1] - e[f + 1] <= {size}))[1]}}
             ELSE {{'i': y.i, 'o': s.o, 'f': s.f}} END) AS s FROM sized),
cut AS (SELECT doc_id, place, unnest(range(1, len(o) + 1)) AS n, unnest(list_transform(o, lambda x: regexp_replace(substring(t, e[x[1] + 1] + 1, e[x[2] + 1] - e[x[1] + 1]), '^\\s+|\\s+$', '', 'g'))) AS c
        FROM (SELECT *, list_append(s.o, [s.f, (len(e) - 1)::BIGINT]) AS o FROM packed)),
chunk AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place, n) - 1 AS chunk_index, c AS text FROM cut WHERE c <> '')"""


_NUMBER = "(doc_id % 1000)::VARCHAR"
_FIGURES = f"""fig AS (SELECT doc_id, source, u.* FROM documents, (VALUES (1, 'r1', 'word/media/one.PNG', '.png'), (2, 'r2', 'other/two', '.bin'), (3, 'r4', 'word/media/old.jpeg', '.jpeg'), (4, 'r1', 'word/media/one.PNG', '.png')) u(position, relationship_id, source_path, ending)),
named AS (SELECT *, doc_id || '_' || printf('%06d', position) || ending AS filename, md5(CASE relationship_id WHEN 'r1' THEN repeat('1', (doc_id % 1000 + 1)::INT) WHEN 'r2' THEN coalesce(source, '') ELSE 'old' END) AS md5 FROM fig),
marks AS (SELECT doc_id, list('[Figure: ' || filename || ']' || chr(10) || chr(10) || 'Image Description:' || chr(10) || '<empty>' ORDER BY position) AS m FROM named GROUP BY doc_id)"""


def _values(rows: str, names: str) -> str:
    return f"SELECT * FROM (VALUES {rows}) t({names})"


ORACLES = {
    "bm25_saved_index": f"WITH {_BM25} SELECT query_id, rank, doc_id, score FROM top",
    "knn_topk_filtered": "WITH vq AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 100 = 0), near AS (SELECT query_id, vec_id, round(list_dot_product(v::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM vq CROSS JOIN embeddings WHERE label = 3) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM near QUALIFY rank <= 5",
    "embed_documents": "SELECT doc_id, 64 AS size, 1.0::DOUBLE AS norm FROM documents",
    "chunk_by_id": f"SELECT id || ':0' AS chunk_id, id AS document_id, document_name, text FROM {_DOCS} WHERE id = 7",
    "path_parts": r"WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages) SELECT page_id, regexp_extract(path, '([^/]*)$', 1) AS basename, coalesce(nullif(lower(regexp_extract(path, '[^/.][^/]*?(\.[^./]+)$', 1)), ''), '.bin') AS suffix FROM p",
    "prompts_with_question": "SELECT item_id AS query_id, md5(chr(10) || '===== SOURCE =====' || chr(10) || 'Document: q_' || item_id || chr(10) || 'Chunk: ' || item_id || ':2' || chr(10) || chr(10) || text || '!' || chr(10) || chr(10) || chr(10) || 'This is user question:' || chr(10) || text) AS md5 FROM benchmark",
    "point_ids": "SELECT count(*) AS points, count(DISTINCT doc_id) AS ids, count(*) AS paired, count(*) AS whole FROM documents",
    "request_checks": _values("('page', '0', true), ('page', '1', false), ('page_size', '-1', true), ('page_size', '5', false), ('title', '0', true), ('title', '1', false), ('title', '100', false), ('title', '101', true)", "what, value, refused"),
    "router_details": f"""WITH r AS (SELECT doc_id, quality = 1 AS expected, NOT {_plain("text")} AS predicted, text FROM documents JOIN labels USING (doc_id))
        SELECT doc_id, expected, predicted, CASE WHEN expected AND predicted THEN 'tp' WHEN NOT expected AND NOT predicted THEN 'tn' WHEN NOT expected AND predicted THEN 'fp' WHEN expected AND NOT predicted THEN 'fn' END AS outcome,
        expected = predicted AS correct, md5(CASE WHEN predicted THEN coalesce(trim(text, ' '), '') ELSE '' END) AS query_md5 FROM r""",
    "stage_seconds": _values("('history', true, true), ('router', true, true), ('retrieval', true, true), ('llm', true, true), ('total', true, true)", "stage, fits, add_up"),
    "chat_answers": "SELECT conv_id AS conversation_id, substring(text, 1, 200) AS answer, 0 AS n_references FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "stream_eval_questions": f"WITH {_BM25}, {_KEYWORDS} SELECT query_id, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, keywords_found, total_keywords, round(keyword_coverage, 6) AS keyword_coverage FROM asked",
    "parse_docx_details": f"""WITH {_FIGURES} SELECT doc_id, array_to_string(['doc ' || {_NUMBER} || chr(9) || 'after tab' || chr(10) || 'after break' || chr(10) || 'end', 'see ' || source || chr(9) || 'keptflat',
        'a | ' || {_NUMBER} || ' b', 'in | ' || {_NUMBER} || ' z', 'before', m[1], 'between', m[2], 'after', m[3], m[4]], chr(10) || chr(10)) AS text, NULL::VARCHAR AS error FROM documents JOIN marks USING (doc_id)""",
    "parse_docx_figures": f"WITH {_FIGURES} SELECT filename, relationship_id, source_path, position, md5 FROM named",
    "broken_docx": "SELECT 26 AS n, 2 AS fine, 24 AS without_text",
    "markdown_round_trip": "SELECT source || '_' || doc_id || '.md' AS document_name, md5(text) AS md5 FROM documents WHERE text <> ''",
    "question_set_round_trip": f"""WITH {_BM25}, {_KEYWORDS}, own AS (SELECT query_id, string_agg(keyword, ',' ORDER BY nth) AS k FROM kw WHERE nth <= 3 GROUP BY query_id)
        SELECT DISTINCT text AS question, coalesce(k, '') AS keywords, md5('It is: ' || text) AS answer_md5, (item_id % 4)::VARCHAR AS category, '' AS history, item_id % 2 = 0 AS expected_use_rag FROM benchmark LEFT JOIN own ON query_id = item_id""",
    "conversation_set_round_trip": "SELECT conv_id::VARCHAR AS id, (conv_id % 3)::VARCHAR AS category, count(*) AS n, md5(string_agg(text, '|' ORDER BY turn)) AS md5 FROM conversations GROUP BY conv_id",
    "create_collection": "SELECT 0 AS before, count(*) AS points, count(DISTINCT label) AS documents FROM embeddings",
    "library_upload": "SELECT 'broken.docx' AS document_name, true AS error, count(*) AS documents, 4 * count(*) AS images, count(*) AS chunks, count(*) AS vectors, count(*) AS documents_there, 4 * count(*) AS images_there, count(*) AS chunks_there, count(*) AS vectors_there, count(*) AS files_there, 'ok' AS health FROM documents",
    "library_documents": f"""SELECT * FROM (SELECT 'page' AS what, document_name, (SELECT count(*) FROM documents) AS n FROM {_DOCS} ORDER BY document_name LIMIT 5 OFFSET 5) UNION ALL
        SELECT * FROM (SELECT 'search', document_name, count(*) OVER () FROM {_DOCS} WHERE document_name ILIKE '%SRC3_%' ORDER BY document_name LIMIT 4) UNION ALL
        SELECT 'download', 'src3_3.docx|doc 3' || chr(9) || 'after tab', 1 UNION ALL SELECT 'image', '1111', 1""",
    "library_delete": "WITH n AS (SELECT count(*) - 1 AS n FROM documents) SELECT 'documents' AS what, n FROM n UNION ALL SELECT 'files', n FROM n UNION ALL SELECT 'images', 4 * n FROM n UNION ALL SELECT 'lone images', 0 UNION ALL SELECT 'folders gone', 5",
    "library_conversations": """WITH a AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS n FROM benchmark)
        SELECT n AS conversation_id, CASE WHEN n = 2 THEN 'renamed' ELSE 'hello ' || item_id END AS title, 'user:hello ' || item_id || '|assistant:hello ' || item_id || CASE WHEN n > 1 THEN '|user:thanks a lot|assistant:thanks a lot' ELSE '' END AS messages FROM a WHERE n <> 3""",
    "chunk_documents": f"WITH {_chunks()} SELECT doc_id || ':' || chunk_index AS id, doc_id, chunk_index, text FROM chunk",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, rank, doc_id, score FROM top",
    "term_stats": f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "tokenize_docs": f"SELECT doc_id, len({_tokens('text')}) AS n_tokens, array_to_string({_tokens('text')}, ' ') AS tokens FROM documents",
    "knn_topk": "WITH s AS (SELECT e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0) SELECT row_number() OVER (ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s QUALIFY rank <= 20",
    "knn_topk_batch": f"WITH {_NEAR} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM near QUALIFY rank <= 20",
    "ordered_id_lookup": "SELECT pos, doc_id, source FROM (VALUES (0, 42), (1, 7), (2, -1), (3, 7), (4, 19), (5, 0)) t(pos, doc_id) JOIN documents USING (doc_id)",
    "retrieve_rerank": f"WITH {_RETRIEVED} SELECT query_id, rank, doc_id, vector_rank, vector_score, rerank_score FROM found",
    "build_context": f"""WITH {_RETRIEVED} SELECT query_id, string_agg(chr(10) || '===== SOURCE =====' || chr(10) || 'Document: ' || source || '_' || doc_id || '.docx' || chr(10) || 'Chunk: ' || doc_id || ':0' || chr(10) || chr(10) || text || chr(10),
        chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM found GROUP BY query_id""",
    "list_documents_page": f"SELECT id, document_name FROM {_DOCS} ORDER BY document_name, id LIMIT 20 OFFSET 20",
    "list_documents_total": "SELECT count(*) AS total FROM documents",
    "search_documents_page": "SELECT page_id, url FROM pages WHERE url ILIKE '%BLOG%' ORDER BY url, page_id LIMIT 10 OFFSET 10",
    "search_documents_total": "SELECT count(*) AS total FROM pages WHERE url ILIKE '%BLOG%'",
    "document_by_id": f"SELECT * FROM {_DOCS} WHERE id = 7",
    "document_by_name": f"SELECT id, document_name FROM {_DOCS} WHERE document_name = 'src3_3.docx'",
    "chunks_by_ids": f"SELECT id || ':0' AS chunk_id, id AS document_id, document_name FROM {_DOCS} WHERE id IN (3, 5)",
    "documents_with_images": f"SELECT d.id, document_name, count(page_id) AS n_images, coalesce(string_agg(url, ',' ORDER BY page_id), '') AS filenames FROM {_DOCS} d LEFT JOIN pages ON page_id % 100 = d.id GROUP BY ALL",
    "unknown_labels": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "delete_document_vectors": "SELECT vec_id, label FROM embeddings WHERE label <> 3 OR label IS NULL",
    "delete_document_cascade": """WITH gone AS (SELECT doc_id FROM documents WHERE source = 'src3')
        SELECT 'documents' AS table_name, count(*) AS n FROM documents WHERE doc_id NOT IN (FROM gone) UNION ALL
        SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (FROM gone) UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id NOT IN (FROM gone)""",
    "delete_conversation": "SELECT conv_id AS conversation_id, count(*) AS n, 'conversation ' || conv_id AS title FROM conversations WHERE conv_id <> 3 GROUP BY conv_id",
    "rename_conversation": f"SELECT id, CASE WHEN id = 3 THEN 'A new title' ELSE title END AS title, CASE WHEN id = 3 THEN 1000 ELSE updated_at END AS updated_at FROM {_CONVERSATIONS}",
    "append_message": "SELECT conv_id AS id, CASE WHEN conv_id % 2 = 0 THEN 500 ELSE max(turn) END AS updated_at, count(*) + (conv_id % 2 = 0)::INT AS n FROM conversations GROUP BY conv_id",
    "upsert_vectors": """WITH new AS (SELECT CASE WHEN vec_id % 2 = 0 THEN vec_id ELSE vec_id + 100000000 END AS id, label + 100 AS label FROM embeddings WHERE vec_id % 3 = 0)
        SELECT id, label::BIGINT AS label FROM new UNION ALL SELECT vec_id, label::BIGINT FROM embeddings WHERE vec_id NOT IN (SELECT id FROM new)""",
    "recent_messages": _recent(10),
    "recent_messages_3": _recent(3),
    "stream_recent_messages": _recent(3),
    "conversation_with_messages": "SELECT conv_id AS id, 'conversation ' || conv_id AS title, string_agg(turn || ':' || role, ',' ORDER BY turn) AS messages FROM conversations GROUP BY conv_id",
    "conversation_by_id": "SELECT conv_id AS id, 'conversation ' || conv_id AS title, count(*) AS n FROM conversations WHERE conv_id = 2 GROUP BY conv_id",
    "conversations_by_updated": f"SELECT id, title, updated_at FROM {_CONVERSATIONS} ORDER BY updated_at DESC, id",
    "invalid_roles": "SELECT conv_id AS conversation_id, turn AS id, role FROM conversations WHERE role NOT IN ('user', 'assistant') OR role IS NULL",
    "conversation_titles": r"SELECT conv_id AS conversation_id, coalesce(nullif(regexp_replace(substring(text, 1, 100), '^\s+|\s+$', '', 'g'), ''), 'New Conversation') AS title FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1",
    "chat_messages": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations),
        asked AS (SELECT conv_id, text, {_plain("text")} AS plain FROM r WHERE n = 1),
        past AS (SELECT conv_id, string_agg(role || ':' || text || '|', '' ORDER BY turn) AS h, count(*) AS m FROM r WHERE n BETWEEN 2 AND 4 GROUP BY conv_id)
        SELECT conv_id AS conversation_id, NOT plain AS use_rag, 2 + coalesce(m, 0) AS n_messages,
        md5(coalesce(h, '') || 'user:' || CASE WHEN plain THEN text ELSE coalesce(nullif(trim(text, ' '), ''), text) END) AS md5 FROM asked LEFT JOIN past USING (conv_id)""",
    "eval_keywords": f"WITH {_BM25}, {_KEYWORDS} SELECT query_id, keyword, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM scored",
    "eval_questions": f"WITH {_BM25}, {_KEYWORDS} SELECT query_id, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, keywords_found, total_keywords, round(keyword_coverage, 6) AS keyword_coverage FROM asked",
    "eval_by_category": f"WITH {_BM25}, {_KEYWORDS} SELECT (query_id % 4)::VARCHAR AS category, round(avg(mrr), 6) AS mrr FROM asked GROUP BY 1",
    "eval_summary": f"WITH {_BM25}, {_KEYWORDS}, m AS (SELECT avg(mrr) AS mrr, avg(ndcg) AS ndcg, avg(keyword_coverage) AS c FROM asked) SELECT round(mrr, 6) AS mrr, {_color('mrr', 0.9, 0.75)} AS mrr_color, {_color('ndcg', 0.9, 0.75)} AS ndcg_color, printf('%.1f%%', round(c, 6)) AS coverage, {_color('c', 90, 75)} AS coverage_color FROM m",
    "eval_progress": "SELECT item_id AS query_id, (item_id % 4)::VARCHAR AS category, round(row_number() OVER (PARTITION BY item_id % 4 ORDER BY item_id) / count(*) OVER (PARTITION BY item_id % 4), 6) AS done FROM benchmark",
    "eval_answers": f"WITH {_JUDGED}, m AS (SELECT avg(accuracy) AS a, avg(completeness) AS c, avg(relevance) AS r FROM j) SELECT round(a, 5) AS accuracy, round(c, 5) AS completeness, round(r, 5) AS relevance, {_color('a', 4.5, 4.0)} AS color FROM m",
    "eval_answers_by_category": f"WITH {_JUDGED} SELECT category, round(avg(accuracy), 5) AS accuracy FROM j GROUP BY category",
    "router_confusion": f"""WITH r AS (SELECT quality = 1 AS e, NOT {_plain("text")} AS p, n_chars FROM documents JOIN labels USING (doc_id))
        SELECT count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND NOT p) AS tn, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn,
        round(avg((e = p)::INT), 6) AS accuracy, round(avg(n_chars), 2) AS latency FROM r""",
    "figure_refs": r"SELECT doc_id, array_to_string(regexp_extract_all('See [Figure: img_' || doc_id || '.png] and [Figure: ' || source || '] but not [Figure: ] ' || coalesce(text, ''), '\[Figure: ([^\]]+)\]', 1), ',') AS figures FROM documents",
    "chunk_invariants": r"SELECT doc_id, true AS fit, true AS numbered FROM documents WHERE regexp_replace(coalesce(text, ''), '\s', '', 'g') <> ''",
    "parse_docx_round_trip": r"""SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B-\x1F]', '', 'g'), chr(10)),
        lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10) || chr(10))) AS md5, 0 AS n_images FROM documents""",
}
