"""The queries op1 to op10 over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, embedding_dedup, exact_dedup, gam, hmm, license_scan, mixing, simhash, substring_dedup, suffix_dedup
from corpusloom.llm.common import read
from corpusloom.llm.license_rules import BASE, BASE_SCORE, RULES, SCORES, Rule


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    spans = F.floor(F.size("edges") / 2).cast("long")
    return found.select("doc_id", "n_bytes", "n_removed", spans.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_components(read(spark, sf_dir, "embeddings"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.take(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(read(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_suffix_dedup, op3_embedding_dedup, op4_bpe, op5_substring_dedup, op6_hmm_scoring, op7_mixing, op8_quality_classifier, op9_simhash_near_dedup, op10_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    """The others are beyond SQL: tests hold them against brute-force versions."""
    return {"op1_license_scan": op1_sql(), "op2_suffix_dedup": OP2, "op3_embedding_dedup": OP3, "op5_substring_dedup": OP5, "op10_exact_dedup": OP10}


def op1_sql() -> str:
    """Words are two spaces apart, so that matches, with a space on either side each, never share one."""
    wide = lambda p: p.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?")
    text = lambda x: "'" + x.replace("'", "''") + "'"
    row = lambda base, r: f"({base}, {r.priority}, {r.number}, {text(r.label)}, {text(r.keyword)}, [{', '.join(map(text, r.words))}], {text(f' ({wide(r.pattern)}) ')})"
    rules = [row("true", Rule(-1 - i, label, 9, "licen", (phrase,), phrase)) for i, (phrase, label) in enumerate(BASE)] + [row("false", r) for r in RULES]
    worth = " ".join(f"WHEN priority = {p} THEN {s}" for p, s in SCORES.items())
    upper = "".join(map(chr, range(65, 91)))
    return rf"""
WITH rules(base, priority, rule, label, keyword, own, pattern) AS (VALUES {", ".join(rules)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
n AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS plain, '  ' || array_to_string(w, '  ') || '  ' AS wide FROM d),
marked AS (SELECT doc_id, base, priority, rule, label, string_split(substring(regexp_replace(wide, pattern, ' ' || chr(1) || '\1' || chr(2) || ' ', 'g'), 3), '  ') AS m
           FROM n JOIN rules ON contains(plain, keyword) AND len(list_filter(own, lambda o: contains(plain, o))) > 0 AND regexp_matches(wide, pattern)),
places AS (SELECT doc_id, base, priority, rule, label, unnest(list_filter(range(len(m)), lambda i: starts_with(m[i + 1], chr(1)))) AS first,
           unnest(list_filter(range(len(m)), lambda i: ends_with(m[i + 1], chr(2)))) AS last FROM marked),
found AS (SELECT *, base OR NOT EXISTS (FROM places q WHERE q.doc_id = p.doc_id AND q.first <= p.first AND q.last >= p.last AND q.priority <= p.priority AND NOT q.base
          AND (q.first, -q.last, q.priority, q.rule) < (p.first, -p.last, p.priority, p.rule)) AS stays FROM places p),
own AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (stays) AS labels,
        max(CASE WHEN base THEN {BASE_SCORE} {worth} END) FILTER (stays) AS score, count(*) FILTER (stays) AS n_detections FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score, coalesce(n_detections, 0) AS n_detections FROM d LEFT JOIN own USING (doc_id)
"""


# Two hexadecimal digits a byte.
OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substring(h, 2 * i + 1, 200) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d)),
first AS (SELECT k, min((doc_id, i)) AS f FROM win GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM win JOIN first USING (k) WHERE f <> (doc_id, i)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 100)) AS p FROM hit),
bytes AS (SELECT doc_id, p, substring(h, 2 * p + 1, 2) AS b, gone.p IS NOT NULL AS off
          FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS p FROM d) LEFT JOIN gone USING (doc_id, p)),
edge AS (SELECT *, off AND NOT coalesce(lag(off) OVER (PARTITION BY doc_id ORDER BY p), false) AS starts FROM bytes),
own AS (SELECT doc_id, count(*) FILTER (off) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(b, '' ORDER BY p) FILTER (NOT off) AS kept FROM edge GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN own USING (doc_id)
"""
OP3 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
OP5 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
first AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first USING (k) WHERE f < doc_id),
words AS (SELECT doc_id, p, w[p] AS word, gone.p IS NOT NULL AS off FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) LEFT JOIN gone USING (doc_id, p)),
own AS (SELECT doc_id, count(*) FILTER (off) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT off) AS kept FROM words GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN own USING (doc_id)
"""
OP10 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g USING (body)
"""
