import hashlib
from collections import defaultdict

from corpusloom.llm import exact_dedup
from tests.llm.texts import awkward, empty


def check(docs, block_bytes):
    got = exact_dedup.exact_groups(docs, block_bytes=block_bytes).collect()
    groups = defaultdict(list)
    rows = docs.collect()
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(r.doc_id, top[r.text or ""], len(groups[r.text or ""]), sha(r.text)) for r in rows]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert sorted(r.text_sha256 for r in kept) == sorted(map(sha, groups))


def test_matches_brute_force(spark):
    check(awkward(spark), exact_dedup.BLOCK_BYTES)


def test_small_blocks_need_many_levels(spark):
    check(awkward(spark, 2), 64)


def test_runs_over_partition_edges(spark):
    """One text for half of the rows: its run spans several range partitions."""
    rows = [(i, "same text " * 20 if i % 2 else f"other {i}") for i in range(400)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 32)


def test_empty(spark):
    assert exact_dedup.exact_groups(empty(spark)).collect() == []


def test_dedup_keeps_columns_and_one_of_each_text(spark):
    docs = awkward(spark)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r.text or "" for r in docs.collect()})
