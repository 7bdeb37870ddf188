import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import gam, mixing, simhash
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.texts import awkward, empty

DATA = "/root/testdata/sf0.001"


def brute(spark, docs, labels):
    """What run() should give: (doc_id, ids), each as often as it comes."""
    model = gam.learn(docs, labels)
    rows = [r for r in docs.collect() if model.scores(np.array([gam.features((r.text or "").encode())]))[0] >= 0.3]
    # Of equal texts the largest id, a null one being the smallest; of equal rows one.
    last = {}
    for r in rows:
        best = last.get(r.text or "")
        if best is None or (r.doc_id is not None, r.doc_id or 0) > (best.doc_id is not None, best.doc_id or 0):
            last[r.text or ""] = r
    rows = list(last.values())
    # Of near copies the smallest id, a null one being the largest, then the smallest fingerprint and SHA-256.
    fps = [brute_fingerprint(r.text) for r in rows]
    roots = brute_components([(i, fp) for i, fp in enumerate(fps)])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    best = {}
    for r, fp, root in zip(rows, fps, roots):
        key = (r.doc_id is None, r.doc_id or 0, signed(fp), hashlib.sha256((r.text or "").encode()).digest())
        best[root] = min(best.get(root, (key, r)), (key, r), key=lambda x: x[0])
    rows = [r for _, r in best.values()]
    times = Counter()
    for r in mixing.take(spark.createDataFrame(rows, docs.schema)).collect():
        times[r.doc_id, r.source, r.size] += r.copies
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    units = defaultdict(list)
    for r in rows:
        units[r.doc_id, r.source, len((r.text or "").encode().split())].append(r)
    want = Counter()
    for key, own in units.items():
        # Which of several rows of a unit are taken is open; here none are alike.
        assert len(own) == 1
        ids = library.encode(own[0].text or "", add_special_tokens=False).ids
        want[own[0].doc_id, b"".join(i.to_bytes(4, "little") for i in ids)] += times[key]
    return Counter({k: n for k, n in want.items() if n})


def outcome(rows):
    return Counter((r.doc_id, bytes(r.ids)) for r in rows.collect())


def test_matches_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    assert outcome(corpus_pipeline.run(spark, DATA)) == brute(spark, docs, labels)


def tables(docs, labels, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_awkward_rows(spark, tmp_path):
    """Nulls in all columns, empty and very long texts, repeated ids and rows, columns with clashing names."""
    rng = random.Random(6)
    docs = awkward(spark)
    texts = [" ".join(str(rng.random()) for _ in range(90 - 7 * k)) for k in range(4)]
    more = [(5, texts[0]), (5, texts[1]), (5, texts[1]), (1, texts[0]), (6, texts[2] + " end"), (7, texts[2] + " End"), (None, texts[3]), (None, texts[3]), (8, texts[3] + " x")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s1", 1, 5, 6, "n", None) for i, t in more], docs.schema))
    labels = spark.createDataFrame([(i, i % 3 > 0, 0) for i in range(60)] + [(None, True, 1), (1, None, 0)], "doc_id long, quality boolean, toxic int")
    labels = labels.withColumn("quality", labels["quality"].cast("int"))
    got = outcome(corpus_pipeline.run(spark, tables(docs, labels, tmp_path)))
    assert got == brute(spark, docs, labels) and sum(got.values()) > 20


def test_no_rows(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = corpus_pipeline.run(spark, tables(empty(spark), labels, tmp_path))
    assert out.collect() == [] and out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_goes_on_where_it_broke_off(spark, tmp_path, monkeypatch):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    path, folder = tables(awkward(spark), labels, tmp_path / "in"), str(tmp_path / "stages")
    ran = []
    stages = [(name, lambda s, d, p, f=f, name=name: ran.append(name) or f(s, d, p)) for name, f in corpus_pipeline.STAGES]

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*stages[:3], ("mix", broken), stages[4]])
    with pytest.raises(RuntimeError, match="lost"):
        corpus_pipeline.run(spark, path, folder)
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    got = outcome(corpus_pipeline.run(spark, path, folder))
    assert ran == ["quality", "exact_copies", "near_copies", "mix", "encode"]
    assert got == outcome(corpus_pipeline.run(spark, path)) and [x.name for x in (tmp_path / "stages").iterdir()] == ["encode"]


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert docs.count() > 0


def test_near_copies_leave_one_of_each_group(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    groups = defaultdict(list)
    for r in simhash.near_components(docs).collect():
        groups[r.component_id].append(r.doc_id)
    kept = Counter(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, DATA).collect())
    assert all(sum(kept[d] for d in ids) == 1 for ids in groups.values())
