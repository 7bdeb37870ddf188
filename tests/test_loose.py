import pyarrow as pa

from corpusloom.functions import text
from corpusloom.sources import docx, loose, tables


def test_executors_list_and_read(spark, tmp_path):
    for name in ("in/a.docx", "in/deep/er/b.docx", "in/deep/empty.docx", "in/_hidden/c.docx", "in/.d.docx", "in/e.DOCX", "in/x=1/f g%20.docx"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else name.encode())
    found = docx.files(spark, str(tmp_path / "in"))
    assert "binaryFile" not in found._jdf.queryExecution().toString()
    got = {r.document_name: bytes(r.content) for r in found.collect()}
    assert got == {"a.docx": b"in/a.docx", "b.docx": b"in/deep/er/b.docx", "empty.docx": b"", "f g%20.docx": b"in/x=1/f g%20.docx"}
    assert docx.files(spark, str(tmp_path / "in" / "*.docx")).count() == docx.files(spark, f"file://{tmp_path}/in/a.docx").count() == 1


def test_more_files_are_no_more_tasks(spark, tmp_path):
    files = spark.range(3000).selectExpr("cast(id as string) as name", "encode(cast(id as string), 'utf-8') as content")
    tables.write_files(files.select(loose.spread(files.name).alias("path"), "content"), str(tmp_path))
    found = loose.read(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == loose.TASKS * spark.sparkContext.defaultParallelism
    assert sorted(int(bytes(r.content)) for r in found.collect()) == list(range(3000))


def test_few_rows_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(200)]), pa.array([b"x", None] * 100, pa.binary())], ["document_name", "content"])
    sizes = [x.num_rows for x in docx._parsed(iter([batch]), False)]
    assert sum(sizes) == 200 and max(sizes) == docx.ROWS
    texts = pa.array([None, "", *["word " * n for n in range(300)]], pa.string())
    assert text.cut_texts(texts).to_pylist() == [text.split_text(t) for t in texts.to_pylist()]
