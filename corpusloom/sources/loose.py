"""Loose files, however many: executors list folders and read files, so neither names nor tasks pile up in the driver."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files and bytes that a batch of read files has at most, one file at least; tasks a core; folders that spread() deals to.
FILES, BYTES, TASKS, FOLDERS = 512, 8 << 20, 4, 1024


def spread(name: Column) -> Column:
    """The name in one of FOLDERS folders, by a hash: no folder gets so many files that writers wait for each other."""
    return F.concat(F.lpad(F.pmod(F.crc32(name), F.lit(FOLDERS)).cast("string"), 4, "0"), F.lit("/"), name)


def _hidden(path: str) -> bool:
    """As Spark's readers have it."""
    return any(x.startswith(".") or x.startswith("_") and "=" not in x or x.endswith("._COPYING_") for x in path.split("/"))


def _listed(names: DataFrame, pattern: str, recursive: bool) -> DataFrame:
    """names (path, folder): files that match stay, folders give what is in them, with recursive all below them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, fit = fs.LocalFileSystem(), lambda p: fnmatchcase(posixpath.basename(p), pattern)
        for batch in batches:
            for path, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not folder:
                    found = [(path, False)] if fit(path) else []
                else:
                    every = store.get_file_info(fs.FileSelector(path, recursive=recursive))
                    seen = [(x.path, x.type == fs.FileType.Directory) for x in every if not _hidden(x.path[len(path) :].lstrip("/"))]
                    found = [(p, d) for p, d in seen if (not recursive if d else fit(p))]
                for at in range(0, len(found), 10_000):
                    paths, folders = zip(*found[at : at + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(folders, pa.bool_())], ["path", "folder"])

    return names.mapInArrow(run, "path string, folder boolean")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, paths, contents, held = fs.LocalFileSystem(), [], [], 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with store.open_input_stream(path) as file:
                content = file.read()
            if paths and (len(paths) == FILES or held + len(content) > BYTES):
                yield made()
                paths, contents, held = [], [], 0
            paths.append(path)
            contents.append(content)
            held += len(content)
    if paths:
        yield made()


def read(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of all files at path, a file, a folder or a glob, whose names match; folders are searched to any depth.

    In a store that only Spark reads, and where there is nothing, it is Spark's own reader, which lists on the driver.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    roots = [(x.getPath().toUri().getPath(), x.isDirectory()) for x in store.globStatus(root) or ()] if store.getScheme() == "file" else []
    # What is named is read, what a glob finds only if it isn't hidden.
    roots = [(p, d) for p, d in roots if posixpath.basename(p) == root.getName() or not _hidden(posixpath.basename(p))]
    if not roots:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")
    # Only the names are dealt out: those right below path, and then those of all files.
    tasks = TASKS * spark.sparkContext.defaultParallelism
    top = _listed(spark.createDataFrame(roots, "path string, folder boolean"), pattern, False).repartition(tasks)
    return _listed(top, pattern, True).select("path").repartition(tasks).mapInArrow(_read, "path string, content binary")
