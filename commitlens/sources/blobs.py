"""Blob sources (S4): a ``blobs`` table, or a folder of files named by blob id."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parallel import spread

#: fixed values: the ids (SHA-1, SHA-256) that git gives to the content of no bytes
GIT_EMPTY_IDS = ("e69de29bb2d1d6434b8b29ae775ad8c2e48c5391", "473a0f4c3be8a93681a267e3b1e9a7dcda1185436fe141f7749120a303721813")


#: what a task holds of the files that it reads
READ_BYTES, READ_ROWS = 4 << 20, 1_000


def _hidden(name: str) -> bool:
    """Names that Spark's file sources leave out."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _children(store, folder: str) -> Iterator[tuple[str, str, bool]]:
    """(path, name, is a folder); one at a time where the file system is local, so that a folder of any size is no list."""
    from pyarrow import fs
    if isinstance(store, fs.LocalFileSystem):
        import os
        with os.scandir(folder) as entries:
            for x in entries:
                yield x.path, x.name, x.is_dir()
    else:
        for x in store.get_file_info(fs.FileSelector(folder)):
            yield x.path, x.base_name, x.type == fs.FileType.Directory


def _list_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(folder or file) -> (root, path, name) of every file under it, whatever the depth."""
    from pyarrow import fs
    for b in batches:
        for root in b.column(0).to_pylist():
            store, top = fs.FileSystem.from_uri(root)
            found, folders = [], []
            if store.get_file_info(top).type == fs.FileType.Directory:
                folders.append(top)
            else:
                found.append((root, top, top.rsplit("/", 1)[-1]))
            while folders or found:
                for path, name, is_folder in _children(store, folders.pop()) if folders else ():
                    if _hidden(name):
                        continue
                    if is_folder:
                        folders.append(path)
                    else:
                        found.append((root, path, name))
                    if len(found) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], ["root", "path", "name"])
                        found = []
                if not folders and found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], ["root", "path", "name"])
                    found = []


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, path, name) -> (name, content), some megabytes at a time; files of no bytes are left out."""
    from pyarrow import fs
    stores: dict[str, fs.FileSystem] = {}
    rows: list[tuple[str, bytes]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["name", "content"])

    size = 0
    for b in batches:
        for root, path, name in zip(*(c.to_pylist() for c in b.columns)):
            if root not in stores:
                stores[root] = fs.FileSystem.from_uri(root)[0]
            with stores[root].open_input_stream(path) as f:
                content = f.read()
            if content:
                rows.append((name, content))
                size += len(content)
            if size >= READ_BYTES or len(rows) >= READ_ROWS:
                yield batch()
                rows, size = [], 0
    if rows:
        yield batch()


def read_blob_files(spark: SparkSession, path: str, glob: str | None = None, empty_ids: Sequence[str] = ()) -> DataFrame:
    """``(blob_id, content BINARY, text STRING)`` from files whose base name (without
    extension) is the blob id.  Content is decoded as UTF-8 (invalid bytes replaced); the binary column stays
    available for the NUL-byte test of the language classifier.  Files of no bytes are skipped, as Spark's file sources do:
    ``empty_ids`` (e.g. ``GIT_EMPTY_IDS``) are added as empty blobs.

    Files are listed by a task and read by all, so the driver holds no list of them: there is one per blob."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    matched = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    if not matched:
        raise FileNotFoundError(path)
    roots = spark.createDataFrame([(s.getPath().toString(),) for s in matched], "root string")
    listed = roots.mapInArrow(_list_files, "root string, path string, name string")
    if glob:
        listed = listed.where(F.col("name").rlike("^(?:" + spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern.compile(glob).pattern() + r")\z"))
    files = spread(listed, "path").mapInArrow(_read_files, "name string, content binary")
    empty = spark.createDataFrame([(i, bytearray(), "") for i in empty_ids], "blob_id string, content binary, text string")
    return empty.unionByName(files.select(
        F.regexp_extract("name", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("blob_id"),
        F.col("content"),
        # UTF-8; invalid byte sequences (binary files) become U+FFFD instead of failing the job
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
    ))


def write_blob_files(blobs: DataFrame, path: str, id_col: str = "blob_id", content_col: str = "content") -> int:
    """One file per row, named by its blob id, in the shared folder ``path``; returns their number.

    A file of an id is the same whoever writes it, so a task that runs again does no harm.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                with store.open_output_stream(f"{folder}/{name}") as f:
                    f.write(content.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64())], ["n"])

    rows = blobs.select(F.col(id_col).cast("string").alias(id_col), F.col(content_col).cast("binary")).where(F.col(id_col).isNotNull() & F.col(content_col).isNotNull())
    # opening a file takes longer than reading a row: rows are dealt to all tasks, however few files they come from
    return spread(rows, id_col).mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
