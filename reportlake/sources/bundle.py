"""Report bundles as a data source (S7): files by task, visible by one manifest.

``write_bundle`` sends a run's result rows to the ``report_bundle`` sink. A task
writes one Parquet file, sorted by template, and beside it an index with a row for
each template of each row group: rows and bytes. Row groups are cut by size, so a
task holds one of them and a file has few of them, whatever the number of templates,
and what it took for one goes back before the next; a template's bytes are its share
of its row groups. The task's commit message is the
two paths. The driver's commit writes one manifest that lists them, and only what a
manifest lists is read: a run is there whole or not at all. Every write has a folder of its own, which an abort deletes with all that
failed or killed tasks left in it; a commit deletes what failed attempts left.

Paths are any that ``pyarrow.fs`` opens (shared folders, object stores).
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: A row group is closed when it holds this many bytes of Arrow data.
ROW_GROUP_BYTES = 16 << 20

#: The path is the same in all rows of an index: held once, read as a string.
INDEX = pa.schema([("template_id", pa.int64()), ("n_rows", pa.int64()), ("file_size", pa.int64()),
                   ("file_path", pa.dictionary(pa.int32(), pa.string()))])


@dataclass
class BundlePart(WriterCommitMessage):
    """What one task wrote: the data file, its index, and their size."""

    path: str | None  # of a task without rows: none
    index: str | None
    n_rows: int
    file_size: int


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it of a URI or an absolute path."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://")
                                        else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


class BundleWriter(DataSourceArrowWriter):
    """Writer of one run: ``path/run_id=<id>/<write>/`` and ``path/_manifests/<id>.json``."""

    def __init__(self, path: str, run_id: str, key: str):
        self.path, self.run_id, self.key = path.rstrip("/"), run_id, key
        self.folder = f"{self.path}/run_id={run_id}/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> BundlePart:
        """One file for the rows of this task, which come clustered by the key."""
        name = f"{self.folder}/part-{uuid.uuid4().hex}"
        fs, at = _open(name)
        writer, held, held_bytes, n_rows = None, [], 0, 0
        try:
            def close_group() -> None:
                nonlocal held, held_bytes, n_rows
                start, group = sink.tell(), pa.Table.from_batches(held)
                writer.write_table(group, row_group_size=1 << 30)
                index.write_table(_index_rows(group, self.key, sink.tell() - start, f"{name}.parquet"))
                held, held_bytes, n_rows = [], 0, n_rows + group.num_rows
                del group
                # Workers outlive their tasks: what Arrow keeps of freed memory would add up over them.
                pa.default_memory_pool().release_unused()

            for batch in iterator:
                if batch.num_rows == 0:
                    continue
                if writer is None:
                    fs.create_dir(posixpath.dirname(at), recursive=True)
                    sink = fs.open_output_stream(f"{at}.parquet")
                    writer = pq.ParquetWriter(sink, batch.schema)
                    index_sink = fs.open_output_stream(f"{at}.index.parquet")
                    index = pq.ParquetWriter(index_sink, INDEX)
                held.append(batch)
                held_bytes += batch.nbytes
                if held_bytes > ROW_GROUP_BYTES:
                    close_group()
            if writer is None:
                return BundlePart(None, None, 0, 0)
            if held:
                close_group()
            for end in (writer, sink, index, index_sink):
                end.close()
        except BaseException:
            for end in (".parquet", ".index.parquet"):
                if fs.get_file_info(at + end).type != pafs.FileType.NotFound:
                    fs.delete_file(at + end)
            raise
        return BundlePart(f"{name}.parquet", f"{name}.index.parquet", n_rows,
                          fs.get_file_info(f"{at}.parquet").size)

    def commit(self, messages: list[BundlePart | None]) -> None:
        """Make the run visible: delete what failed attempts left, then write the manifest."""
        parts = [m for m in messages if m is not None and m.path]
        fs, folder = _open(self.folder)
        kept = {posixpath.basename(x) for m in parts for x in (m.path, m.index)}
        for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if f.base_name not in kept:
                fs.delete_file(f.path)
        fs, manifests = _open(f"{self.path}/_manifests")
        fs.create_dir(manifests, recursive=True)
        doc = {"run_id": self.run_id, "files": [m.path for m in parts], "indexes": [m.index for m in parts],
               "n_rows": sum(m.n_rows for m in parts), "file_size": sum(m.file_size for m in parts)}
        draft = f"{manifests}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps(doc).encode())
        fs.move(draft, f"{manifests}/{self.run_id}.json")

    def abort(self, messages: list[BundlePart | None]) -> None:
        fs, folder = _open(self.folder)
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


def _row_bytes(group: pa.Table) -> np.ndarray:
    """Bytes of each row before encoding: texts by their length, other columns by their mean."""
    size = np.ones(group.num_rows)
    for c in group.columns:
        if any(is_(c.type) for is_ in (pa.types.is_string, pa.types.is_large_string,
                                       pa.types.is_binary, pa.types.is_large_binary)):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy()
        else:
            size += c.nbytes / group.num_rows
    return size


def _index_rows(group: pa.Table, key: str, n_bytes: int, path: str) -> pa.Table:
    """A row for each stretch of the key in a row group of ``n_bytes``: its rows, and its share of
    the bytes by the size of its rows, rounded up."""
    runs = pc.run_end_encode(group.column(key).combine_chunks())
    ends = runs.run_ends.to_numpy().astype("int64")
    starts = np.concatenate([[0], ends[:-1]])
    weight = np.add.reduceat(_row_bytes(group), starts)
    return pa.table([runs.values, pa.array(ends - starts),
                     pa.array(np.ceil(n_bytes * (weight / weight.sum())).astype("int64")),
                     pa.DictionaryArray.from_arrays(np.zeros(len(ends), "int32"), [path])], schema=INDEX)


class BundleSource(DataSource):
    """``df.write.format("report_bundle").option("path", ...).option("run_id", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "report_bundle"

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options["path"], self.options["run_id"], self.options.get("key", "template_id"))


def write_bundle(results: DataFrame, path: str, run_id: str, key: str = "template_id",
                 spread: tuple[str, ...] = ("block_idx",)) -> DataFrame:
    """Write the rows of a run and return its run rows (:func:`read_run_rows`).

    Rows are dealt over the tasks by the key and the columns of ``spread``, so a
    template of most of the rows is written by several tasks, and sorted by the
    key; there are as many files as tasks that have rows, whatever the number of
    templates. Writing a run again replaces it when the new manifest is there;
    a write that fails leaves the earlier one."""
    spark = results.sparkSession
    spark.dataSource.register(BundleSource)
    by = [c for c in spread if c in results.columns]
    dealt = results.withColumn(key, F.col(key).cast("bigint")).repartition(key, *by).sortWithinPartitions(key)
    # "append" only adds; a run's rows are replaced by its manifest.
    (dealt.write.format("report_bundle").option("path", path).option("run_id", run_id).option("key", key)
     .mode("append").save())
    return read_run_rows(spark, path, run_id, key)


def _manifest(path: str, run_id: str) -> dict:
    fs, at = _open(f"{path.rstrip('/')}/_manifests/{run_id}.json")
    with fs.open_input_stream(at) as f:
        return json.loads(f.read())


def read_run_rows(spark: SparkSession, path: str, run_id: str, key: str = "template_id") -> DataFrame:
    """A row for each template of a written run: rows, bytes, files and the first file's path."""
    paths = _manifest(path, run_id)["indexes"]
    schema = "template_id bigint, n_rows bigint, file_size bigint, file_path string"
    index = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return (index.groupBy(F.col("template_id").alias(key))
            .agg(F.sum("n_rows").alias("n_rows"), F.sum("file_size").alias("file_size"),
                 F.count_distinct("file_path").alias("n_files"), F.min("file_path").alias("file_path"))
            .withColumns({"status": F.lit("success"), "run_id": F.lit(run_id)}))


def read_bundle(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The result rows of a written run; of none, an error."""
    files = _manifest(path, run_id)["files"]
    if not files:
        raise ValueError(f"run {run_id} has no rows")
    return spark.read.parquet(*files)
