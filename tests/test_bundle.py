"""The report bundle sink."""

import json
import os

import pytest
from pyspark.sql import functions as F

from reportlake.sources import bundle as BU


def results(spark, templates=30, blocks=4, hot=2000):
    """Some rows for every block, most of them in template 1."""
    return (spark.range(templates).withColumn("block_idx", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            .withColumn("n", F.when(F.col("id") == 1, hot).otherwise(F.col("id") % 3 + 1))
            .select(F.col("id").alias("template_id"), "block_idx", F.explode(F.sequence(F.lit(1), "n")).alias("k"))
            .withColumn("text", F.concat(F.lit("v"), "k")))


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def test_run_rows_come_from_the_manifest(spark, tmp_path):
    df, path = results(spark, hot=20_000), f"{tmp_path}/bundles"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small data is one task
    rows = {r.template_id: r for r in BU.write_bundle(df, path, "r1").collect()}
    want = {r.template_id: r["count"] for r in df.groupBy("template_id").count().collect()}
    assert {t: r.n_rows for t, r in rows.items()} == want
    assert all(r.status == "success" and r.run_id == "r1" and r.file_size > 0 for r in rows.values())
    assert rows[1].n_files > 1  # a template of most rows is written by several tasks
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = BU.read_bundle(spark, path, "r1")
    assert got.exceptAll(df).isEmpty() and df.exceptAll(got).isEmpty()


def test_files_are_bounded_by_tasks_not_templates(spark, tmp_path):
    path = f"{tmp_path}/bundles"
    BU.write_bundle(results(spark, templates=500, hot=3), path, "r1")
    manifest = json.loads(open(f"{path}/_manifests/r1.json").read())
    assert len(manifest["files"]) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(files(path)) == 2 * len(manifest["files"]) + 1


def test_a_failed_run_leaves_nothing_and_the_earlier_one_stays(spark, tmp_path):
    path, df = f"{tmp_path}/bundles", results(spark, hot=5)
    before = BU.write_bundle(df, path, "r1").count()
    kept = files(path)
    broken = df.withColumn("text", F.when(F.col("template_id") == 17, F.raise_error(F.lit("no such block"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no such block"):
        BU.write_bundle(broken, path, "r1")
    assert files(path) == kept
    assert BU.read_run_rows(spark, path, "r1").count() == before
    with pytest.raises(Exception, match="no such block"):
        BU.write_bundle(broken, path, "r2")
    assert files(path) == kept
    with pytest.raises(FileNotFoundError):
        BU.read_run_rows(spark, path, "r2")


def test_files_of_killed_attempts_are_removed_by_the_commit(tmp_path):
    import pyarrow as pa
    writer = BU.BundleWriter(str(tmp_path), "r1", "template_id")
    batch = pa.record_batch({"template_id": [1, 1, 2], "v": ["a", "b", "c"]})
    lost = writer.write(iter([batch]))  # an attempt whose message never came
    good = writer.write(iter([batch, batch.slice(2)]))
    assert writer.write(iter([])).path is None
    writer.commit([good, None])
    left = {os.path.basename(f) for f in files(tmp_path)}
    assert left == {os.path.basename(good.path), os.path.basename(good.index), "r1.json"}
    assert os.path.basename(lost.path) not in left and good.n_rows == 4


def test_a_rewrite_replaces_the_run(spark, tmp_path):
    path, df = f"{tmp_path}/bundles", results(spark, hot=5)
    BU.write_bundle(df, path, "r1")
    again = BU.write_bundle(df.where("template_id < 3"), path, "r1")
    assert again.count() == 3 and BU.read_bundle(spark, path, "r1").where("template_id >= 3").isEmpty()
    assert BU.write_bundle(df.where("template_id is null"), path, "r3").count() == 0


def test_row_groups_are_cut_by_size_not_by_template(tmp_path, monkeypatch):
    """Few row groups for many templates; rows exact, bytes by shares of at least one."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    monkeypatch.setattr(BU, "ROW_GROUP_BYTES", 40_000)
    keys = [None, None] + [t for t in range(5000) for _ in range(3 if t == 7 else 1)]
    table = pa.table({"template_id": pa.array(keys, pa.int64()),
                      "text": ["x" * 30_000 if t == 9 else "y" for t in keys]})
    part = BU.BundleWriter(str(tmp_path), "r1", "template_id").write(iter(table.to_batches(max_chunksize=500)))
    meta = pq.read_metadata(part.path)
    assert meta.num_row_groups <= 4 and meta.num_rows == part.n_rows == len(keys)
    rows, size = {}, {}
    for r in pq.read_table(part.index).to_pylist():
        rows[r["template_id"]] = rows.get(r["template_id"], 0) + r["n_rows"]
        size[r["template_id"]] = size.get(r["template_id"], 0) + r["file_size"]
        assert r["file_path"] == part.path and r["file_size"] > 0
    assert rows == {t: keys.count(t) for t in (None, 7)} | {t: 1 for t in range(5000) if t != 7}
    assert size[9] == max(size.values())
    data = sum(meta.row_group(g).column(c).total_compressed_size for g in range(meta.num_row_groups) for c in range(2))
    assert data <= sum(size.values()) <= data + len(rows) + meta.num_row_groups
    assert pq.ParquetFile(part.path).read().equals(table)


def test_what_a_task_keeps_does_not_grow_with_templates(tmp_path):
    """The footer of a file, which its writer holds to the end, is as large for ten times the templates."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    def footer(templates):
        batch = pa.record_batch({"template_id": list(range(templates)), "text": ["v"] * templates})
        part = BU.BundleWriter(str(tmp_path), f"r{templates}", "template_id").write(iter([batch]))
        return [pq.read_metadata(p).serialized_size for p in (part.path, part.index)]

    assert all(b < 1.1 * a for a, b in zip(footer(1000), footer(10_000), strict=True))


def test_an_index_holds_its_path_once():
    """A stretch costs the index its numbers, not the path of the file."""
    import pyarrow as pa
    group = pa.table({"template_id": list(range(1000)), "text": ["v"] * 1000})
    index = BU._index_rows(group, "template_id", 5000, "/shared/" + "x" * 500)
    assert index.nbytes < 1000 * 40
    assert set(index.column("file_path").to_pylist()) == {"/shared/" + "x" * 500}
    none = BU._index_rows(pa.table({"template_id": pa.array([None, None], pa.int64()), "text": ["v", None]}),
                          "template_id", 10, "/f")
    assert none.to_pylist() == [{"template_id": None, "n_rows": 2, "file_size": 10, "file_path": "/f"}]


def test_the_memory_of_a_writing_task_does_not_grow_with_its_rows(tmp_path):
    """A process of its own writes 400,000 rows of as many templates, then eight times as many."""
    import subprocess
    import sys
    code = f"""
import re
import pyarrow as pa
from reportlake.sources.bundle import BundleWriter

def write(n):
    batches = (pa.record_batch({{"template_id": range(i, i + 10_000), "a": ["some status"] * 10_000,
                                "b": ["another text"] * 10_000}}) for i in range(0, n, 10_000))
    assert BundleWriter({str(tmp_path)!r}, f"r{{n}}", "template_id").write(batches).n_rows == n
    return int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1])  # KB, of this process alone

start = write(10_000)
print(write(400_000) - start, write(3_200_000) - start)
"""
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    small, large = map(int, subprocess.run([sys.executable, "-c", code], env=env, check=True, capture_output=True,
                                           text=True, timeout=300).stdout.split())
    assert 0 < large < 1.5 * small
