"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of one Arrow batch handed to Python. Documents can be long, so a
#: batch is kept small; its memory is this many texts.
ARROW_ROWS = 256

#: Characters of text worked on at once inside a batch.
CHUNK_CHARS = 1_000_000


#: Folder that holds this package.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def tuned(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that reach the Python workers, and let workers on
    this machine import the package from where it lies (on a cluster it comes
    with ``--py-files``)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply ``fn`` (column lists in, column lists out) to bounded Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out_schema = to_arrow_schema(StructType.fromDDL(schema))
    n_rows = ARROW_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, n_rows):
                part = batch.slice(start, n_rows)
                cols = fn({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[f.name], type=f.type) for f in out_schema], schema=out_schema)

    return df.mapInArrow(run, schema)


def by_size(sizes: list[int], limit: int = CHUNK_CHARS) -> Iterator[range]:
    """Consecutive index ranges whose sizes sum to about ``limit`` (one at least)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield range(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield range(start, len(sizes))


class _Letters(dict):
    """For ``str.translate``: letters (category L) stay, all else becomes a blank."""

    def __missing__(self, code: int) -> int:
        self[code] = out = code if chr(code).isalpha() else 32
        return out


_LETTERS = _Letters()


def letter_words(text: str) -> list[str]:
    """The runs of letters of a text, lower-cased."""
    return text.lower().translate(_LETTERS).split()
