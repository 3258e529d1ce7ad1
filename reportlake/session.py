"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "reportlake", **conf) -> SparkSession:
    """Session with the settings the operators assume.

    ``spark.sql.session.timeZone`` is pinned to UTC: history timestamps are
    stored as TIMESTAMP_NTZ wall-clock values and zone conversion is always
    explicit (``convert_timezone``). AQE stays on so joins whose build side
    turns out small at runtime become broadcast joins (size checked by AQE
    against ``autoBroadcastJoinThreshold``) and skewed partitions are split.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    defaults.update(conf)
    for k, v in defaults.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint dir). Only when neither is set and Spark runs in this process
    alone (``local[...]``) a fresh folder is created and registered.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no classic context (e.g. Spark Connect): the conf is all we have
        sc = None
    if not d and sc is not None:
        jdir = sc._jsc.sc().getCheckpointDir()
        d = jdir.get() if jdir.isDefined() else None
    if not d:
        if sc is None or not sc.master.startswith("local"):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        d = tempfile.mkdtemp(prefix="reportlake-ckpt-")
        sc.setCheckpointDir(d)
    elif sc is not None and not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(d)  # named in the conf only: register it for DataFrame.checkpoint()
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for one staged table."""
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/reportlake/{name}-{uuid.uuid4().hex}"
    for open_ in _SCOPES:
        open_.append(path)
    return path


_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession, *also: str) -> Iterator[None]:
    """Removes the staged tables made inside, and the folders ``also``, when the block
    ends well; nothing that outlives it may read them."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
    for path in (*made, *also):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def staged(spark: SparkSession, df, name: str):
    """``df`` written to a fresh folder of the shared checkpoint folder and read back:
    computed once, its lineage ends here, and losing executors does not lose it."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
