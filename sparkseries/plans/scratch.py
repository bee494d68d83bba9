"""Shared scratch space: checkpoints and tables that every executor can read.

Intermediate results live below the folder in ``spark.checkpoint.dir``.  Only a
local session without that setting (tests, a laptop) gets a folder of its own.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_FALLBACK = "/tmp/checkpoints/sparkseries"
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, set as checkpoint folder if none is."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{_FALLBACK}"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing exists there yet."""
    return f"{shared_dir(spark)}/sparkseries/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and cut its lineage with a reliable checkpoint.

    Spark cannot carry the statistics of some plans over to a checkpoint and says so
    before it computes anything; those are written as a table instead.
    """
    shared_dir(df.sparkSession)
    try:
        return df.checkpoint(eager=True)
    except Py4JJavaError as e:
        if "NoSuchElementException: key not found" not in str(e):
            raise
    return stored(df, "cut")


def stored(df: DataFrame, name: str, compression: str = "zstd", **options) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Unlike a checkpoint the copy is columnar, so later readers prune columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Write ``df`` as a table bucketed by ``key`` so joins on it need no shuffle of it."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    (
        df.repartition(n, key)
        .write.format("parquet")
        .option("compression", "zstd")
        .option("path", path)
        .bucketBy(n, key)
        .saveAsTable(table)
    )
    return spark.table(table)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.dirname(root)
    out = os.path.join(tempfile.mkdtemp(), "sparkseries.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(out)
    _shipped.add(sc.applicationId)


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this library has written below the shared folder, and its tables."""
    where = f"{shared_dir(spark)}/sparkseries"
    for t in spark.catalog.listTables():
        if t.name.startswith("texts_") and t.tableType == "EXTERNAL":
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
