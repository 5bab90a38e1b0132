"""Session, shared-folder tables and size-checked joins."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes on disk, that `join_checked` and `hint_small` broadcast.
BROADCAST_BYTES = 8 << 20

_local_dir: str | None = None


def session(app: str = "tripletide", cores: str | int = "*", **conf: object) -> SparkSession:
    """A local session with the settings that the engine is tested with."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset (local runs)."""
    global _local_dir
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="tripletide-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return "file://" + _local_dir


def tables_dir(spark: SparkSession) -> str:
    """Where this application's written tables lie."""
    return f"{shared_dir(spark)}/tripletide/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete all tables that this application wrote for its plans; results read from them before are to be kept elsewhere."""
    p = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, label: str = "t", **options: str) -> DataFrame:
    """Write ``df`` as a table into the shared folder, with the writer's ``options``, and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.options(**options).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._tide_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete a table written by `materialize` that no plan reads any more."""
    path = getattr(df, "_tide_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored_bytes(df: DataFrame) -> int:
    """Bytes on disk of a materialized table."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df._tide_path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with ``small`` (from `materialize`): broadcast up to ``limit`` stored bytes, else a shuffle join that AQE may split."""
    return big.join(F.broadcast(small) if stored_bytes(small) <= limit else small, on, how)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One test table, cut to ``columns`` so that the scan reads no others."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def blank(c: Column) -> Column:
    """True for null and for text without a visible character."""
    return c.isNull() | ~c.rlike(r"[^\p{Z}\p{C}\s]")
