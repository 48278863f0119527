"""Session-level helpers shared by all operators."""

from __future__ import annotations

import atexit
import hashlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables, shared by all executors.

    It comes from ``spark.checkpoint.dir``. Only a local master without that setting
    (tests) gets a temporary folder; on a cluster the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "palimpsest-checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint (survives the loss of executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_made: list[tuple[SparkSession, str]] = []


@atexit.register
def clear() -> None:
    """Delete the intermediate tables of this process. Results that still read them must be written before."""
    while _made:
        spark, at = _made.pop()
        try:
            delete(spark, at)
        except Exception:  # noqa: BLE001  the session has ended already
            pass


def store(df: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage like ``cut``, but columnar and compressed.

    The table is deleted when the process ends, or earlier by whoever gave the list ``scratch``, to which its folder is added.
    """
    spark = df.sparkSession
    at = os.path.join(checkpoint_dir(spark), f"table-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(at)
    _made.append((spark, at))
    if scratch is not None:
        scratch.append(at)
    return spark.read.schema(df.schema).parquet(at)


def _hadoop(spark: SparkSession, path: str):
    """(path, its file system) of any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def folder_bytes(spark: SparkSession, path: str) -> int:
    p, fs = _hadoop(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file in the shared store; None if there is none."""
    p, fs = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file by one rename, so that readers see the old text or the new one."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    temp, fs = _hadoop(spark, f"{path}-{uuid.uuid4().hex}")
    stream = fs.create(temp, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context.rename(temp, jvm.org.apache.hadoop.fs.Path(path), how)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def squash(col: Column | str) -> Column:
    """Lower case, trimmed, runs of white space as one space."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def require(df: DataFrame, columns: Iterable[str], who: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{who}: missing columns {missing}")


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, wherever the executors run. Once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_palimpsest_shipped", False):
        return
    root = Path(__file__).resolve().parent
    files = sorted(root.rglob("*.py"))
    tag = hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()[:16]
    at = Path(tempfile.mkdtemp(prefix="palimpsest-")) / f"palimpsest-{tag}.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in files:
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(at))
    sc._palimpsest_shipped = True
