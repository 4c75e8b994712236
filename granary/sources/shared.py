"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder set on the context. Where neither is set, a local session (one machine) gets
    a folder of its own, which is then the session's; a cluster raises, as a machine's own folder isn't shared."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='granary-')}"
        sc.setCheckpointDir(top)
    return top.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with an eager checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def _pack(batches):
    for b in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])


def _unpack(batches):
    for b in batches:
        for rows in b.column(0):
            yield from pa.ipc.open_stream(rows.as_buffer())


def cut_packed(df: DataFrame) -> DataFrame:
    """``cut`` in less room: a checkpoint keeps rows as they lie in memory, so each batch of them is one compressed value. Rows stay
    in their partitions and order."""
    return cut(df.mapInArrow(_pack, "rows binary")).mapInArrow(_unpack, df.schema)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context, so that they import it wherever the driver was started."""
    import os
    import shutil

    sc = spark.sparkContext
    if getattr(sc, "_granary_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="granary-"), "granary"), "zip", root, "granary")
    sc.addPyFile(made)
    sc._granary_shipped = True
