"""What the text operators share: tables and flat files in the cluster's shared folder, and small helpers."""

from __future__ import annotations

import json
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters, for lower-casing that leaves every other letter alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``.

    Where it is unset, a session that runs on one machine gets a folder of its own; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="feederflow-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: What Spark hands to a Python worker at a time, and with it what both sides hold: a worker reads one batch while it
#: still has the one before, and Arrow's pool keeps what it once took.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits on Arrow batches to those for whole texts, where they are higher."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(key).rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/feederflow/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    It cuts the lineage: what follows survives the loss of any executor without computing ``df`` anew.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._staged_at = path
    return out


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop_stage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_staged_at", None)
    if path:
        fs, at = _file_system(df.sparkSession, path)
        fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def open_shared(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder's path as a Python worker opens it, and the path there."""
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


def publish(spark: SparkSession, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Write flat arrays as one file in the shared folder and have Spark copy it to every executor, those started
    later too. The name by which :func:`published` opens it there."""
    head, body, at = {}, [], 0
    for key, x in arrays.items():
        x = np.ascontiguousarray(x)
        head[key] = (x.dtype.str, at, len(x))
        body += [x.tobytes(), b"\0" * (-x.nbytes % 8)]
        at += x.nbytes + (-x.nbytes % 8)
    start = json.dumps(head).encode()
    start += b" " * (-len(start) % 8)
    raw = b"".join([np.array([len(start)], "<i8").tobytes(), start, *body])
    path = stage_path(spark, name)
    fs, where = _file_system(spark, path)
    out = fs.create(where)
    for k in range(0, len(raw), 1 << 22):
        out.write(bytearray(raw[k : k + (1 << 22)]))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def published(name: str) -> dict[str, np.ndarray]:
    """The arrays of a published file, mapped into memory: all workers of an executor share its pages."""
    raw = np.memmap(SparkFiles.get(name), np.uint8, "r").view(np.ndarray)  # as a plain array: its operations cost less
    n = int(raw[:8].view("<i8")[0])
    body = raw[8 + n :]
    return {k: body[at : at + size * np.dtype(kind).itemsize].view(kind) for k, (kind, at, size) in json.loads(bytes(raw[8 : 8 + n])).items()}


_OPEN: dict[str, object] = {}


def kept(kind: str, name: str, make):
    """``make()``, once in a worker for each published ``name``. Of each kind only the last stays."""
    if _OPEN.get(kind, (None,))[0] != name:
        _OPEN.pop(kind, None)
        _OPEN[kind] = (name, make())
    return _OPEN[kind][1]


def slices(column: pa.Array, most: int = 2_000_000):
    """``(start, values)`` of consecutive rows of a text column, about ``most`` bytes at a time; a longer text stands alone."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(size)
    at = 0
    while at < len(column):
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
        yield at, column.slice(at, end - at).to_pylist()
        at = end


def row_keys(columns: list[str]) -> tuple:
    """``row1``, ``row2``: two 64-bit hashes of all columns, by which equal rows, and in practice only they, agree."""
    return F.xxhash64(F.lit(1), *columns).alias("row1"), F.xxhash64(F.lit(2), *columns).alias("row2")


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
