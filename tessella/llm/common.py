"""Shared folder, saved tables and small helpers of the operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is set once, on a local master alone:
    the machines of a cluster would each write to their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def save(df: DataFrame, name: str, codec: str = "uncompressed") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Lineage ends here, so a lost executor costs a reread and no recomputation.
    The folder is deleted by :func:`drop_saved`, or when the driver's JVM ends.
    Narrow tables stay uncompressed: native codecs hold memory outside the heap
    for each file.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def drop_saved(*tables: DataFrame) -> None:
    """Delete tables of :func:`save` that nothing will read again."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def whole_ids(docs: DataFrame) -> DataFrame:
    """``docs``; TypeError unless doc_id is a whole number, whose order tells which of several copies is the first."""
    if not isinstance(docs.schema["doc_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"doc_id must be a whole number, not {docs.schema['doc_id'].dataType.simpleString()}")
    return docs


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1 (a null id is in no fold)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def crc32_ids(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def bounded(spark: SparkSession) -> SparkSession:
    """``spark``, sending Python workers batches of few rows and bytes, so that their memory doesn't follow the length of texts."""
    for name, most in (("maxRecordsPerBatch", 2_000), ("maxBytesPerBatch", 8 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        held = int(spark.conf.get(key).rstrip("b"))
        if held <= 0 or held > most:
            spark.conf.set(key, str(most))
    return spark


def release() -> None:
    """Give a worker process's free memory back to the system; else it keeps the most it ever held."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


_STATE: dict = {}


def worker_state(key: tuple, make):
    """What the tasks of one operator share in a worker process, such as a tokenizer and its known words.

    Only the operator used last keeps its state, so that the memory of a
    worker doesn't add up over the stages of a pipeline.
    """
    if key not in _STATE:
        _STATE.clear()
        release()
        _STATE[key] = make()
    return _STATE[key]
