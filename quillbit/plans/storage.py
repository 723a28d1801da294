"""Where intermediate tables live, and when a table is small enough to broadcast.

Lineage is cut by writing Parquet to the folder that the cluster shares
(``spark.checkpoint.dir``), so a lost executor costs a re-read and not a
re-computation, and no machine-local folder is involved.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Sides up to this size are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only where none is set on a local master (tests)."""
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if found:
        return found
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError(f"{CHECKPOINT_KEY} names no folder that driver and executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillbit-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own for a table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/quillbit/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table", **measures: Column) -> DataFrame:
    """Write ``df`` once to the shared folder and return a frame that reads it back.

    On the way its rows are measured, as are the aggregates in ``measures``: ``measured``
    tells them without another job.
    """
    path, seen = new_path(df.sparkSession, name), Observation()
    size = F.coalesce(F.sum(_row_width(df)), F.lit(0))
    df.observe(seen, size.alias("bytes"), F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in measures.items())).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quillbit_path, out._quillbit_seen = path, seen
    return out


def measured(df: DataFrame) -> dict:
    """``bytes``, ``rows`` and other measures of a materialised table."""
    return df._quillbit_seen.get


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), hadoop


def drop(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        fs, path = _file_system(df.sparkSession, df._quillbit_path)
        fs.delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables in the shared folder, for the owner of the session when no query is left."""
    fs, path = _file_system(spark, f"{shared_dir(spark).rstrip('/')}/quillbit")
    fs.delete(path, True)


def stored_bytes(df: DataFrame) -> int:
    """Size on disk of a frame that reads files only, one question for each folder of them."""
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    total = 0
    for folder in folders:
        fs, path = _file_system(df.sparkSession, folder)
        total += fs.getContentSummary(path).getLength()
    return total


#: Bytes of fixed-width types in a row; every column takes at least a word.
WORD, ROW = 8, 48


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value besides its word in the row."""
    none = F.lit(0).cast("long")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        out = F.octet_length(value).cast("long")
    elif isinstance(kind, T.ArrayType):
        out = F.size(value).cast("long") * WORD
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            out = F.aggregate(value, out, lambda n, x: n + _width(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        out = _width(F.map_entries(value), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
    elif isinstance(kind, T.StructType):
        out = sum((_width(value[f.name], f.dataType) + WORD for f in kind.fields), none)
    else:
        return none
    return F.coalesce(out, none)


def _row_width(df: DataFrame) -> Column:
    """Size in memory of a row as Spark hashes it: counted, not guessed from how it is stored."""
    return sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(ROW + WORD * len(df.columns)).cast("long"))


def row_bytes(df: DataFrame) -> int:
    """The sum over all rows; known for a materialised table, else a job."""
    if hasattr(df, "_quillbit_seen"):
        return measured(df)["bytes"]
    return df.agg(F.coalesce(F.sum(_row_width(df)), F.lit(0)).alias("n")).first()["n"]


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (a materialised table) with a broadcast hint if its checked size allows one.

    Beyond ``limit`` the frame is returned as it is and Spark joins by a shuffle,
    splitting skewed partitions at run time.
    """
    return F.broadcast(df) if row_bytes(df) <= limit else df


@contextmanager
def smaller_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Fewer rows in an Arrow batch, for jobs on whole texts run inside, where the session has Spark's default."""
    key, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    before = spark.conf.get(key, default)
    if before != default:
        yield
        return
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key)
