"""What the operators share: tables written to the cluster's shared folder, and small text rules."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The contract's words and white space, in ASCII terms.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or, in a local session without it, one of
    our own."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="quarry-")
    return _own_dirs[app]


#: Rows of narrow tables that a file holds, at least, but for FILES of them.
FILE_ROWS, FILES = 20_000, 8


def files_for(spark: SparkSession, rows: int) -> int:
    """Into how many files about so many narrow rows are written: no more than there are shuffle partitions."""
    return max(FILES, min(partitions(spark), rows // FILE_ROWS))


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and outlives any executor. files: how many at most."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes a table that written() made, once all that is made of it is written too."""
    spark, path = table.sparkSession, _paths.pop(table)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of a batch of rows on its way to a Python worker, where the session keeps Spark's own 64 MB: texts are long.
BATCH_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table; batches to Python are made smaller for it, so that workers need less memory."""
    at = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(at).rstrip("b") == str(64 << 20):
        spark.conf.set(at, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def own_columns(docs: DataFrame) -> DataFrame:
    """docs, if none of its columns has a name that operators use for their own: those that start with __q_."""
    if taken := [c for c in docs.columns if c.lower().startswith("__q_")]:
        raise ValueError(f"columns may not start with __q_: {taken}")
    return docs


def id_key(doc_id: Column) -> Column:
    """An id as text that is never null; a null id is the empty one."""
    return F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))


def rows_of(docs: DataFrame, keys: dict[str, Column], wanted: DataFrame) -> DataFrame:
    """One row of docs for each row of wanted(*keys, n), with its columns as they were.

    n: how many rows of docs have these keys; they differ in other columns at most, and the one of least hash is taken."""
    found = own_columns(docs).withColumns(keys).join(wanted.select(*keys), list(keys), "left_semi")
    if wanted.where("n > 1").limit(1).count():
        order = W.partitionBy(*keys).orderBy(F.xxhash64(*docs.columns))
        found = found.withColumn("__q_nth", F.row_number().over(order)).where("__q_nth = 1")
    return found.select(*docs.columns)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, in a Python worker that gives memory back as soon as it is free: workers live on after their tasks."""

    def returning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:  # of the GNU library only
            trim(0)

    return returning
