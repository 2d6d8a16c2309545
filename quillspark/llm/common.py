"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as the contracts mean it: space and \t \n \v \f \r. ``bytes.split()`` splits at just these.
SPACE_CLASS = r"[^\x20\x09-\x0D]+"

#: Lower-cases A-Z, keeps 0-9, a-z and every byte of a non-ASCII character, turns the rest into spaces.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

#: Bytes of rows that go to a Python worker at once; see ``in_arrow``.
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where that is unset and all is one
    process (``local[...]``, as in tests) an own one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, and lost executors cost no more than the tasks that ran there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with no_shuffle_left(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def no_shuffle_left(spark: SparkSession):
    """What runs within leaves no shuffle files when it ends; else they stay until the driver happens to collect its garbage,
    and the disk holds those of all steps at once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def discard(*tables: DataFrame) -> None:
    """Deletes what ``written`` has made, once nothing that is still to run reads it."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def checked(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """``df``, of a few short columns, for a join: to be broadcast if it is known to have no more than ``most`` rows, else as it is."""
    with no_shuffle_left(df.sparkSession):
        return F.broadcast(df) if df.count() <= most else df


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, in any case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def each_text(column: pa.Array, rows: int = 500):
    """The UTF-8 bytes of a string column one by one, a few rows at a time, so that a batch isn't held twice."""
    for k in range(0, len(column), rows):
        yield from texts_of(column.slice(k, rows))


def in_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow(fn, schema)`` in little memory: batches of up to ``BATCH_BYTES`` (a row, if it is longer) instead of ten
    thousand rows, which the JVM, the worker and the way back each hold, and a worker gives back what a task has freed. As
    the caller may run the plan later, the session keeps the lower limit; one lower still is left alone."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    limit = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key))
    if not 0 < limit <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))

    def run(batches):
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def arrow_table(spark: SparkSession, rows: pa.Table, schema: T.StructType) -> DataFrame:
    """A small table of the driver. Made from Arrow, the JVM alone reads it; rows of Python objects would go through workers of
    another kind than queries have, so that each executor starts a second daemon and its workers beside the first."""
    return spark.createDataFrame(rows, schema)


def give_back() -> None:
    """Memory that Arrow's pool and the C library hold for later goes back to the system, as the worker stays."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


@functools.cache
def _trim():
    """glibc's malloc_trim; None where there is none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


def add_columns(df: DataFrame, text: str, fields: list[T.StructField], fn) -> DataFrame:
    """``df`` with the columns ``fields`` behind its own. ``fn()`` runs once in each task and returns a function from the
    UTF-8 texts of a batch to a list of Arrow arrays."""
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches):
        made = fn()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *made(texts_of(b.column(at)))], names=[*b.schema.names, *(f.name for f in fields)])

    return df.mapInArrow(run, schema)


def crc_fold(doc_id: str, parts: int = 3) -> "F.Column":
    """crc32 of the id as text, modulo ``parts``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(parts)
