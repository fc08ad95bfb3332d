"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

#: A word, wherever this subpackage counts words: a maximal run of bytes other than ASCII white space.
#: ``bytes.split()`` splits on exactly the same six separators.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a Python worker handles at once.
CHUNK_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where none is named.

    Only a local session gets one of our own: on a cluster a machine-local folder would hold a part of each table.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='prosemeter-')}"
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again, which cuts the lineage.

    What is read later survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/prosemeter-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot if it holds over one in so many rows; so there are fewer hot keys than this, whatever the data.
HOT = 1000


def join_each(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """left inner-joined with right, which has each key once and in `weight` the number of left's rows of the key.

    Rows of hot keys stay where they are: the rows of right for them, fewer than HOT, are broadcast. Only the others
    are shuffled by key, so no key brings more than one in HOT of all rows to a task. total: left's rows.
    """
    is_hot = F.col(weight) * HOT > total
    hot = F.broadcast(right.where(is_hot).drop(weight))
    rest = left.join(F.broadcast(right.where(is_hot).select(*keys)), keys, "left_anti")
    return left.join(hot, keys).unionByName(rest.join(right.where(~is_hot).drop(weight), keys))


def possibly_in(df: DataFrame, ids: DataFrame, column: str, bits: int = 1 << 25) -> DataFrame:
    """Rows of df whose id may be in ids, which is materialised and has the id only; the others surely are not.

    A bitmap of the ids' hashes, of `bits` bits at most whatever the number of ids, is broadcast, so that wide rows
    are let go where they lie, before a join shuffles them.
    """
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    maps = ids.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bitmap"))
    placed = df.withColumns({"p": place}).withColumns({"bucket": F.expr("bitmap_bucket_number(p)"), "bit": F.expr("bitmap_bit_position(p)")})
    byte = F.conv(F.hex(F.expr("substring(bitmap, CAST(bit DIV 8 AS INT) + 1, 1)")), 16, 10).cast("long")
    return placed.join(F.broadcast(maps), "bucket").where(F.getbit(byte, F.pmod("bit", F.lit(8)).cast("int")) == 1).select(*df.columns)


def blocks(batch: pa.RecordBatch, text: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batch whose binary column number `text` holds about `limit` bytes, one row at least."""
    column, start, held = batch.column(text), 0, 0
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def let_go() -> None:
    """Gives back what this worker's allocators hold but do not use; idle workers count towards an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def over_texts(function: Callable[[list[bytes | None]], pa.Array], returns: str) -> Callable[[Column], Column]:
    """A column function that maps whole texts, as bytes, block by block. The type is as in DDL.

    It is named nondeterministic, though it is not, so that Catalyst never computes it twice in a stage, once for a
    filter and once for what is selected: that would take twice the time and twice the Python workers.
    """

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = [function(b.column(0).to_pylist()) for b in blocks(pa.RecordBatch.from_arrays([column], ["t"]), 0)]
            yield pa.concat_arrays(parts) if parts else function([])

    mapped = F.arrow_udf(run, returns, ArrowUDFType.SCALAR_ITER).asNondeterministic()
    return lambda text: mapped(text.cast("binary"))


def bounded_batches(spark: SparkSession, limit: str = "8388608") -> None:
    """Lets Spark cut the batches it sends to Python workers by bytes also, unless the session says how."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, str(2**31 - 1), "2147483647b"):
        spark.conf.set(name, limit)
