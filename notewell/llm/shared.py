"""Scratch tables in the folder that all executors share, and small helpers of the operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Within once_run: shuffle files go with their query, and batches for Python are small, whatever the length of a row.
_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_own_dir: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`. Where that is unset, a local folder if all tasks run in this process, else an error."""
    global _own_dir
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="notewell-")
    return f"file://{_own_dir}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/notewell/{name}-{uuid.uuid4().hex[:12]}"


class once_run:
    """Within it, queries run with _CONF: nothing reads their shuffle files again."""

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.old = {k: self.conf.get(k, None) for k in _CONF}
        for k, v in _CONF.items():
            self.conf.set(k, v)

    def __exit__(self, *_: object) -> None:
        for k, v in self.old.items():
            self.conf.set(k, v) if v is not None else self.conf.unset(k)


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Writes df to the shared scratch folder and reads it back: cuts the lineage and survives lost executors. Without a
    codec the session's is used; zstd takes less room for texts, and none less for hashes."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with once_run(spark):
        (df.write.option("compression", codec) if codec else df.write).mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(*tables: DataFrame) -> None:
    """Deletes the folders behind materialized tables that no later plan reads."""
    for df in tables:
        drop_folders(df.sparkSession, {f.rpartition("/")[0] for f in df.inputFiles()})


def drop_folders(spark: SparkSession, folders: Iterable[str]) -> None:
    """Deletes scratch folders; other folders are left alone."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        if "/notewell/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def join_counted(rows: DataFrame, counted: DataFrame, on: list[str], count: str, total: int, how: str = "left") -> DataFrame:
    """rows joined with counted, which has one row per key and, in `count`, how many of the `total` rows have that key.

    Keys of a thousandth of the rows or more, which are 1,000 at most, are broadcast, so none of their rows is shuffled;
    the other keys are small and go the usual way. rows is read twice. Columns `on` must not be null.
    """
    least = max(200, total // 1000)
    values = [c for c in counted.columns if c not in on]
    hot = counted.filter(F.col(count) >= least).select(*on, F.struct(*values).alias("_hot"))
    marked = rows.join(F.broadcast(hot), on, "left")
    warm = marked.filter("_hot IS NOT NULL").select(*rows.columns, *[F.col(f"_hot.{v}").alias(v) for v in values])
    cold = marked.filter("_hot IS NULL").drop("_hot").join(counted.filter(F.col(count) < least), on, how)
    return warm.unionByName(cold)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(doc_id: Column | str) -> Column:
    """crc32 of the decimal text of an id; null ids count as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def binary_ends(column: pa.Array) -> np.ndarray:
    """Bytes of a binary or string column up to the end of each row."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32)
    own = offsets[column.offset : column.offset + len(column) + 1]
    return own[1:].astype(np.int64) - (own[0] if len(own) else 0)


def slices(batch: pa.RecordBatch, sized: int, most_bytes: int, most_rows: int = 4096):
    """Parts of a batch of at most most_bytes in column `sized`, or of one longer row."""
    if not batch.num_rows:
        return
    ends, start, before = binary_ends(batch.column(sized)), 0, 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, before + most_bytes, side="right"))
        stop = min(max(stop, start + 1), start + most_rows, batch.num_rows)
        yield batch.slice(start, stop - start)
        before, start = int(ends[stop - 1]), stop


def ascii_words(texts: pa.Array) -> pa.Array:
    """Lists of the words between ASCII blanks; words may be empty at a text's ends."""
    # Taken anew: some kernels read a slice of another array from the wrong place.
    return pc.ascii_split_whitespace(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()))


def release_memory() -> None:
    """Gives memory that this process no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_worker_tables: dict[object, object] = {}


def worker_table(key: object, make: Callable[[], object]) -> object:
    """What this process keeps from task to task under key. It keeps one operator's: what it had of another one goes first."""
    if key not in _worker_tables:
        _worker_tables.clear()
        release_memory()
        _worker_tables[key] = make()
    return _worker_tables[key]


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker, which waits for its next task, releases memory."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return wrapped
