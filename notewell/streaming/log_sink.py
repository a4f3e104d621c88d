"""The search log as the sink of a stream: a batch counts once, however often it is run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import Folder
from ..sources.query_log import log_rows


def _place(stream: str, batch_id: int | str) -> str:
    return f"stream={stream}/batch={batch_id}"


def batch_writer(path: str, stream: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch of searches goes to a folder of its own under path, named by stream and batch id.

    A batch whose folder is complete is not written again; what a lost run left of it is replaced. `stream` belongs to
    one checkpoint: with a new checkpoint, whose batches are numbered anew, take a new name.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, place = batch.sparkSession, _place(stream, batch_id)
        if not Folder(spark, path).exists(f"{place}/_SUCCESS"):
            log_rows(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{place}")

    return write


def log_stream(searches: DataFrame, path: str, stream: str, checkpoint: str, once: bool = True):
    """Starts the stream of searches (with `results`, see log_rows) into the log under path."""
    writer = searches.writeStream.foreachBatch(batch_writer(path, stream)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all complete batches of all streams, with `stream` and `batch`."""
    folder = Folder(spark, path)
    found = [f"{s}/{b}" for s in folder.names() if s.startswith("stream=") for b in folder.names(s)]
    complete = [f"{folder.root}/{x}" for x in found if folder.exists(f"{x}/_SUCCESS")]
    if not complete:
        raise FileNotFoundError(f"no complete batch below {path}")
    return spark.read.option("basePath", folder.root).parquet(*complete)
