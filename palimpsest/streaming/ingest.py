"""Incremental ingestion: files as a stream, their pages as a keyed table that takes each micro-batch once."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..operators import store
from ..sources import files, reader


def file_stream(spark: SparkSession, folder: str, pattern: str = "*", per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as rows (path, modificationTime, length, content)."""
    return spark.readStream.format("binaryFile").schema(files.FILE_SCHEMA).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(folder)


@contextmanager
def many_files(spark: SparkSession) -> Iterator[None]:
    """Within, a session lists files by few tasks and not by one each (up to 10,000), and a task may read 2000 small ones
    and not 32; where the session says otherwise, that stays."""
    wanted = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * spark.sparkContext.defaultParallelism), "spark.sql.files.openCostInBytes": str(64 << 10)}
    own = {k: v for k, v in wanted.items() if spark.conf.get(k, None) is None}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in own:
            spark.conf.unset(k)


def ingest(spark: SparkSession, folder: str, output: str, checkpoint: str, pattern: str = "*", per_trigger: int = 1000) -> DataFrame:
    """Parse all files that have come since the last call into the table of pages at ``output``; returns its rows.

    The trigger ends when everything that is there has been read; each file is read once over all calls. A batch is
    merged under the stream's own name and the batch's number, so one that Spark repeats, because its end was not
    recorded, leaves the table as it was. A file that comes again with other content replaces its pages."""

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        stream = session.sparkContext.getLocalProperty("sql.streaming.queryId")  # of the checkpoint: stays over restarts
        _table(session, output).merge(reader.pages(files.detect(batch)), f"stream {stream}", number)

    with many_files(spark):
        q = file_stream(spark, folder, pattern, per_trigger).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    return _table(spark, output).read()


def _table(spark: SparkSession, path: str) -> store.StateTable:
    return store.StateTable(spark, path, ["path", "page_index"], ["path"], generation="sha256")
