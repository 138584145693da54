"""New files and tables taken up as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.sources import pdf
from gridloom.sources.layout import PAGE


def pdf_stream(spark: SparkSession, folder: str, max_files: int = 64) -> DataFrame:
    """PDF files of a folder as a stream of scan rows."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", max_files).load(folder)
    return pdf.scan_pdfs(files.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), "content"))


def take_up(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs over all that is there and stops; the next run goes on where this one ended.

    ``write`` gets each batch with its number and must be idempotent in it, so that a
    batch repeated after a failure counts once.
    """
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_counts(words: DataFrame, late: str = "2 days") -> DataFrame:
    """Words by page and day of arrival from a stream with an ``arrived`` timestamp; late rows are awaited so long."""
    return words.withWatermark("arrived", late).groupBy(F.window("arrived", "1 day"), *PAGE).agg(F.count(F.lit(1)).alias("n_words"))


def stop_on(spark: SparkSession, tag: str) -> None:
    """Cancels every running job with a tag; sinks commit last, so nothing half-written stays."""
    spark.interruptTag(tag)
