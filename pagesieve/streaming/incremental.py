"""The one-scan plan over page files as they arrive.

Every page is read on its own, so the stream holds no state and needs no
watermark. The file sink and its checkpoint make each input file count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagesieve.plans.one_scan import page_facts
from pagesieve.sources.pages import PAGE_SCHEMA


def stream_pages(
    spark: SparkSession, folder: str, files_per_batch: int | None = None
) -> DataFrame:
    """Page files of ``folder`` as a stream; a file's age is never a reason to skip it.

    ``files_per_batch`` bounds a micro-batch, so that a failure costs one batch and not
    the whole backlog. The driver keeps the list of the files it has seen.
    """
    reader = spark.readStream.schema(PAGE_SCHEMA).option("maxFileAge", "36500d")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def append_facts(pages: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append the facts of all page files not seen before to ``table``, then end."""
    return (
        page_facts(pages)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(table)
    )
