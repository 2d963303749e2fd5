"""Continuous conversion: new files in a folder are converted as they come, each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import facts as K
from ..functions import hangul as G


def new_texts(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the whole text files of a folder: path, text."""
    stream = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return stream.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def converted(texts: DataFrame, text_col: str = "text", noun_ending: bool = False) -> DataFrame:
    """Texts with notation and endings in report style, in a column ``converted``; works on streams and tables."""
    return texts.withColumn("converted", G.formal_text(K.notation(F.col(text_col)), noun_ending))


def watch(spark: SparkSession, folder: str, sink: str, checkpoint: str, convert: Callable[[DataFrame], DataFrame] = converted, once: bool = False) -> StreamingQuery:
    """Convert new files until stopped (``once``: those there now), as Parquet; the checkpoint folder remembers what
    is done, so a restart neither repeats nor leaves out a file."""
    writer = convert(new_texts(spark, folder)).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
