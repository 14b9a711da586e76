"""Anonymisation of files as they arrive. Every step works on one document alone, so no state is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import EngineConf
from ..plans.pipeline import mask_text


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, text) of text files that arrive in a folder."""
    read = spark.readStream.format("text").option("wholetext", True).load(folder)
    return read.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.col("value").alias("text"))


def masked(stream: DataFrame, conf: EngineConf | None = None) -> DataFrame:
    """The stream with what the audit finds masked: (file_name, anonymized, n_found); each batch observes how many files and tokens those are."""
    found = mask_text(stream, conf or EngineConf())
    return found.observe("masked", F.count(F.lit(1)).alias("files"), F.sum("n_found").alias("tokens")) if stream.isStreaming else found


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False):
    """Start writing masked texts as Parquet; with ``once`` what is there now, and then stop."""
    query = masked(incoming(spark, folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).outputMode("append").start()
