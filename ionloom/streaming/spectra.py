"""The row-local operators under Structured Streaming: files of spectra as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ionloom.sources.spectra import parse_mgf


def stream_mgf(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of MGF blocks from files that are put into a folder; no state is kept."""
    return parse_mgf(spark.readStream.format("text").option("lineSep", "END IONS").load(folder))
