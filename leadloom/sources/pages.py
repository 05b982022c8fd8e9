"""Page snapshots (S8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions.urls import with_scheme


def scan_pages(pages: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """All snapshots with a scheme on every address, and ``scan_error`` where a page cannot be used.

    A failed download (null html) stays as a row; so does a page over ``max_bytes``, if a limit is set. The error is
    a column of its own, so jobs that choose pages by address never read a body.
    """
    error = F.when(F.col("html").isNull(), F.lit("HTML download failed"))
    if max_bytes is not None:
        error = error.when(F.octet_length("html") > max_bytes, F.lit("HTML is too large"))
    return pages.withColumns({"url": with_scheme(F.col("url")), "scan_error": error})


def read_pages(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    return scan_pages(spark.read.parquet(path), max_bytes)
