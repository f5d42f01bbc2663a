"""Image files as rasters."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from foliospark.codecs.raster import read_png
from foliospark.sources.documents import files, rows_of

SCHEMA = "path string, w int, h int, rgb binary, error string"


def png_files(spark: SparkSession, folder: str) -> DataFrame:
    """All PNG files of a folder in order of their names; unsupported kinds have an error."""
    def read(_: str, data: bytes) -> Iterator[dict]:
        img = read_png(data)
        yield {"w": img.shape[1], "h": img.shape[0], "rgb": img.tobytes()}

    return rows_of(files(spark, folder, "*.[pP][nN][gG]"), SCHEMA, read).orderBy("path")
