"""An extension: images that arrive in a folder, catalogued as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platterlake.sources import dfs
from platterlake.sources.images import surfaces, with_layout

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Catalogue entries of flat images as they arrive; no state is kept, each image is read once."""
    files = spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", "*.{ssd,dsd}").load(folder)
    images = files.select(F.col("path").alias("image_id"), "path", "length", "content")
    return dfs.entries(dfs.identify(surfaces(with_layout(images))))
