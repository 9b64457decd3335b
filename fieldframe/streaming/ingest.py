"""Image files that arrive in a folder, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.functions import formula
from fieldframe.sources import images

FILES = "path string, modificationTime timestamp, length long, content binary"


def image_stream(spark: SparkSession, folder: str, glob: str = "*", per_trigger: int = 100) -> DataFrame:
    """(img, h, w, bands, data) of each new file once; at most so many files a trigger."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(folder)
    return images.tiles(files)


def index_means(stream: DataFrame, equation: str) -> DataFrame:
    """(img, npixels, mean index) of each image."""
    return images.pixels(stream).groupBy("img").agg(F.count("*").alias("npixels"), F.avg(formula.column(equation)).alias("mean"))
