"""Taking in workbooks as they arrive: each new file is decoded once and its cells are appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.sources.scan import decoded

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, per_batch: int = 64) -> DataFrame:
    """What new files hold, as rows of sources.scan.FOUND; per_batch bounds the files decoded at a time."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.xls*").option("maxFilesPerTrigger", per_batch).load(folder)
    named = files.select(F.regexp_extract(F.url_decode("path"), r"([^/]+)$", 1).alias("file_name"), "content")
    return decoded(named)


def ingest(spark: SparkSession, folder: str, target: str, progress: str) -> StreamingQuery:
    """Appends to the Parquet table `target` until all files that are there are read; `progress` remembers which were."""
    return arriving(spark, folder).writeStream.format("parquet").option("path", target).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start()
