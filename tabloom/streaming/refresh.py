"""A folder of workbooks as a stream: changed files are parsed again, others are not.

Freshness is commonly kept by path, modification time and length; a file
source has the same rule, so a new version of a file is a new row.  Each batch
replaces the partitions of its workbooks only (dynamic partition overwrite).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import ship
from ..sources.ooxml import CELL_SCHEMA

FILES = "path string, modificationTime timestamp, length long, content binary"


def workbook_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files that come or change."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.xls[xm]").load(folder)


def _parse(batches):
    """Cells of whole files; a file is held by one task, as a ZIP archive must be."""
    import os
    import tempfile

    import pandas as pd

    from ..sources.ooxml import Package, WorkbookError

    names = [c.split()[0] for c in CELL_SCHEMA.split(", ")]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            fd, local = tempfile.mkstemp(suffix=os.path.splitext(path)[1])
            try:
                with os.fdopen(fd, "wb") as f:
                    f.write(content)
                package = Package(local)
                for sheet in package.sheets:
                    rows = []
                    for cell in package.cells(sheet):
                        rows.append((path, *cell[1:]))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=names)
            except WorkbookError as x:  # a broken file is a row that says so, not a lost stream
                yield pd.DataFrame([(path, 0, x.code, 0, 0, "error", str(x), *[None] * 7)], columns=names)
            finally:
                os.unlink(local)


def parsed(files: DataFrame) -> DataFrame:
    """Cells of a frame of files, batch or stream."""
    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(_parse, CELL_SCHEMA)


def refresh(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keep a Parquet index of cells, one partition a workbook, up to date; runs what is there and stops."""

    def replace(batch: DataFrame, _: int) -> None:
        latest = batch.withColumn("__r", F.max("modificationTime").over(_by_path())).where("modificationTime = __r").dropDuplicates(["path"])
        cells = parsed(latest).withColumn("file", F.sha2(F.col("workbook").cast("binary"), 256))
        cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(out)

    return files.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _by_path():
    from pyspark.sql import Window

    return Window.partitionBy("path")


def stale_cells(edits: DataFrame, dependents: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of edits (sheet_id, n, at) against a table of dependents (sheet_id, n -> stale_sheet_id, stale_n).

    Late edits within the watermark count; repeated ones within it do not.
    """
    once = edits.withWatermark("at", delay).dropDuplicatesWithinWatermark(["sheet_id", "n"])
    return once.join(dependents, ["sheet_id", "n"]).select("stale_sheet_id", "stale_n", "at")
