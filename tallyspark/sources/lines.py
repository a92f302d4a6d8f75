"""Lines of text files in one order: by file path, then by place in the file.

A split knows its file and its byte offset, and its lines arrive in order, so a line's number is the
offset plus its place in the split: no more lines can begin in a split than it has bytes.  That is
counted in one pass over the batches; lines are neither shuffled nor read twice.  The rank of a file
comes from the listing that Spark has made to plan the scan.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.local import local_table

# Executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Lines that one file may hold; numbers of later files start behind those of earlier ones.
FILE_SPAN = 1 << 40
LINES = "value STRING, file STRING, line BIGINT"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, at = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = batch.column("file"), batch.column("start").to_numpy()
        change = np.ones(batch.num_rows, bool)
        change[1:] = pc.not_equal(files.slice(1), files.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        change[1:] |= starts[1:] != starts[:-1]
        change[0] = held != (files[0].as_py(), starts[0])
        rows = np.arange(batch.num_rows)
        begins = np.maximum.accumulate(np.where(change, rows, -1))
        places = np.where(begins < 0, at + rows, rows - begins)
        held, at = (files[-1].as_py(), starts[-1]), int(places[-1]) + 1
        yield pa.record_batch([batch.column("value"), files, pa.array(starts + places)], names=["value", "file", "line"])


#: A URI's scheme and slashes; without them all ways to write a file's URI agree.
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:/*"


def _decoded(uri: Column) -> Column:
    """Percent signs decoded; a plus is itself."""
    return F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``LINES`` of a file, or of all files of a folder and the folders in it.

    Files of one name in several folders are several files.  A missing path is an empty table.
    """
    try:
        scan = spark.read.option("recursiveFileLookup", "true").text(path)
    except Exception as error:  # noqa: BLE001 - only the missing path is tolerated
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return local_table(spark, [], LINES)
    rows = scan.select(
        "value", F.regexp_replace(_decoded(F.col("_metadata.file_path")), _SCHEME, "/").alias("file"),
        F.col("_metadata.file_block_start").alias("start"))
    names = sorted({re.sub(_SCHEME, "/", unquote(f)) for f in scan.inputFiles()})
    ranks = local_table(spark, list(zip(names, range(len(names)), strict=True)), "file STRING, rank BIGINT")
    return rows.mapInArrow(_number, LINES).join(ranks, "file").select(
        "value", "file", (F.col("rank") * F.lit(FILE_SPAN) + F.col("line")).alias("line"))


def stem(file: Column) -> Column:
    """A file's name without folder and ending."""
    return F.regexp_extract(file, r"([^/]*?)(?:\.[^./]*)?$", 1)
