"""The place of a row among the files that it was read from."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(files: DataFrame) -> Column:
    """A struct (file, block, row) that orders a file scan's rows by path, by the block's first byte and by the row in it.

    Spark packs blocks of several files into partitions by size, so a row number alone
    follows the packing; within a block it rises. `file` is the path without what all paths share.
    """
    paths = files.inputFiles()
    shared = os.path.commonprefix(paths)
    path = F.replace(F.col("_metadata.file_path"), F.lit(shared), F.lit("")) if shared else F.col("_metadata.file_path")
    return F.struct(path.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
