"""A6 media inventory: list media files under a root with the ``binaryFile`` source, projected to path/length
(the content column is pruned, so no file body is read). A missing root is an empty inventory."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, length long, modificationTime timestamp"


def media_inventory(spark: SparkSession, root: str, glob: str | None = None, recursive: bool = False,
                    relative: bool = True) -> DataFrame:
    """(path, length, modificationTime) of the files in the folder ``root`` (with ``recursive`` also below it); ``relative`` strips the scheme and root
    prefix so paths compare with manifest values written relative to a media root."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    try:
        df = reader.load(root).select("path", "length", "modificationTime")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)
    if relative:
        df = df.withColumn("path", _strip_root("path", root))
    return df


def _strip_root(col: str, root: str):
    """File URI or path -> path relative to ``root`` (scheme and any number of leading slashes ignored)."""
    no_scheme = F.regexp_replace(F.col(col), r"^[A-Za-z][A-Za-z0-9+.-]*:", "")
    no_slash = F.regexp_replace(no_scheme, r"^/+", "")
    prefix = "^" + re.escape(root.strip("/")) + "/"
    return F.regexp_replace(no_slash, prefix, "")
