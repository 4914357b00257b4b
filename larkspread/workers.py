"""Runs Arrow functions in Python workers that may lack this package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_PACKAGE = Path(__file__).resolve().parent
_shipped: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Give the session's workers this package, once; executors fetch it from the
    driver, those that replace lost ones too."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="larkspread-package-")
    path = os.path.join(folder, "larkspread.zip")
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(_PACKAGE.rglob("*.py")):
            z.write(source, source.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(path)
    _shipped[app] = path


def arrow_schema(schema: T.StructType) -> pa.Schema:
    """The Arrow twin of a Spark schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)
