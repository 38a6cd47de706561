"""Brings this package to the Python workers of the session."""

import os
import tempfile
import weakref
import zipfile
from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

import ridgemark

_done: "weakref.WeakSet[SparkContext]" = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once per Spark context.

    Spark serves the archive to every executor, so workers import the package
    whatever folder the driver was started in.
    """
    context = spark.sparkContext
    if context in _done:
        return
    root = os.path.dirname(os.path.abspath(ridgemark.__file__))
    path = os.path.join(tempfile.mkdtemp(), "ridgemark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    _done.add(context)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)
    return run
