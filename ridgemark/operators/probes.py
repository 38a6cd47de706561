"""Ways to bring the probe side of a match to the templates."""

import math
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgemark.operators.arrow import bounded_batches

_ROWS = 256                     # of the store, read at once


def probe_shape(inputs: DataFrame) -> tuple[int, int]:
    """Local structures in a probe set and in its largest probe (one small aggregate)."""
    sizes = inputs.groupBy("fpid").agg(F.sum(F.size("ls")).alias("n"))
    total, largest = sizes.agg(F.sum("n"), F.max("n")).first()
    return total or 0, largest or 0


def probe_tables(batches: Iterable[pa.RecordBatch], bound: int) -> Iterator[pa.Table]:
    """Rows in the order of (fpid, chunk) as tables of at most ``bound`` structures.

    A probe is whole in one table unless it alone exceeds the bound; then its
    rows are split over tables of its own and the next.
    """
    held, size, last = [], 0, None
    for batch in batches:
        names, wholes = batch["fpid"].to_pylist(), batch["n_ls"].to_pylist()
        sizes = batch["ls"].value_lengths().to_pylist()
        first = 0
        for k, (name, whole, own) in enumerate(zip(names, wholes, sizes)):
            if size and size + (own if name == last else max(own, whole)) > bound:
                held.append(batch.slice(first, k - first))
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, first = [], 0, k
            size, last = size + own, name
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class ProbeSide:
    """The probe side of a match: blocks of at most ``bound`` local structures.

    A set within the bound is one broadcast block. A larger one is written once
    to the shared folder, ordered by id, and Spark brings its files to the
    executors; each task reads them block by block for its template rows, so
    that any number of blocks is one scan of the templates and neither driver
    nor broadcasts grow with the probe set. ``prepare`` makes a table ready to
    match. ``split`` says whether a probe exceeds the bound and may come in
    several blocks.
    """

    def __init__(self, inputs: DataFrame, bound: int, prepare: Callable, shape: tuple[int, int] | None = None):
        bounded_batches(inputs.sparkSession)
        size, largest = shape or probe_shape(inputs)
        columns = inputs.select("fpid", "chunk", "n_ls", "ls")
        self.bound, self.prepare, self.split = bound, prepare, largest > bound
        if size <= bound:
            self.files = None
            self.one = inputs.sparkSession.sparkContext.broadcast(prepare(columns.toArrow().combine_chunks()))
        else:
            self.files = _stored(columns, math.ceil(size / bound))

    def blocks(self) -> Iterator:
        """The blocks, inside a task."""
        if self.files is None:
            yield self.one.value
            return
        batches = (b for name in self.files for b in pq.ParquetFile(SparkFiles.get(name)).iter_batches(_ROWS))
        for table in probe_tables(batches, self.bound):
            yield self.prepare(table)


def _stored(columns: DataFrame, parts: int) -> list[str]:
    """Writes probe rows in ranges of ids; the names of the files, in order, known to all executors."""
    spark = columns.sparkSession
    path = f"{shared_folder(spark)}/probes-{uuid.uuid4().hex}"
    order = ("fpid", "chunk")
    columns.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.parquet(path)
    files = sorted(spark.read.parquet(path).inputFiles(), key=os.path.basename)
    for file in files:
        spark.sparkContext.addFile(file)
    return [os.path.basename(file) for file in files]


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; local sessions get one of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir, a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint, so that a loop keeps a short lineage and survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
