"""Array-of-struct columns between Arrow batches and numpy, without row loops."""

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession


MAX_BATCH_ROWS = 512


def bounded_batches(spark: SparkSession) -> None:
    """Lets Python workers take at most MAX_BATCH_ROWS fingerprints at a time: with its cells, one may have a megabyte."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= MAX_BATCH_ROWS:
        spark.conf.set(name, str(MAX_BATCH_ROWS))


def offsets_of(column: pa.Array) -> np.ndarray:
    return column.offsets.to_numpy()


def struct_fields(column: pa.Array, names) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row offsets (from zero) and the named fields of an ARRAY<STRUCT> column."""
    offsets = offsets_of(column)
    flat = column.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    fields = flat.flatten()
    index = {flat.type.field(i).name: i for i in range(flat.type.num_fields)}
    return offsets - offsets[0], {n: fields[index[n]].to_numpy(zero_copy_only=False) for n in names}


def float_lists(column: pa.Array, name: str, width: int) -> np.ndarray:
    """The ARRAY<FLOAT> field ``name`` of an ARRAY<STRUCT> column as a matrix."""
    offsets = offsets_of(column)
    flat = column.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    field = flat.flatten()[flat.type.get_field_index(name)]
    inner = field.offsets.to_numpy()
    values = field.values.slice(int(inner[0]), int(inner[-1] - inner[0])).to_numpy()
    return values.reshape(-1, width)


def struct_lists(lengths, fields: dict[str, pa.Array]) -> pa.ListArray:
    """ARRAY<STRUCT> column from flat fields and the length of each row."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    structs = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    return pa.ListArray.from_arrays(pa.array(offsets), structs)


def pieces(batches, goal: int, column: str = "ls"):
    """Batches cut to runs of rows with about ``goal`` entries of an array column; a row is never cut."""
    for batch in batches:
        offsets = offsets_of(batch[column])
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + goal, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def matrix_lists(matrix: np.ndarray) -> pa.ListArray:
    rows, width = matrix.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))
