"""Relational paths for fingerprints too large for one row.

The narrow maps take a fingerprint as one row. A fingerprint beyond the row
bound goes through joins on grid cells instead, spread over as many tasks as
its cells occupy, after equal positions have been counted together. Results
are the same; structures come out in chunks of at most the row bound.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgemark.functions import angles as A
from ridgemark.functions import numeric as N
from ridgemark.operators import jiang as J
from ridgemark.operators.cylinder import ACTIVE, hull_vertices
from ridgemark.operators.probes import cut
from ridgemark.settings import (CELL_MU, CELL_RADIUS, CELL_STEP, CELL_TAU, CELLS, CONTEXT_RADIUS,
                                GAUSS_RATE, GAUSS_SCALE, GRID, GRID_SHIFT, HULL_MARGIN,
                                LEVEL_DIRECTIONS, LEVELS, MAX_INVALID_CELLS, MAX_ROW_MINUTIAE,
                                MIN_CONTEXT, NEIGHBOURS)

_FIRST_CELL, _CELL_GROWTH = 16, 4


def numbered(rows: DataFrame, order_by: Sequence[str], name: str, within: Sequence[str] = ()) -> DataFrame:
    """Adds the place of each row from 0 on by ``order_by``, of any sortable types, in each group of ``within``.

    Rows are dealt out by ranges of (group, order columns), so no task sorts a
    whole group, and equal first columns do not matter. Each range is ranked
    apart and shifted by the count of the ranges before it. A checkpoint holds
    the ranges fixed between the two steps.
    """
    ranged = cut(rows.repartitionByRange(*within, *order_by).withColumn("_range_", F.spark_partition_id()))
    keys = [*within, "_range_"]
    before = Window.partitionBy(*within).orderBy("_range_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy(*keys).agg(F.count("*").alias("n"))
               .select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before_")))
    offsets = offsets if within else F.broadcast(offsets)      # without groups a row per partition
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return (ranged.withColumn("_rank_", rank).join(offsets, keys)
            .withColumn(name, F.col("_before_") + F.col("_rank_") - 1).drop("_range_", "_rank_", "_before_"))


def number_minutiae(flat: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Number the minutiae of each fingerprint by ``order_by``, in two levels."""
    return cut(numbered(flat, order_by, "idx", ["fpid"]).select(
        "fpid", F.col("idx").cast("int").alias("idx"), "x", "y", "th", F.col("q").cast("int").alias("q")))


def _grid(df: DataFrame, x: str, y: str, size: int, spread: bool = False) -> DataFrame:
    """Add grid cell columns; ``spread`` copies a row to the cells around it."""
    gx, gy = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    if not spread:
        return df.withColumn("gx", gx).withColumn("gy", gy)
    around = F.array(*[F.lit(v) for v in (-1, 0, 1)])
    return (df.withColumn("gx", F.explode(F.transform(around, lambda v: gx + v)))
            .withColumn("gy", F.explode(F.transform(around, lambda v: gy + v))))


def neighbour_rows(flat: DataFrame) -> DataFrame:
    """Rows ``fpid, idx, k, neighbour, d2`` of the nearest minutiae.

    Grid cells grow until every minutia has four distances known to be its
    smallest. Of equal positions only the two highest indexes can be
    neighbours, so a crowded position is two rows.
    """
    top2 = F.row_number().over(Window.partitionBy("fpid", "x", "y").orderBy(F.desc("idx")))
    spots = (flat.withColumn("copy", top2).filter("copy <= 2")
             .select("fpid", F.col("idx").alias("neighbour"), F.col("x").alias("nx"), F.col("y").alias("ny")))
    extent = flat.groupBy("fpid").agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    widest = extent.agg(F.max(F.greatest("w", "h"))).first()[0] or 0
    open_rows, found, size = flat.select("fpid", "idx", "x", "y"), None, _FIRST_CELL
    while True:
        last = size > widest
        d2 = N.square_distance(F.col("nx"), F.col("ny"), F.col("x"), F.col("y"))
        near = (_grid(open_rows, "x", "y", size).join(_grid(spots, "nx", "ny", size, spread=True), ["fpid", "gx", "gy"])
                .filter(F.col("idx") != F.col("neighbour")).withColumn("d2", d2.cast("bigint")))
        near = near if last else near.filter(F.col("d2") <= size * size)
        each = near.groupBy("fpid", "idx", "d2").agg(F.max("neighbour").alias("neighbour"))
        rank = F.row_number().over(Window.partitionBy("fpid", "idx").orderBy("d2"))
        ranked = each.withColumn("k", rank).filter(F.col("k") <= NEIGHBOURS)
        full = F.max("k").over(Window.partitionBy("fpid", "idx")) == NEIGHBOURS
        done = cut(ranked.withColumn("full", full).filter("full").select("fpid", "idx", "k", "neighbour", "d2"))
        found = done if found is None else found.unionByName(done)
        if last:
            return found
        open_rows = open_rows.join(done.filter("k = 1").select("fpid", "idx"), ["fpid", "idx"], "left_anti")
        size *= _CELL_GROWTH


def _chunked(rows: DataFrame, ls: Column) -> DataFrame:
    """Collect structures into rows ``fpid, chunk, n_chunks, n_ls, ls``."""
    chunk = F.floor(F.col("idx") / MAX_ROW_MINUTIAE).cast("int")
    chunks = cut(rows.select("fpid", chunk.alias("chunk"), ls.alias("ls")).groupBy("fpid", "chunk")
                 .agg(F.sort_array(F.collect_list("ls")).alias("ls")))
    sizes = chunks.groupBy("fpid").agg(F.count("*").cast("int").alias("n_chunks"),
                                       F.sum(F.size("ls")).alias("n_ls"))
    return chunks.join(sizes, "fpid").select("fpid", "chunk", "n_chunks", "n_ls", "ls")


def jiang_features(flat: DataFrame) -> DataFrame:
    """Neighbourhood vectors of flat minutiae, as the narrow map builds them."""
    far = flat.select("fpid", F.col("idx").alias("neighbour"), F.struct("x", "y", "th").alias("n"))
    near = neighbour_rows(flat).join(far, ["fpid", "neighbour"])
    lists = near.groupBy("fpid", "idx").agg(
        F.sort_array(F.collect_list(F.struct("k", "d2", "n"))).alias("near"))
    rows = flat.join(lists, ["fpid", "idx"])
    at = {k: F.get("near", F.lit(k - 1)) for k in J.K}

    def bearing(k):
        n = at[k]["n"]
        angle = F.atan2((F.col("y") - n["y"]).cast("double"), (F.col("x") - n["x"]).cast("double"))
        return A.trunc(angle * 128 / F.lit(np.pi))

    fields = [F.col("idx").alias("lsid"), "x", "y", "th"]
    fields += [F.sqrt(at[k]["d2"].cast("double")).alias(f"d{k}") for k in J.K]
    fields += [A.wrap8(bearing(k) + F.col("th")).alias(f"r{k}") for k in J.K]
    fields += [A.wrap8(at[k]["n"]["th"] - F.col("th")).alias(f"v{k}") for k in J.K]
    return _chunked(rows, F.struct(*fields))


def hulls(flat: DataFrame) -> DataFrame:
    """Rows ``fpid, hull ARRAY<STRUCT<x, y>>``.

    Only the lowest and highest point of each column of pixels can lie on the
    hull, so a group is at most twice the image width.
    """
    ends = flat.groupBy("fpid", "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))

    def hull(key, table):
        x = table["x"].to_numpy()
        points = hull_vertices(np.tile(x, 2), np.concatenate([table["lo"].to_numpy(), table["hi"].to_numpy()]))
        listed = pa.array([[{"x": int(a), "y": int(b)} for a, b in points]],
                          pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))
        return pa.table({"fpid": [key[0].as_py()], "hull": listed})

    return ends.groupBy("fpid").applyInArrow(hull, "fpid string, hull array<struct<x:int, y:int>>")


def hull_edges(flat: DataFrame) -> DataFrame:
    following = F.transform("hull", lambda p, i: F.struct(
        p["x"].alias("x1"), p["y"].alias("y1"),
        F.get("hull", (i + 1) % F.size("hull"))["x"].alias("x2"),
        F.get("hull", (i + 1) % F.size("hull"))["y"].alias("y2")))
    return hulls(flat).select("fpid", F.inline(following))


def _inside(px: Column, py: Column) -> Column:
    """Within the hull or its margin, over the array column ``edges``."""
    inside = F.forall("edges", lambda e: N.cross(e["x1"], e["y1"], e["x2"], e["y2"], px, py) >= 0)
    close = F.exists("edges", lambda e: N.segment_distance(
        px, py, e["x1"], e["y1"], e["x2"], e["y2"]) <= HULL_MARGIN)
    return inside | close


def _crowded(flat: DataFrame, spots: DataFrame) -> DataFrame:
    """Positions ``fpid, x, y`` with enough minutiae in the context radius.

    Any two points of one square of side radius/√2 are within the radius, so
    only sparse squares need to look around.
    """
    side = int(CONTEXT_RADIUS / 2 ** 0.5)
    squares = _grid(flat, "x", "y", side).groupBy("fpid", "gx", "gy").agg(F.count("*").alias("n"))
    placed = _grid(spots.select("fpid", "x", "y").distinct(), "x", "y", side).join(squares, ["fpid", "gx", "gy"])
    dense = placed.filter(F.col("n") >= MIN_CONTEXT).select("fpid", "x", "y")
    sparse = placed.filter(F.col("n") < MIN_CONTEXT).select("fpid", "x", "y")
    weights = spots.groupBy("fpid", F.col("x").alias("nx"), F.col("y").alias("ny")).agg(F.sum("w").alias("w"))
    around = (_grid(sparse, "x", "y", CONTEXT_RADIUS)
              .join(_grid(weights, "nx", "ny", CONTEXT_RADIUS, spread=True), ["fpid", "gx", "gy"])
              .filter(N.square_distance(F.col("nx"), F.col("ny"), F.col("x"), F.col("y")) <= CONTEXT_RADIUS ** 2))
    enough = around.groupBy("fpid", "x", "y").agg(F.sum("w").alias("n")).filter(F.col("n") >= MIN_CONTEXT)
    return dense.unionByName(enough.select("fpid", "x", "y"))


def cylinder_features(flat: DataFrame, keep_invalid: bool = False) -> DataFrame:
    """Cylinder codes of flat minutiae, as the narrow map builds them.

    A cylinder depends only on position and direction, so equal minutiae are
    counted once with a weight, and cells meet minutiae by grid cell.
    """
    key = ["fpid", "x", "y", "th"]
    spots = flat.groupBy(*key).agg(F.count("*").alias("w"))
    edges = hull_edges(flat).groupBy("fpid").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    grid = F.array(*[F.struct(F.lit(int(c)).alias("cell"), F.lit(int(c) // GRID + 1 - GRID_SHIFT).alias("ri"),
                              F.lit(int(c) % GRID + 1 - GRID_SHIFT).alias("rj")) for c in ACTIVE])
    rad = A.radians(F.col("th"))
    centres = (spots.join(edges, "fpid").select(*key, "edges", F.inline(grid))
               .withColumn("px", CELL_STEP * (F.cos(rad) * F.col("ri") + F.sin(rad) * F.col("rj")) + F.col("x"))
               .withColumn("py", CELL_STEP * (F.cos(rad) * F.col("rj") - F.sin(rad) * F.col("ri")) + F.col("y"))
               .filter(_inside(F.col("px"), F.col("py"))).select(*key, "cell", "px", "py"))
    other = spots.select("fpid", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("th").alias("nth"), "w")
    d2 = N.square_distance(F.col("px"), F.col("py"), F.col("nx"), F.col("ny"))
    itself = (F.col("x") == F.col("nx")) & (F.col("y") == F.col("ny")) & (F.col("th") == F.col("nth"))
    count = F.when(itself, F.col("w") - 1).otherwise(F.col("w"))
    near = (_grid(centres, "px", "py", CELL_RADIUS)
            .join(_grid(other, "nx", "ny", CELL_RADIUS, spread=True), ["fpid", "gx", "gy"])
            .filter(d2 <= CELL_RADIUS ** 2)
            .withColumn("s", count * GAUSS_SCALE / F.exp(d2 * GAUSS_RATE)))
    table = F.array(*[F.lit(w) for w in N.direction_weights()])

    def weight(k):
        step = A.wrap8(A.wrap8(F.col("th") - F.col("nth")) - LEVEL_DIRECTIONS[k])
        return F.element_at(table, step + 129)

    levels = range(LEVELS)
    sums = near.groupBy(*key, "cell").agg(*[F.sum(F.col("s") * weight(k)).alias(f"s{k}") for k in levels])
    squashed = F.array(*[N.sigmoid(F.coalesce(f"s{k}", F.lit(0.0)), CELL_MU, CELL_TAU).cast("float") for k in levels])
    cells = (centres.select(*key, "cell").join(sums, [*key, "cell"], "left")
             .groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("cell", squashed))).alias("cells")))
    missing = F.array_repeat(F.lit(-1.0).cast("float"), LEVELS)
    cm = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(GRID * GRID - 1)), lambda c: F.coalesce(
        F.try_element_at("cells", c), missing)))
    crowded = _crowded(flat, spots).withColumn("crowded", F.lit(True))
    codes = (spots.select(*key).join(cells, key, "left").withColumn("cm", F.coalesce(
        cm, F.array_repeat(F.lit(-1.0).cast("float"), CELLS))).drop("cells").join(crowded, ["fpid", "x", "y"], "left"))
    squares = F.aggregate(F.filter("cm", lambda c: c > 0), F.lit(0.0),
                          lambda acc, c: acc + c.cast("double") * c.cast("double"))
    invalid = F.size(F.filter("cm", lambda c: c < 0)) >= MAX_INVALID_CELLS
    norm = F.when(invalid | F.col("crowded").isNull(), F.lit(-1.0)).otherwise(F.sqrt(squares))
    rows = flat.join(codes.withColumn("norm", norm).drop("crowded"), key)
    rows = rows if keep_invalid else rows.filter("norm >= 0")
    return _chunked(rows, F.struct(F.col("idx").alias("lsid"), "x", "y", "th", "norm", "cm"))
