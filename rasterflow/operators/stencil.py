"""Neighbourhood operators on pixel tables (frame_id, y, x, values) as windows, aggregates and joins.

Every window is partitioned by a frame's row or column, so frames of any number spread over the cluster; one row or
column of one frame is what a task holds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def box_radius(sigma: float) -> int:
    return 0 if sigma <= 0.5 else max(1, math.floor(math.sqrt(sigma * sigma + 0.25) - 0.5 + 0.5))


def _lines(axis: str) -> tuple[str, str]:
    return ("y", "x") if axis == "x" else ("x", "y")


def box_pass(df: DataFrame, columns: list[str], radius: int, axis: str, size: str) -> DataFrame:
    """Mean of 2r+1 neighbours along one axis; beyond the edge its value is repeated. size: column with the axis's length."""
    if radius == 0:
        return df
    fixed, moving = _lines(axis)
    line = Window.partitionBy("frame_id", fixed).orderBy(moving)
    near, whole = line.rowsBetween(-radius, radius), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.greatest(F.lit(0), radius - F.col(moving))
    after = F.greatest(F.lit(0), F.col(moving) + radius - (F.col(size) - 1))
    return df.withColumns({c: (F.sum(c).over(near) + before * F.first(c).over(whole) + after * F.last(c).over(whole)) / (2 * radius + 1) for c in columns})


def box_blur(df: DataFrame, columns: list[str], sigma: float, passes: int = 3) -> DataFrame:
    """Three box passes over each axis, an approximate Gaussian. All columns share one sort per pass."""
    r = box_radius(sigma)
    for _ in range(passes):
        df = box_pass(box_pass(df, columns, r, "x", "width"), columns, r, "y", "height")
    return df


def gaussian_kernel(sigma: float, radius: int | None = None) -> list[float]:
    radius = math.ceil(3 * sigma) if radius is None else radius
    k = [math.exp(-i * i / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    return [x / sum(k) for x in k]


def gaussian_blur(df: DataFrame, columns: list[str], sigma: float) -> DataFrame:
    """Finite separable Gaussian for small sigma: weighted lags and leads, edges repeated."""
    kernel = gaussian_kernel(sigma)
    radius = len(kernel) // 2
    for axis in ("x", "y"):
        fixed, moving = _lines(axis)
        line = Window.partitionBy("frame_id", fixed).orderBy(moving)
        whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

        def tap(c: str, k: int, line=line, whole=whole):
            if k == 0:
                return F.col(c)
            return F.coalesce(F.lag(c, -k).over(line), (F.first(c) if k < 0 else F.last(c)).over(whole))

        df = df.withColumns({c: sum((w * tap(c, k - radius) for k, w in enumerate(kernel)), F.lit(0.0)) for c in columns})
    return df


def max_filter(df: DataFrame, columns: list[str], radius: float) -> DataFrame:
    """Largest value of a square neighbourhood, cut off at the edges."""
    r = math.floor(radius)
    for axis in ("x", "y"):
        fixed, moving = _lines(axis)
        near = Window.partitionBy("frame_id", fixed).orderBy(moving).rowsBetween(-r, r)
        df = df.withColumns({c: F.max(c).over(near) for c in columns})
    return df


def downsample(df: DataFrame, columns: list[str], scale: int) -> DataFrame:
    """Means of scale x scale cells; the last cells may be smaller."""
    y, x = F.floor(F.col("y") / scale).cast("int").alias("y"), F.floor(F.col("x") / scale).cast("int").alias("x")
    size = [F.ceil(F.max(c) / scale).cast("int").alias(c) for c in ("width", "height")]
    return df.groupBy("frame_id", y, x).agg(*[F.avg(c).alias(c) for c in columns], *size)


def upsample(low: DataFrame, grid: DataFrame, columns: list[str], scale: int) -> DataFrame:
    """Bilinear values of low at the pixels of grid: beyond the first centre they are extrapolated, at the far edge repeated.

    Each pixel names its four cells, so this is an equi-join by frame and cell.
    """

    def position(axis: str, size: str):
        f = (F.col(axis) + 0.5) / scale - 0.5
        cells = F.ceil(F.col(size) / scale).cast("int")
        first = F.greatest(F.lit(0), F.floor(f)).cast("int")
        return first, F.least(first + 1, cells - 1), f - first

    y0, y1, ty = position("y", "height")
    x0, x1, tx = position("x", "width")
    corners = F.array(
        F.struct(y0.alias("cy"), x0.alias("cx"), ((1 - ty) * (1 - tx)).alias("w")), F.struct(y0.alias("cy"), x1.alias("cx"), ((1 - ty) * tx).alias("w")),
        F.struct(y1.alias("cy"), x0.alias("cx"), (ty * (1 - tx)).alias("w")), F.struct(y1.alias("cy"), x1.alias("cx"), (ty * tx).alias("w")),
    )
    each = grid.select("frame_id", "y", "x", F.explode(corners).alias("k")).select("frame_id", "y", "x", F.col("k.cy").alias("cy"), F.col("k.cx").alias("cx"), F.col("k.w").alias("w"))
    cells = low.select("frame_id", F.col("y").alias("cy"), F.col("x").alias("cx"), *columns)
    return each.join(cells, ["frame_id", "cy", "cx"]).groupBy("frame_id", "y", "x").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns])


def covering_cells(df: DataFrame, out_width: int, out_height: int) -> DataFrame:
    """Each pixel once for each cell (cy, cx) of a preview grid that covers it; cells overlap where sizes don't divide."""

    def covering(axis: str, size: str, out: int):
        step = F.col(size) / F.lit(float(out))
        first = F.greatest(F.lit(0), F.floor(F.col(axis) / step) - 1).cast("int")
        last = F.least(F.lit(out - 1), F.floor((F.col(axis) + 1) / step) + 1).cast("int")
        return F.filter(F.sequence(first, last), lambda k: (F.floor(k * step) <= F.col(axis)) & (F.ceil((k + 1) * step) > F.col(axis)))

    return df.withColumn("cy", F.explode(covering("y", "height", out_height))).withColumn("cx", F.explode(covering("x", "width", out_width)))


def preview_cells(df: DataFrame, columns: list[str], out_width: int, out_height: int, weight: str | None = None) -> DataFrame:
    """Means over the overlapping cells of a preview grid: each pixel names the cells that cover it, then one aggregate.

    weight: weighted means, 0 where the weights of a cell sum to nothing.
    """
    each = covering_cells(df, out_width, out_height)
    if weight:
        w = F.greatest(F.lit(0.0), F.col(weight))
        means = [F.when(F.sum(w) <= 1e-12, 0.0).otherwise(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in columns]
    else:
        means = [F.avg(c).alias(c) for c in columns]
    return each.groupBy("frame_id", F.col("cy").alias("y"), F.col("cx").alias("x")).agg(*means)


def crop(df: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Pixels of a viewport: a range filter that reaches the scan."""
    return df.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))


def difference(left: DataFrame, right: DataFrame, tolerance: float | None = None) -> DataFrame:
    """frame_id, rms, largest: of all samples of two renderings.

    tolerance: also the first sample, by row, column and channel, that differs by more (y, x, channel; null if there is none).
    """
    j = left.select("frame_id", "y", "x", "r", "g", "b").join(right.selectExpr("frame_id", "y", "x", "r as r2", "g as g2", "b as b2"), ["frame_id", "y", "x"])
    d = [F.abs(F.col(c) - F.col(c + "2")) for c in "rgb"]
    out = [F.sqrt(F.sum(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) / (3 * F.count("*"))).alias("rms"), F.max(F.greatest(*d)).alias("largest")]
    if tolerance is None:
        return j.groupBy("frame_id").agg(*out)
    channel = F.when(d[0] > tolerance, 0).when(d[1] > tolerance, 1).when(d[2] > tolerance, 2)
    first = F.min(F.when(channel.isNotNull(), F.struct("y", "x", channel.alias("channel")))).alias("first")
    return j.groupBy("frame_id").agg(*out, first).select("frame_id", "rms", "largest", "first.y", "first.x", F.element_at(F.array(*map(F.lit, "RGB")), F.col("first.channel") + 1).alias("channel"))


def bands(df: DataFrame, height: int, overlap: int) -> DataFrame:
    """Each row once for each band whose rows, with the overlap, include it; core tells the band's own rows."""
    first = F.greatest(F.lit(0), F.floor((F.col("y") - overlap) / height))
    last = F.least(F.floor((F.col("height") - 1) / height), F.floor((F.col("y") + overlap) / height))
    return df.withColumn("band", F.explode(F.sequence(first.cast("int"), last.cast("int")))).withColumn("core", F.floor(F.col("y") / height) == F.col("band"))
