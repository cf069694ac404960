"""Previews: sizes and viewports on the driver, reduced fields as one aggregate, transfers between renderings as joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflow.functions import colour
from rasterflow.functions.profiles import Profile
from rasterflow.operators.stencil import covering_cells, gaussian_blur, preview_cells

MAX_EDGE = 1024
ENERGY = ("w", "gate", "luma", "source_r", "source_g", "source_b")


def preview_scale(width: int, height: int, edge: int = MAX_EDGE) -> float:
    return min(1.0, edge / max(width, height))


def half_up(v: float) -> int:
    return math.floor(v + 0.5)


def visible_bounds(outer: dict, centre: dict, viewport: dict) -> dict:
    """Whole pixels of a viewport around a centre (the middle, where none is given), moved to lie within outer."""
    low = {"x": math.ceil(outer["left"]), "y": math.ceil(outer["top"])}
    high = {"x": math.floor(outer["right"]), "y": math.floor(outer["bottom"])}
    if not (high["x"] > low["x"] and high["y"] > low["y"]):
        raise ValueError("bounds without an area")
    out = {}
    for axis, size, names in (("x", "width", ("left", "right")), ("y", "height", ("top", "bottom"))):
        n = min(high[axis] - low[axis], max(1, math.floor(viewport.get(size) or 1)))
        at = centre.get(axis)
        at = (low[axis] + high[axis]) / 2 if at is None or not math.isfinite(at) else at
        begin = max(low[axis], min(high[axis] - n, half_up(at - n / 2)))
        out |= {names[0]: begin, names[1]: begin + n, size: n, f"centre_{axis}": begin + n / 2}
    return out


def read_bounds(visible: dict, outer: dict, padding: float) -> dict:
    """A viewport with the graph's support around it, as far as there are pixels."""
    pad = max(0, math.ceil(padding))
    return {
        "left": max(math.ceil(outer["left"]), visible["left"] - pad), "top": max(math.ceil(outer["top"]), visible["top"] - pad),
        "right": min(math.floor(outer["right"]), visible["right"] + pad), "bottom": min(math.floor(outer["bottom"]), visible["bottom"] + pad),
    }


def reduced_fields(fields: DataFrame, out_width: int, out_height: int) -> DataFrame:
    """Extracted fields over preview cells: energies as means, exposure u weighted by w (over the plain sum of w), growth k as the most."""
    each = covering_cells(fields, out_width, out_height)
    total = F.sum("w")
    u = F.when(total > 1e-12, F.sum(F.col("u") * F.greatest(F.lit(0.0), F.col("w"))) / total).otherwise(0.0)
    return each.groupBy("frame_id", F.col("cy").alias("y"), F.col("cx").alias("x")).agg(
        *[F.avg(c).alias(c) for c in ENERGY], u.alias("u"), F.greatest(F.lit(0.0), F.max("k")).alias("k")
    )


def placeholder(pixels: DataFrame, width: int, height: int, edge: int = 40, sigma: float = 2.4) -> DataFrame:
    """A tiny, heavily blurred picture: cells of at most `edge`, Gaussian of 1 to 4 cells; alpha is only reduced."""
    scale = min(1.0, max(16, edge) / max(width, height))
    out_width, out_height = max(1, half_up(width * scale)), max(1, half_up(height * scale))
    small = preview_cells(pixels, ["r", "g", "b", "a"], out_width, out_height) if scale < 1 else pixels.select("frame_id", "y", "x", "r", "g", "b", "a")
    return gaussian_blur(small, ["r", "g", "b"], min(4.0, max(1.0, sigma)))


def _joined(display: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    at = ["frame_id", "y", "x"]
    named = lambda df, p: df.select(*at, *[F.col(c).alias(f"{p}_{c}") for c in "rgb"])
    return display.join(named(before, "b"), at).join(named(after, "f"), at)


def transfer_gain(display: DataFrame, before: DataFrame, after: DataFrame, share: float = 1.0) -> DataFrame:
    """What an effect multiplies samples by, applied to the display's; samples that were 0 stay."""

    def moved(c: str) -> Column:
        d, b = F.col(c), F.col(f"b_{c}")
        return F.when(b == 0, d).otherwise(d + share * (d * (F.col(f"f_{c}") / F.when(b == 0, 1.0).otherwise(b)) - d))

    return _joined(display, before, after).select(*[moved(c).alias(c) if c in "rgb" else F.col(c) for c in display.columns])


def transfer_delta(display: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """What an effect adds to samples, added to the display's."""
    return _joined(display, before, after).select(*[(F.col(c) + (F.col(f"f_{c}") - F.col(f"b_{c}"))).alias(c) if c in "rgb" else F.col(c) for c in display.columns])


def panel_preview(pixels: DataFrame, profile: Profile, depth: int) -> DataFrame:
    """Samples of any profile as display sRGB; only frames of 32 bits are tone-mapped. Alpha and other columns stay."""
    df = colour.mapped(pixels, lambda v: colour.decode(v, profile.transfer))
    df = colour.apply_matrix(df, colour.TO_SRGB[profile.base]) if profile.base != "sRGB" else df
    df = colour.tone_map(df).drop("white") if depth == 32 else df
    return colour.mapped(df, lambda v: colour.encode(v, "sRGB"))


def slider_unit(position: Column, curve: str = "linear", exponent: float = 2.2) -> Column:
    """A slider's place as a share of its range, with more track near one end."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), position))
    return F.pow(t, F.lit(exponent)) if curve == "fine-min" else 1 - F.pow(1 - t, F.lit(exponent)) if curve == "fine-max" else t


def slider_position(unit: Column, curve: str = "linear", exponent: float = 2.2) -> Column:
    u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), unit))
    return F.pow(u, F.lit(1 / exponent)) if curve == "fine-min" else 1 - F.pow(1 - u, F.lit(1 / exponent)) if curve == "fine-max" else u
