"""Transfer functions, primaries and output shaping as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RGB = ("r", "g", "b")
# Matrices from each space to linear sRGB and back, row by row.
TO_SRGB = {
    "sRGB": (1, 0, 0, 0, 1, 0, 0, 0, 1),
    "DisplayP3": (1.22494018, -0.22494018, 0, -0.04205695, 1.04205695, 0, -0.01963755, -0.07863605, 1.0982736),
    "AdobeRGB": (1.398355744, -0.398355744, 0, 0, 1, 0, 0, -0.0429289893, 1.0429289893),
    "ProPhoto": (2.0343675435, -0.7276344742, -0.3067330693, -0.2288267982, 1.2317533962, -0.002926598, -0.0085584243, -0.1532682035, 1.1618266279),
    "Rec2020": (1.6604910021, -0.5876411388, -0.0728498633, -0.1245504745, 1.1328998971, -0.0083494226, -0.0181507634, -0.100578898, 1.1187296614),
}
FROM_SRGB = {
    "sRGB": (1, 0, 0, 0, 1, 0, 0, 0, 1),
    "DisplayP3": (0.82246197, 0.17753803, 0, 0.0331942, 0.9668058, 0, 0.01708263, 0.07239744, 0.91051993),
    "AdobeRGB": (0.7151256069, 0.2848743931, 0, 0, 1, 0, 0, 0.0411619485, 0.9588380515),
    "ProPhoto": (0.529280406, 0.3301529857, 0.1405666083, 0.098366222, 0.8734639545, 0.0281698235, 0.0168753409, 0.1176594143, 0.8654652448),
    "Rec2020": (0.6274038959, 0.3292830384, 0.0433130657, 0.0690972894, 0.9195403951, 0.0113623156, 0.0163914389, 0.0880133079, 0.8955952532),
}
LUMA = {"sRGB": (0.2126, 0.7152, 0.0722), "Rec2020": (0.2627, 0.678, 0.0593), "ProPhoto": (0.28804, 0.711953, 0.000007)}
GAMMA = {"AdobeRGB": 563 / 256, "ProPhoto": 1.8, "Rec2020": 2.4}


def luma(r: Column | str = "r", g: Column | str = "g", b: Column | str = "b", weights: Sequence[float] = LUMA["sRGB"]) -> Column:
    return weights[0] * F.col(r) + weights[1] * F.col(g) + weights[2] * F.col(b) if isinstance(r, str) else weights[0] * r + weights[1] * g + weights[2] * b


def decode(v: Column, trc: str) -> Column:
    """Display value to linear light. Plain powers of negative values are NaN, as in the formula."""
    if trc == "linear":
        return v
    if trc in ("sRGB", "DisplayP3"):
        return F.when(v <= 0, 0.0).when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))
    if trc == "Rec2020":
        return F.when(v <= 0, 0.0).otherwise(F.pow(v, F.lit(GAMMA[trc])))
    if trc in GAMMA:
        return F.pow(v, F.lit(GAMMA[trc]))
    raise ValueError(f"unknown transfer function {trc!r}")


def encode(v: Column, trc: str) -> Column:
    if trc == "linear":
        return v
    if trc in ("sRGB", "DisplayP3"):
        return F.when(v <= 0, 0.0).when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)
    if trc in GAMMA:
        return F.when(v <= 0, 0.0).otherwise(F.pow(v, F.lit(1 / GAMMA[trc])))
    raise ValueError(f"unknown transfer function {trc!r}")


def decode_bt2020(v: Column) -> Column:
    """The camera curve of Rec. 2020, kept beside the display gamma."""
    return F.when(v <= 0, 0.0).when(v < 0.08145, v / 4.5).otherwise(F.pow((v + 0.0993) / 1.0993, F.lit(1 / 0.45)))


def encode_bt2020(v: Column) -> Column:
    return F.when(v <= 0, 0.0).when(v < 0.0181, v * 4.5).otherwise(1.0993 * F.pow(v, F.lit(0.45)) - 0.0993)


def mapped(df: DataFrame, f) -> DataFrame:
    """f over r, g and b in one projection."""
    return df.withColumns({c: f(F.col(c)) for c in RGB})


def apply_matrix(df: DataFrame, m: Sequence[float]) -> DataFrame:
    """A 3x3 matrix over r, g, b: all three read the old values."""
    return df.withColumns({c: m[3 * i] * F.col("r") + m[3 * i + 1] * F.col("g") + m[3 * i + 2] * F.col("b") for i, c in enumerate(RGB)})


def output_knee(v: Column, rolloff: float) -> Column:
    if rolloff <= 0:
        return v
    start = 1 - 0.5 * min(1.0, rolloff)
    span = max(1e-6, 1 - start)
    x = (v - start) / span
    return F.when(v <= start, v).otherwise(start + span * (x / (1 + x)))


NORM = {8: 255, 16: 32768, 32: 1}


def quantise(v: Column, depth: int) -> Column:
    """Integer sample of a display value; 16-bit samples end at 32768, halves go up."""
    if depth == 32:
        return v
    return F.least(F.greatest(F.floor(v * NORM[depth] + 0.5), F.lit(0)), F.lit(NORM[depth])).cast("int")


def white_point(df: DataFrame) -> DataFrame:
    """frame_id, white: the largest visible sample of each frame, 1 at least."""
    return df.where("a > 0").groupBy("frame_id").agg(F.greatest(F.lit(1.0), F.max(F.greatest("r", "g", "b"))).alias("white"))


def tone_map(df: DataFrame) -> DataFrame:
    """Frames mapped into 0..1 by their white points, one scale for a pixel; frames without highlights stay."""
    joined = df.join(white_point(df), "frame_id", "left").withColumn("white", F.coalesce("white", F.lit(1.0)))
    p = F.greatest("r", "g", "b")
    w = F.col("white")
    scale = F.when((w <= 1 + 1e-6) | (p <= 0), 1.0).otherwise((1 + p / (w * w)) / (1 + p))
    return joined.withColumn("_s", scale).withColumns({c: F.col(c) * F.col("_s") for c in RGB}).drop("_s")
