"""Rasters out of tables, synthetic frames, and sinks: quantised samples with blue noise, and PNG files."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterflow.functions.rng import M32, multiply
from rasterflow.functions.colour import NORM


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `ev` raster: 100 pixels wide, one per event; bright values over 1, and transparent pixels."""
    e = table(spark, sf_dir, "events").select(F.lit("ev").alias("frame_id"), F.col("event_id").cast("long").alias("i"), F.col("user_id").cast("long").alias("u"), "event_type", "value")
    r = F.col("value") / 50.0
    size = e.groupBy("frame_id").agg((F.floor(F.max("i") / 100) + 1).cast("int").alias("height"))
    return e.join(size, "frame_id").select(
        "frame_id", F.floor(F.col("i") / 100).cast("int").alias("y"), F.pmod("i", F.lit(100)).cast("int").alias("x"),
        r.alias("r"), (r * (0.6 + 0.04 * F.pmod("i", F.lit(11)))).alias("g"), (r * (0.3 + 0.05 * F.pmod("u", F.lit(13)))).alias("b"),
        F.when(F.col("event_type") == "error", 0.0).when(F.col("event_type") == "signup", 0.5).otherwise(1.0).alias("a"),
        F.lit(100).alias("width"), "height",
    )


def orders_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `od` raster: 150 pixels wide, display-like values."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("i"), (F.col("o_totalprice").cast("double") / 500000.0).alias("v"))
    return o.select(F.lit("od").alias("frame_id"), F.floor(F.col("i") / 150).cast("int").alias("y"), F.pmod("i", F.lit(150)).cast("int").alias("x"), F.col("v").alias("r"), (F.col("v") * 0.8).alias("g"), (F.col("v") * 0.55).alias("b"), F.lit(1.0).alias("a"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered samples out of lineitem, for pointwise work."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice").cast("double") / 105000.0).alias("r"), (F.col("l_discount").cast("double") * 10 + 0.0).alias("g"), (F.col("l_tax").cast("double") * 12.5 + 0.0).alias("b"))


def synthetic(spark: SparkSession, width: int, height: int, frame_id: str = "frame") -> DataFrame:
    """Hash noise with lamps at every 97th pixel of every 61st row."""
    i = F.col("id")
    v = F.shiftrightunsigned(multiply(i.bitwiseAND(F.lit(M32)), 2654435761), 8) / float(0xFFFFFF) * 0.05
    y, x = F.floor(i / width).cast("int"), F.pmod(i, F.lit(width)).cast("int")
    lamp = (F.pmod(x, F.lit(97)) == 48) & (F.pmod(y, F.lit(61)) == 30)
    return spark.range(width * height).select(F.lit(frame_id).alias("frame_id"), y.alias("y"), x.alias("x"), F.when(lamp, 2.0).otherwise(v).alias("r"), F.when(lamp, 1.5).otherwise(v * 0.8).alias("g"), F.when(lamp, 1.0).otherwise(v * 0.6).alias("b"), F.lit(1.0).alias("a"), F.lit(width).alias("width"), F.lit(height).alias("height"))


def component_size(value) -> int:
    """8, 16 or 32 of a depth as hosts name it."""
    known = {"8": 8, "bitdepth8": 8, "eight": 8, "16": 16, "bitdepth16": 16, "sixteen": 16, "32": 32, "bitdepth32": 32, "thirtytwo": 32}
    if (key := str(value).strip().lower()) not in known:
        raise ValueError(f"unsupported component size {value!r}")
    return known[key]


def read_samples(stored: DataFrame, depth, raw: bool = False) -> DataFrame:
    """Stored samples as numbers from 0 to 1 (32 bits as they are), alpha apart and 1 where there is none; raw: as stored."""
    norm = float(NORM[component_size(depth)])
    if raw:
        return stored
    df = stored if "a" in stored.columns else stored.withColumn("a", F.lit(None).cast("double"))
    return df.withColumns({c: F.col(c) / norm for c in "rgb"} | {"a": F.coalesce(F.col("a") / norm, F.lit(1.0))})


def read_reduced(stored: DataFrame, depth, size: tuple[int, int], overview: DataFrame | None = None) -> DataFrame:
    """A picture of about `size`: an overview that is within a pixel of it, else the means of the stored samples' cells."""
    from rasterflow.operators.stencil import preview_cells

    if overview is not None:
        have = overview.agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).first()
        if have["w"] is not None and abs(have["w"] - size[0]) <= 1 and abs(have["h"] - size[1]) <= 1:
            return read_samples(overview, depth)
    return preview_cells(read_samples(stored, depth), ["r", "g", "b", "a"], *size)


def write_document(samples: DataFrame, path: str) -> None:
    """Integer samples under path, one folder a frame; a frame's folder is replaced in one commit and others stay."""
    samples.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("frame_id").parquet(path)


def sample_frames(spark: SparkSession, size: int = 256) -> DataFrame:
    """Four small display-encoded scenes: lamps at night, a sun, a window, a portrait."""
    y, x = F.floor(F.col("id") / size).cast("int").alias("y"), F.pmod("id", F.lit(size)).cast("int").alias("x")
    df = spark.range(size * size).select(y, x)
    x, y = F.col("x"), F.col("y")
    at = lambda px, py: F.sqrt((x - px) * (x - px) + (y - py) * (y - py))
    oval = lambda px, py, a, b: ((x - px) / a) * ((x - px) / a) + ((y - py) / b) * ((y - py) / b)
    night = [8 + y * 0.04, 10 + y * 0.04, 18 + y * 0.06]
    for px, py, colour in ((70, 130, (1.0, 0.85, 0.6)), (150, 90, (0.95, 0.8, 0.55)), (200, 170, (0.9, 0.75, 0.5))):
        d = at(px, py)
        night = [F.when(d < 4, 255 * k).when(d < 22, F.greatest(v, 255 * k * (1 - d / 22) * 0.9)).otherwise(v) for v, k in zip(night, colour, strict=True)]
    d, t = at(170, 80), y / size
    sky = [90 + t * 60, 120 + t * 60, 190 + t * 20]
    near = 1 - (d - 26) / 14
    sun = [F.when(d < 26, float(top)).when(d < 40, F.greatest(v, top * near + v * (1 - near))).otherwise(v) for v, top in zip(sky, (255, 250, 235), strict=True)]
    pane, frame = x.between(100, 156) & y.between(70, 140), x.between(96, 160) & y.between(66, 144)
    window = [F.when(pane, float(a)).when(frame, float(b)).otherwise(float(c)) for a, b, c in zip((240, 250, 255), (150, 160, 175), (22, 24, 30), strict=True)]
    head, body, side = oval(128, 100, 42, 52) <= 1, oval(128, 190, 78, 34) <= 1, F.greatest(F.lit(0.0), 1 - at(30, 90) / 160)
    skin = [F.least(F.lit(255.0), 190 + side * 40), F.least(F.lit(255.0), 160 + side * 20), F.lit(140.0)]
    portrait = [F.when(head, k).when(body, float(b)).otherwise(float(c)) for k, b, c in zip(skin, (60, 50, 52), (14, 16, 22), strict=True)]
    scenes = {"night": night, "sun": sun, "window": window, "portrait": portrait}
    each = F.array(*[F.struct(F.lit(n).alias("frame_id"), *[(v / 255.0).alias(c) for c, v in zip("rgb", s, strict=True)]) for n, s in scenes.items()])
    return df.select("y", "x", F.explode(each).alias("s")).select("s.frame_id", "y", "x", "s.r", "s.g", "s.b", F.lit(1.0).alias("a"), F.lit(size).alias("width"), F.lit(size).alias("height"))


def _noise(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    v = (x.astype(np.uint32) + np.uint32(0x51ED270B)) * np.uint32(0x85EBCA6B) ^ (y.astype(np.uint32) + np.uint32(0x68BC21EB)) * np.uint32(0xC2B2AE35)
    v = (v ^ (v >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return (v ^ (v >> np.uint32(15))) / 2.0**32


@lru_cache(maxsize=1)
def blue_noise_tile() -> np.ndarray:
    """64 x 64 ranks in -0.5 .. 0.5 of hash noise less its neighbours' mean."""
    y, x = np.mgrid[0:64, 0:64]
    around = sum(_noise((x + dx) & 63, (y + dy) & 63) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy)
    score = (_noise(x, y) - around / 8).ravel()
    tile = np.empty(4096)
    tile[np.argsort(score, kind="stable")] = (np.arange(4096) + 0.5) / 4096 - 0.5
    return tile.reshape(64, 64)


def quantised(df: DataFrame, depth: int, dither: bool = True, seed: int = 0x46534C4D) -> DataFrame:
    """Integer samples; up to 16 bits with blue noise of half a step, turned and shifted per channel. Alpha gets none.

    The tile is a constant of 4096 values in the plan: one projection, no join.
    """
    norm = NORM[depth]
    if depth == 32:
        return df
    tile = F.lit(blue_noise_tile().ravel()) if dither else None
    out = {}
    for k, c in enumerate("rgb"):
        v = F.col(c) * norm
        if dither:
            sx, sy = (seed ^ (k + 1) * 0x9E3779B1) & 63, (seed >> 8 ^ (k + 3) * 0x85EBCA6B) & 63
            tx = F.col("y") if k == 1 else F.col("x") + F.col("y") if k == 2 else F.col("x")
            ty = -F.col("x") if k == 1 else F.col("y") - F.col("x") if k == 2 else F.col("y")
            v = v + F.element_at(tile, (F.pmod(ty + sy, F.lit(64)) * 64 + F.pmod(tx + sx, F.lit(64)) + 1).cast("int"))
        out[c] = F.least(F.greatest(F.floor(v + 0.5), F.lit(0)), F.lit(norm)).cast("int")
    return df.withColumns(out | {"a": F.floor(F.coalesce("a", F.lit(1.0)) * norm + 0.5).cast("int")})


def png(width: int, height: int, rgba: np.ndarray) -> bytes:
    """An 8-bit PNG of (h, w, 4) samples; without alpha where all of it is opaque."""
    rgba = rgba[..., :3] if (rgba[..., 3] == 255).all() else rgba
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(rgba, np.uint8))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if rgba.shape[2] == 3 else 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 0)) + chunk(b"IEND", b"")


def png_frames(samples8: DataFrame) -> DataFrame:
    """frame_id, png, data_url of 8-bit frames; one frame per task, as a file is one."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        grid = np.zeros((h, w, 4), np.uint8)
        grid[pdf["y"], pdf["x"]] = pdf[["r", "g", "b", "a"]].to_numpy()
        return pd.DataFrame({"frame_id": [str(pdf["frame_id"].iloc[0])], "png": [png(w, h, grid)]})

    out = samples8.groupBy("frame_id").applyInPandas(one, "frame_id string, png binary")
    return out.withColumn("data_url", F.concat(F.lit("data:image/png;base64,"), F.base64("png")))
