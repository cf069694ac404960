"""Whole graphs over pixel tables: one task renders one halo-padded band of one frame, and returns the band's own rows."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterflow.operators.effects import EFFECTS
from rasterflow.operators.kernels import smoothstep
from rasterflow.operators.stencil import bands
from rasterflow.plans.graph import Node, Plan

PIXELS = "frame_id string, y int, x int, r double, g double, b double, a double"


def luma_mask(rgb: np.ndarray, m: dict) -> np.ndarray:
    y = 0.2126 * rgb[0] + 0.7152 * rgb[1] + 0.0722 * rgb[2]
    ev = np.log2(np.maximum(2.0**-24, y) / 0.18)
    s = m["softnessEV"]
    out = smoothstep(m["lowEV"] - s, m["lowEV"], ev) * (1 - smoothstep(m["highEV"], m["highEV"] + s, ev))
    return (1 - out if m["invert"] else out).clip(0, 1)


def run_node(block: dict, node: Node, ctx: dict) -> dict:
    """One node; a mask reads the node's input, and of a bloom scales only what it adds."""
    out = node.effect.apply(block, node.params, {**ctx, "nodeId": node.id})
    if not node.mask:
        return out
    m = luma_mask(block["rgb"], node.mask)
    if node.type == "bloom":
        glow = out["bloom_glow"] * m
        return {**out, "rgb": np.where(m == 0, block["rgb"], block["rgb"] + glow), "bloom_glow": glow}
    return {**out, "rgb": np.where(m == 0, block["rgb"], block["rgb"] + (out["rgb"] - block["rgb"]) * m)}


def run_block(block: dict, plan: Plan) -> dict:
    return functools.reduce(lambda b, n: run_node(b, n, plan.context), plan.nodes, block)


def render(pixels: DataFrame, plan: Plan) -> DataFrame:
    """pixels (frame_id, y, x, r, g, b, a) through a plan; missing alpha is 1, missing pixels of a block are 0. Alpha stays."""
    height = plan.rows
    if not plan.nodes:
        return pixels.selectExpr("cast(frame_id as string) as frame_id", "y", "x", "r", "g", "b", "a")
    df = pixels.select("frame_id", "y", "x", "r", "g", "b", "a", F.lit(height).alias("height"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf["y"].min()), int(pdf["x"].min())
        h, w = int(pdf["y"].max()) - y0 + 1, int(pdf["x"].max()) - x0 + 1
        at = (pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0)
        rgb, a = np.zeros((3, h, w)), np.ones((h, w))
        for i, c in enumerate("rgb"):
            rgb[i][at] = pdf[c]
        a[at] = pdf["a"].fillna(1.0)
        out = run_block({"rgb": rgb, "a": a, "y0": y0, "x0": x0}, plan)["rgb"]
        if not np.isfinite(out).all():
            raise ValueError("a graph made values that aren't finite")
        got = pd.DataFrame({"frame_id": pdf["frame_id"].astype(str), "y": pdf["y"], "x": pdf["x"], **{c: out[i][at] for i, c in enumerate("rgb")}, "a": pdf["a"]})
        return got[pdf["core"]]

    return bands(df, plan.band_height, plan.halo).groupBy("frame_id", "band").applyInPandas(one, PIXELS)


def extracted(pixels: DataFrame, params: dict, sigma: float) -> DataFrame:
    """frame_id, y, x, u and s0, s1, s2: exposure and layers of the light-scattering node's source, without its growth. No halo is needed."""
    effect = EFFECTS["halation"]

    def run(batches):
        for pdf in batches:
            block = {"rgb": pdf[["r", "g", "b"]].to_numpy(float).T[:, None, :], "a": pdf["a"].fillna(1.0).to_numpy(float)[None, :]}
            f = effect.extract(block, {**params, "sourceExpansion": 0}, sigma)
            yield pd.DataFrame({"frame_id": pdf["frame_id"].astype(str), "y": pdf["y"], "x": pdf["x"], "u": f["U"][0], **{f"s{i}": s[0] for i, s in enumerate(f["src"])}})

    return pixels.select("frame_id", "y", "x", "r", "g", "b", "a").mapInPandas(run, "frame_id string, y int, x int, u double, s0 double, s1 double, s2 double")


def render_encoded(pixels: DataFrame, plan: Plan, profile: str | None, rolloff: float = 0.0) -> DataFrame:
    """Display-encoded pixels to linear light and sRGB primaries, through the graph, and back."""
    from rasterflow.functions import colour, profiles

    known = profiles.resolve(profile)
    df = colour.mapped(pixels, lambda v: colour.decode(v, known.transfer))
    df = colour.apply_matrix(df, colour.TO_SRGB[known.base]) if known.base != "sRGB" else df
    df = render(df, plan)
    df = colour.apply_matrix(df, colour.FROM_SRGB[known.base]) if known.base != "sRGB" else df
    return colour.mapped(colour.mapped(df, lambda v: colour.encode(v, known.transfer)), lambda v: colour.output_knee(v, rolloff))
