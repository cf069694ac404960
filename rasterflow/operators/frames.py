"""Large frames as tables of lines (frame_id, y, r, g, b, a as arrays), rendered in bands whose halos stay small.

A wide blur is taken at a reduced size, so it needs the whole frame at that size only. A segment of a graph goes in three
steps: bands give their reduced planes, each plane is put together and blurred in one task and cut for the bands, and bands
finish with those beside their own lines. A band reads neighbours only as far as blurs at full size reach.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterflow.operators.kernels import shrink
from rasterflow.operators.render import run_node
from rasterflow.operators.stencil import bands
from rasterflow.plans.graph import Node, Plan

LINES = "frame_id string, y int, r array<float>, g array<float>, b array<float>, a array<float>"
_PLANES = "frame_id string, name string, band int, scale int, sigma double, width int, plane binary"
_CUTS = "frame_id string, band int, name string, first int, cells int, width int, plane binary"


def to_lines(pixels: DataFrame) -> DataFrame:
    """Pixels as lines: one row for each row of a frame."""
    row = F.array_sort(F.collect_list(F.struct("x", "r", "g", "b", F.coalesce("a", F.lit(1.0)).alias("a"))))
    df = pixels.groupBy("frame_id", "y").agg(row.alias("p"))
    return df.select(F.col("frame_id").cast("string").alias("frame_id"), "y", *[F.col(f"p.{c}").cast("array<float>").alias(c) for c in "rgba"])


def to_pixels(lines: DataFrame) -> DataFrame:
    return lines.select("frame_id", "y", F.posexplode(F.arrays_zip(*"rgba")).alias("x", "p")).select("frame_id", "y", "x", "p.r", "p.g", "p.b", "p.a")


def synthetic_lines(spark: SparkSession, width: int, height: int, frame_id: str = "frame") -> DataFrame:
    """Hash noise with lamps at every 97th pixel of every 61st line."""

    def run(batches):
        for pdf in batches:
            rows = []
            for y in pdf["id"]:
                i = np.arange(y * width, (y + 1) * width, dtype=np.uint64)
                v = ((i * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) >> np.uint64(8)) / float(0xFFFFFF) * 0.05
                lamp = (np.arange(width) % 97 == 48) & (y % 61 == 30)
                rows.append((frame_id, int(y), *(np.where(lamp, top, v * k).astype(np.float32) for top, k in ((2.0, 1.0), (1.5, 0.8), (1.0, 0.6))), np.ones(width, np.float32)))
            yield pd.DataFrame(rows, columns=["frame_id", "y", *"rgba"])

    return spark.range(height).repartition(max(8, height // 128)).mapInPandas(run, LINES)


def _block(pdf: pd.DataFrame) -> dict:
    pdf = pdf.sort_values("y")
    plane = lambda c: np.stack(pdf[c].to_list()).astype(np.float64)
    return {"rgb": np.stack([plane(c) for c in "rgb"]), "a": plane("a"), "y0": int(pdf["y"].iloc[0]), "x0": 0}


class Cuts:
    """Blurred reduced planes of a frame, as far as a band needs them: bilinear, as kernels.grow has it."""

    def __init__(self, planes: pd.DataFrame, y0: int):
        self.y0 = y0
        self.planes = {r.name_: (r.first_, r.cells, np.frombuffer(r.plane, np.float64).reshape(-1, r.width)) for r in planes.rename(columns={"name": "name_", "first": "first_"}).itertuples(index=False)}

    def __call__(self, name: str, scale: int, shape: tuple[int, int]) -> np.ndarray:
        first, cells, low = self.planes[name]

        def place(begin: int, n: int, count: int):
            f = (np.arange(begin, begin + n) + 0.5) / scale - 0.5
            at = np.maximum(0, np.floor(f)).astype(int)
            return at, np.minimum(at + 1, count - 1), f - at

        y0, y1, ty = place(self.y0, shape[0], cells)
        x0, x1, tx = place(0, shape[1], low.shape[1])
        rows = low[y0 - first] * (1 - ty)[:, None] + low[y1 - first] * ty[:, None]
        left = rows[:, x0]
        return left + (rows[:, x1] - left) * tx


def segments(nodes: tuple[Node, ...], ctx: dict) -> list[tuple[list[Node], Node | None, list[Node]]]:
    """Nodes in runs with one wide node each: those before it, it, and those after it that aren't wide."""
    out: list[tuple[list[Node], Node | None, list[Node]]] = [([], None, [])]
    for n in nodes:
        before, wide, after = out[-1]
        if n.effect.near(n.params, ctx) == n.effect.support(n.params, ctx):
            (before if wide is None else after).append(n)
        elif wide is None:
            out[-1] = (before, n, after)
        else:
            out.append(([], n, []))
    return out


def render_lines(lines: DataFrame, plan: Plan, band_rows: int = 512) -> DataFrame:
    """lines through a plan. Bands have band_rows lines of their own; alpha stays."""
    ctx, height = plan.context, plan.rows
    size = max(8, band_rows // 8 * 8)
    for before, node, after in segments(plan.nodes, ctx):
        if not (before or node or after):
            continue
        last = len(plan.nodes) and (after or [node or before[-1]])[-1] is plan.nodes[-1]
        lines = _segment(lines, before, node, after, ctx, height, size)
        lines = lines if last else lines.persist()
    return lines


def _segment(lines: DataFrame, before: list[Node], node: Node | None, after: list[Node], ctx: dict, height: int, size: int) -> DataFrame:
    sized = lines.withColumn("height", F.lit(height))
    early = sum(n.effect.support(n.params, ctx) for n in before)
    near = early + sum(n.effect.support(n.params, ctx) for n in after) + (node.effect.near(node.params, ctx) if node else 0)

    def through(block: dict, nodes: list[Node]) -> dict:
        for n in nodes:
            block = run_node(block, n, ctx)
        return block

    def finished(pdf: pd.DataFrame, cuts: pd.DataFrame | None) -> pd.DataFrame:
        block = through(_block(pdf), before)
        if node:
            block = run_node(block, node, {**ctx, "wide": Cuts(cuts, block["y0"])})
        rgb = through(block, after)["rgb"]
        own = pdf.sort_values("y")
        core = own["core"].to_numpy()
        if not np.isfinite(rgb[:, core]).all():
            raise ValueError("a graph made values that aren't finite")
        own = own[core]
        return pd.DataFrame({"frame_id": own["frame_id"], "y": own["y"], **{c: list(rgb[i][core].astype(np.float32)) for i, c in enumerate("rgb")}, "a": own["a"]})

    banded = bands(sized, size, near)
    if node is None:
        return banded.groupBy("frame_id", "band").applyInPandas(lambda pdf: finished(pdf, None), LINES)

    def planes(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        core = pdf.sort_values("y")["core"].to_numpy()
        block = through(_block(pdf), before)
        rows = [(key[0], name, key[1], scale, sigma, shrink(p[core], scale)) for name, p, sigma, scale in node.effect.wide(block, node.params, ctx)]
        return pd.DataFrame([(*r[:5], r[5].shape[1], r[5].tobytes()) for r in rows], columns=["frame_id", "name", "band", "scale", "sigma", "width", "plane"])

    def blurred(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("band")
        scale, width = int(pdf["scale"].iloc[0]), int(pdf["width"].iloc[0])
        low = np.concatenate([np.frombuffer(p, np.float64).reshape(-1, width) for p in pdf["plane"]])
        low = node.effect.wide_blur(node.params, ctx)(low, float(pdf["sigma"].iloc[0]) / scale)
        rows = []
        for band in pdf["band"]:
            first = max(0, (band * size - near) // scale - 1)
            cut = low[first : (min(height, (band + 1) * size + near)) // scale + 2]
            rows.append((pdf["frame_id"].iloc[0], int(band), pdf["name"].iloc[0], first, len(low), width, np.ascontiguousarray(cut).tobytes()))
        return pd.DataFrame(rows, columns=["frame_id", "band", "name", "first", "cells", "width", "plane"])

    seen = bands(sized, size, early + node.effect.reach(node.params, ctx))
    cuts = seen.groupBy("frame_id", "band").applyInPandas(planes, _PLANES).groupBy("frame_id", "name").applyInPandas(blurred, _CUTS)
    return banded.groupBy("frame_id", "band").cogroup(cuts.groupBy("frame_id", "band")).applyInPandas(lambda pdf, c: finished(pdf, c), LINES)
