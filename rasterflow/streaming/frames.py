"""Frames that arrive over time: an addition of this engine. Each micro-batch goes through one plan and is written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rasterflow.operators.render import render
from rasterflow.plans.graph import Plan


def render_stream(pixels: DataFrame, plan: Plan, out_dir: str, checkpoint_dir: str) -> StreamingQuery:
    """A frame has to arrive within one batch. A batch that is repeated overwrites its own folder."""

    def batch(df: DataFrame, number: int) -> None:
        render(df, plan).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    return pixels.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
