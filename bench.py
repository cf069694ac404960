"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from rasterflow import registry
from rasterflow.operators import frames
from rasterflow.plans import graph

NAMES = (
    "frame_statistics", "colour_srgb_decode", "density_composite", "box_blur3", "max_filter", "downsample_4", "upsample_bilinear", "defringe_fast",
    "halation_fast", "bloom_fast", "full_graph_fast", "full_graph_quality",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    jobs = {n: (lambda n=n: sink(registry.QUERIES[n](spark, sf_dir))) for n in NAMES}

    def frame24(kinds):
        """The like-for-like frame: 6000 x 4000 lines through a graph of quality `quality`, in bands."""
        nodes = [graph.validate_node({"id": f"{k}-main", "type": k, "params": p}) for k, p in kinds.items()]
        sink(frames.render_lines(frames.synthetic_lines(spark, 6000, 4000), graph.plan(nodes, 6000, 4000, quality="quality")))

    if os.environ.get("BENCH_24MP", "1") == "1":
        light = {"halation": graph.EFFECTS["halation"].presets["standard"]}
        jobs["halation_fast_24mp"] = lambda: frame24(light)
        jobs["full_graph_24mp"] = lambda: frame24({"defringe": {}, **light, "bloom": {}, "highlightProtection": {}, "filmResolution": {}, "grain": {"seedMode": "fixed"}})
    times = {}
    for name, job in jobs.items():
        runs = []
        for _ in range(1 if name.endswith("24mp") else 2):
            began = time.time()
            job()
            runs.append(time.time() - began)
        times[name] = round(min(runs), 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf[1]) if sf else None}))


if __name__ == "__main__":
    main()
