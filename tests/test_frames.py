"""Large frames in bands against whole frames, and the semantic traps of the effects."""

import numpy as np
import pandas as pd
import pytest

from rasterflow.functions import profiles
from rasterflow.operators import frames, kernels, render
from rasterflow.operators.effects import EFFECTS
from rasterflow.plans import graph
from rasterflow.sources import documents, rasters

ALL = {"defringe": {}, "halation": EFFECTS["halation"].presets["tungsten-800"], "bloom": {}, "highlightProtection": {}, "filmResolution": {}, "grain": {"seedMode": "fixed"}}


def scene(w, h):
    rgb = np.random.default_rng(1).random((3, h, w)) * 0.05
    rgb[:, 30::61, 48::97] = np.array([2, 1.5, 1])[:, None, None]
    return rgb.astype(np.float32).astype(float)


def nodes_of(kinds):
    return sorted((graph.validate_node({"id": f"{k}-main", "type": k, "params": p}) for k, p in kinds.items()), key=lambda n: n.effect.stage)


def run(rgb, kinds, a=None, **options):
    _, h, w = rgb.shape
    block = {"rgb": rgb, "a": np.ones((h, w)) if a is None else a, "y0": 0, "x0": 0}
    return render.run_block(block, graph.plan(nodes_of(kinds), w, h, **options))["rgb"]


@pytest.mark.parametrize("kinds", [{"halation": EFFECTS["halation"].presets["standard"]}, ALL])
def test_bands_of_lines_equal_the_whole_frame(spark, kinds):
    w, h = 420, 320
    rgb = scene(w, h)
    lines = spark.createDataFrame(pd.DataFrame([("f", y, *(rgb[c, y].tolist() for c in range(3)), [1.0] * w) for y in range(h)], columns=["frame_id", "y", *"rgba"]), frames.LINES).repartition(3)
    plan = graph.plan(nodes_of(kinds), w, h, frame=(1600, 1200))
    want = render.run_block({"rgb": rgb, "a": np.ones((h, w)), "y0": 0, "x0": 0}, plan)["rgb"]
    got = frames.render_lines(lines, plan, 64).orderBy("y").toPandas()
    got = np.stack([np.stack(got[c].to_list()) for c in "rgb"])
    assert got.shape == want.shape and np.abs(got - want).max() < 1e-6
    pixels = frames.to_pixels(lines)
    back = frames.to_lines(pixels).orderBy("y").toPandas()
    assert np.array_equal(np.stack(back["r"].to_list()), rgb[0].astype(np.float32))


def test_a_frame_of_any_height_has_several_bands():
    plan = graph.plan(nodes_of({"halation": EFFECTS["halation"].presets["standard"]}), 6000, 4000)
    assert plan.band_height < 4000


def test_maximum_against_plain():
    p = np.random.default_rng(2).random((23, 31))
    for r in (1, 2, 7, 40):
        want = np.array([[p[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].max() for x in range(31)] for y in range(23)])
        assert np.array_equal(kernels.max_square(p, r), want)


def test_fast_graphs_force_fast_grain_but_not_the_halation():
    rgb = scene(120, 80)
    grain = {"grain": {"seedMode": "fixed", "size": 2}}
    options = {"frame": (6000, 4000), "fmt": {"gauge": "8mm"}}
    assert np.array_equal(run(rgb, grain, quality="fast", **options), run(rgb, {"grain": {**grain["grain"], "mode": "fast"}}, **options))
    assert not np.array_equal(run(rgb, grain, quality="fast", **options), run(rgb, grain, **options))
    quality = {"halation": {"strength": 50, "diffusionMode": "quality"}}
    slow = run(rgb, quality, quality="fast")
    assert np.array_equal(slow, run(rgb, quality))
    assert not np.array_equal(slow, run(rgb, quality, force_fast=True))
    assert np.array_equal(run(rgb, quality, force_fast=True), run(rgb, {"halation": {"strength": 50}}))


def test_transparent_pixels_never_emit():
    rgb = np.full((3, 21, 21), 0.05)
    rgb[:, 10, 10] = 12
    a = np.ones((21, 21))
    a[10, 10] = 0
    for kinds in ({"halation": {"strength": 60}}, {"bloom": {}}):
        out = run(rgb, kinds, a, frame=(2000, 2000))
        assert np.allclose(out[:, 10, 11], rgb[:, 10, 11], atol=1e-9)


def test_thresholds_at_their_end_switch_all_sources_off():
    rgb = scene(90, 60) * 8
    assert np.allclose(run(rgb, {"halation": {"strength": 60, "threshold": 1.0, "globalDiffusion": 0}}), rgb)
    assert np.allclose(run(rgb, {"halation": {"strength": 60, "threshold": 4, "thresholdUnits": "stops", "globalDiffusion": 0}}), rgb)


def test_zero_masks_leave_every_node_exactly_as_it_was():
    rgb = np.full((3, 9, 11), 0.18)
    rgb[0, 4, 5] = 3
    mask = {"mode": "luma", "lowEV": 20, "highEV": 21, "softnessEV": 1}
    for kind, params in ALL.items():
        if kind == "highlightProtection":
            continue
        node = graph.validate_node({"id": "n", "type": kind, "params": params, "mask": mask})
        out = render.run_block({"rgb": rgb, "a": np.ones((9, 11)), "y0": 0, "x0": 0}, graph.plan([node], 11, 9))
        assert np.array_equal(out["rgb"], rgb), kind


def test_protection_rebuilds_from_what_the_bloom_had():
    rgb = scene(60, 40) * 4
    rebuilt = run(rgb, {"bloom": {}, "highlightProtection": {"amount": 0}}, frame=(2000, 2000))
    assert np.allclose(rebuilt, run(rgb, {"bloom": {}}, frame=(2000, 2000)))
    assert np.array_equal(run(rgb, {"highlightProtection": {}}), rgb)


def test_first_cells_are_extrapolated_and_last_repeated():
    up = kernels.grow(np.array([[0.0, 4.0]]), 1, 4, 2)
    assert up[0].tolist() == [-1.0, 1.0, 3.0, 4.0]


def test_profiles():
    assert profiles.resolve("AdobeRGB1998").base == "AdobeRGB" and profiles.resolve("p3").base == profiles.resolve("Display-P3").base == "DisplayP3"
    assert profiles.resolve("my 2020") == ("sRGB", "sRGB", True) and profiles.resolve("Rec. 2020 (Linear)") == ("linear", "Rec2020", False)
    assert profiles.resolve("", "ProPhoto RGB", depth=32) == ("linear", "ProPhoto", False)
    offered = ["ITU-R BT.2020 (Linear)", "Rec 2020 gamma", "Adobe RGB (1998)"]
    assert profiles.match(offered, "Rec2020") == "Rec 2020 gamma" and profiles.match(offered[:1], "Rec2020") == offered[0]
    assert profiles.match(offered, "AdobeRGB") == "Adobe RGB (1998)" and profiles.match(offered, "ProPhoto") is None


def test_store_imports_once(spark, tmp_path):
    store = documents.DocumentStore(spark, f"file://{tmp_path}/store")
    rows = lambda *r: spark.createDataFrame(list(r), "key string, document string")
    none = spark.createDataFrame([], "key string")
    assert store.documents().count() == 0
    store.save(rows(("a", "1"), ("b", "1")))
    bundle = rows(("a", "2"), ("b", "2"), ("c", "2"))
    assert store.take(bundle, rows(("b", "")).select("key"), 7) == {"crc32": 7, "imported": 2, "overwritten": 1, "preserved": 1}
    assert store.take(bundle, none, 7) is None
    assert {r.key: r.document for r in store.documents().collect()} == {"a": "1", "b": "2", "c": "2"}
    store.remove(rows(("a", "")).select("key"))
    assert {r.key for r in store.documents().collect()} == {"b", "c"}


def test_documents_of_samples_are_replaced_frame_by_frame(spark, tmp_path):
    at = f"file://{tmp_path}/frames"
    frame = lambda n, v: spark.createDataFrame([(n, 0, x, v, v, v, 255) for x in range(4)], "frame_id string, y int, x int, r int, g int, b int, a int")
    rasters.write_document(frame("one", 10).union(frame("two", 20)), at)
    rasters.write_document(frame("two", 30), at)
    got = rasters.read_samples(spark.read.parquet(at), "bitDepth8").groupBy("frame_id").agg({"r": "max"}).collect()
    assert {r[0]: round(r[1] * 255) for r in got} == {"one": 10, "two": 30}
    small = rasters.read_reduced(frame("one", 51).selectExpr("*", "4 as width", "1 as height"), 8, (2, 1)).collect()
    assert len(small) == 2 and abs(small[0]["r"] - 0.2) < 1e-9
    with pytest.raises(ValueError):
        rasters.component_size("float")


def test_graph_changes_keep_other_nodes():
    now = [{"type": "halation", "params": {"strength": 1}}, {"type": "grain", "params": {}}]
    stale = [{"type": "halation", "params": {"strength": 0}}, {"type": "grain", "params": {"amount": 2}}]
    assert graph.merge_change(now, stale, "grain") == [now[0], stale[1]]
    assert graph.merge_change(now, [{"type": "bloom"}], "bloom")[-1] == {"type": "bloom"} and graph.merge_change(now, [], "bloom") is now
