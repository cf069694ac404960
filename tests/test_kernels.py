import json

import numpy as np
import pytest

from rasterflow.functions import rng
from rasterflow.operators import kernels as K
from rasterflow.operators import render
from rasterflow.operators.effects import EFFECTS
from rasterflow.plans import graph
from rasterflow.sources import rasters

CTX = {"width": 129, "height": 129, "quality": "quality", "format": {"gauge": "35mm", "iso": 250}}


def block(h=129, w=129, value=0.1):
    return {"rgb": np.full((3, h, w), value), "a": np.ones((h, w)), "y0": 0, "x0": 0}


def test_frozen_vectors():
    assert rng.fnv1a("grain-main") == 2195196770
    assert rng.hash32(0x12345678, rng.fnv1a("grain-main"), -7, 19, 2, 1, 0) == 0x6F088B72
    got = rng.gaussian_array(0x12345678, rng.fnv1a("grain-main"), np.array([-7]), np.array([19]), 2, 1)
    assert got[0] == np.float32(-0.5085549354553223)


def test_blurs_agree_and_keep_energy():
    p = np.zeros((128, 128))
    p[64, 64] = 1
    for one in (K.box3, K.gaussian, K.recursive_gaussian):
        assert abs(one(p, 7.0).sum() - 1) < 2e-2
    assert np.sqrt(((K.gaussian(p, 7.0) - K.recursive_gaussian(p, 7.0)) ** 2).mean()) < 1e-4
    flat = np.full((20, 31), 0.4)
    assert np.allclose(K.box3(flat, 3), flat) and np.allclose(K.gaussian(flat, 2), flat)


def test_max_filter_and_resampling():
    p = np.random.default_rng(1).random((9, 13))
    want = np.array([[p[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].max() for x in range(13)] for y in range(9)])
    assert (K.max_square(p, 2.7) == want).all()
    assert np.allclose(K.shrink(p, 4)[-1, -1], p[8:, 12:].mean())
    up = K.grow(np.array([[0.0, 1.0]]), 1, 4, 2)[0]
    assert np.allclose(up, [-0.25, 0.25, 0.75, 1.0])


def test_bloom_spreads_light_and_never_darkens():
    b = block()
    b["rgb"][:, 64, 64] = 8
    e = EFFECTS["bloom"]
    out = e.apply(b, e.params({"saveLights": 0}), CTX)
    assert (out["rgb"] >= b["rgb"] - 1e-9).all()
    clear = {**b, "a": np.zeros((129, 129))}
    assert np.allclose(e.apply(clear, e.params({}), CTX)["rgb"], b["rgb"])


def test_protection_needs_a_bloom():
    b = block()
    e = EFFECTS["highlightProtection"]
    assert e.apply(b, e.params({}), CTX) is b


def test_halation_reddens_around_a_lamp():
    b = block(value=0.05)
    b["rgb"][:, 60:66, 60:66] = 2
    e = EFFECTS["halation"]
    for preset in e.presets.values():
        for mode in ("fast", "quality"):
            added = e.apply(b, e.params({**preset, "diffusionMode": mode}), CTX)["rgb"] - b["rgb"]
            ring = added[:, 63, 70]
            assert ring[0] > ring[2] and ring[0] > 0
    off = e.apply(b, e.params({**e.presets["standard"], "threshold": 1, "globalDiffusion": 0}), CTX)
    assert np.allclose(off["rgb"], b["rgb"])


def test_grain_keeps_the_mean_and_does_not_depend_on_bands():
    b, e = block(96, 64, 0.18), EFFECTS["grain"]
    p = e.params({"seedMode": "fixed"})
    whole = e.apply(b, p, CTX)["rgb"]
    assert abs(whole.mean() - 0.18) < 1e-3
    part = e.apply({"rgb": b["rgb"][:, 32:64], "a": b["a"][32:64], "y0": 32, "x0": 0}, p, CTX)["rgb"]
    assert np.allclose(part, whole[:, 32:64])


def test_zero_mask_is_exact():
    b = block(31, 29, 0.18)
    b["rgb"][0, 5, 4] = 3
    mask = {"mode": "luma", "lowEV": 20, "highEV": 30, "softnessEV": 0}
    for kind, e in EFFECTS.items():
        if kind in ("vignette", "damage", "overscan"):
            continue
        params = e.presets["standard"] if kind == "halation" else {}
        node = graph.validate_node({"id": kind, "type": kind, "params": params, "mask": mask})
        assert (render.run_node(b, node, CTX)["rgb"] == b["rgb"]).all()


def test_reserved_nodes_are_refused():
    with pytest.raises(NotImplementedError):
        graph.validate_node({"id": "v", "type": "vignette"})
    with pytest.raises(ValueError):
        graph.validate_node({"id": "x", "type": "nothing"})


def test_documents():
    doc = graph.to_document(graph.default_graph())
    again = graph.parse_document(json.dumps(doc))
    assert graph.stable_json(again) == graph.stable_json(graph.parse_document(json.dumps(again)))
    old = graph.parse_document(json.dumps({"version": 1, "effects": {"halation": {"strength": 10}}}))
    assert [n["type"] for n in old["graph"] if n["enabled"]] == ["halation"]
    with pytest.raises(ValueError):
        graph.parse_document('{"schemaVersion": 9}')
    good, bad = graph.unbundle(graph.bundle([doc, {"schemaVersion": 2, "graph": []}], "here", "2024-01-01T00:00:00Z"))
    assert len(good) == 1 and bad[0][0] == 1


def test_bands_equal_whole_frames(spark):
    df = rasters.synthetic(spark, 64, 160)
    nodes = [graph.validate_node({"id": k, "type": k}) for k in ("defringe", "filmResolution", "grain")]
    whole = graph.plan(nodes, 64, 160)
    parts = graph.plan(nodes, 64, 160, band_pixels=64 * 64)
    assert whole.band_height == 160 and parts.band_height == 64
    a = {(r.y, r.x): r for r in render.render(df, whole).collect()}
    b = {(r.y, r.x): r for r in render.render(df, parts).collect()}
    assert len(a) == len(b) == 64 * 160
    assert max(abs(a[k].r - b[k].r) + abs(a[k].b - b[k].b) for k in a) < 1e-6


def test_empty_plan_and_png(spark):
    df = rasters.synthetic(spark, 8, 4)
    assert render.render(df, graph.plan([], 8, 4)).count() == 32
    assert rasters.png(2, 1, np.full((1, 2, 4), 255, np.uint8))[:8] == b"\x89PNG\r\n\x1a\n"
    t = rasters.blue_noise_tile()
    assert abs(t.mean()) < 1e-12 and t.max() < 0.5


def test_stream(spark, tmp_path):
    from rasterflow.streaming.frames import render_stream

    rasters.synthetic(spark, 8, 4).write.parquet(str(tmp_path / "in"))
    pixels = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    plan = graph.plan([graph.validate_node({"id": "g", "type": "grain"})], 8, 4)
    render_stream(pixels, plan, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 32
