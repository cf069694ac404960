"""Effect graphs and documents: validated, upgraded and pruned on the driver before any job starts."""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass, field

from rasterflow.functions.rng import fnv1a
from rasterflow.operators.effects import EFFECTS, Effect, film_format

SCHEMA = 2
MASK_DEFAULTS = {"mode": "none", "lowEV": -8, "highEV": 8, "softnessEV": 1, "invert": False}


@dataclass(frozen=True)
class Node:
    id: str
    type: str
    enabled: bool = True
    params: dict = field(default_factory=dict)
    mask: dict | None = None

    @property
    def effect(self) -> Effect:
        return EFFECTS[self.type]


def validate_mask(mask: dict | None) -> dict | None:
    if not mask or mask.get("mode", "none") == "none":
        return None
    if unknown := set(mask) - set(MASK_DEFAULTS):
        raise ValueError(f"unknown mask keys: {sorted(unknown)}")
    out = {**MASK_DEFAULTS, **mask}
    if out["mode"] != "luma" or out["lowEV"] > out["highEV"] or out["softnessEV"] < 0:
        raise ValueError("mask must be a luma mask with lowEV <= highEV and softnessEV >= 0")
    return out


def validate_node(raw: dict) -> Node:
    kind = raw.get("type")
    if kind not in EFFECTS:
        raise ValueError(f"unknown effect {kind!r}")
    if not isinstance(raw.get("id"), str) or not raw["id"]:
        raise ValueError("a node needs an id")
    return Node(raw["id"], kind, bool(raw.get("enabled", True)), EFFECTS[kind].params(raw.get("params")), validate_mask(raw.get("mask")))


def normalize(nodes: list[dict], need_halation: bool = True) -> list[Node]:
    """Validated nodes in the fixed order of stages; ids are unique, and there is one light-scattering node unless opted out."""
    out = [validate_node(n) for n in nodes]
    if len({n.id for n in out}) != len(out):
        raise ValueError("node ids must be unique")
    if need_halation and sum(n.type == "halation" for n in out) != 1:
        raise ValueError("a graph needs exactly one halation node")
    return sorted(out, key=lambda n: n.effect.stage)


def default_graph() -> list[Node]:
    kinds = ("defringe", "halation", "bloom", "highlightProtection", "filmResolution", "grain")
    return [validate_node({"id": f"{k}-main", "type": k, "enabled": k == "halation"}) for k in kinds]


def minimum_version(nodes: list[Node]) -> str:
    kinds = {n.type for n in nodes if n.enabled}
    if kinds & {"defringe", "bloom", "highlightProtection"} or any(n.mask for n in nodes):
        return "1.7.0"
    return "1.6.0" if kinds & {"filmResolution", "grain"} else "1.5.1"


@dataclass(frozen=True)
class Plan:
    """Nodes that change something, the rows of the pixels, and the rows that a band needs above and below its own."""

    nodes: tuple[Node, ...]
    context: dict
    rows: int
    halo: int
    band_height: int

    @property
    def key(self) -> str:
        return digest({"nodes": [[n.id, n.type, n.params, n.mask] for n in self.nodes], "context": self.context, "rows": self.rows, "band": self.band_height})


def plan(
    nodes: list[Node], width: int, height: int, *, fmt: dict | None = None, quality: str = "quality", preview_scale: float = 1,
    band_pixels: int = 4_000_000, frame: tuple[int, int] | None = None, force_fast: bool = False,
) -> Plan:
    """Disabled and neutral nodes go; supports add up from the sinks; bands are as high as band_pixels allows, and as their halo.

    frame: width and height of the whole frame, where the pixels are a crop of it: sizes in frame units follow it.
    """
    full = frame or (width, height)
    ctx = {"width": full[0], "height": full[1], "format": film_format(fmt), "quality": quality, "previewScale": preview_scale, "forceFast": force_fast}
    live = tuple(n for n in nodes if n.enabled and not n.effect.identity(n.params))
    # bands begin at multiples of the coarsest scale, so reduced planes have the same cells in every band
    halo = -(-sum(n.effect.support(n.params, ctx) for n in live) // 8) * 8
    rows = max(8, band_pixels // max(1, width) // 8 * 8, halo)
    return Plan(live, ctx, height, halo, min(height, rows))


def merge_change(current: list[dict], proposed: list[dict], kind: str) -> list[dict]:
    """The current graph with the proposed node of one kind: other nodes of a stale proposal don't come along."""
    node = next((n for n in proposed if n["type"] == kind), None)
    if node is None:
        return current
    out = [node if n["type"] == kind else n for n in current]
    return out if any(n["type"] == kind for n in current) else [*out, node]


def memory_bytes(width: int, height: int, depth: int = 16) -> int:
    """What a frame takes as a whole, from above."""
    return width * height * {8: 132, 16: 136, 32: 152}[depth]


def stable_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value) -> str:
    return f"{fnv1a(stable_json(value)):08x}"


def to_document(nodes: list[Node], fmt: dict | None = None, bindings: dict | None = None, fingerprint: dict | None = None) -> dict:
    graph = [{"id": n.id, "type": n.type, "enabled": n.enabled, "params": {k: list(v) if isinstance(v, tuple) else v for k, v in n.params.items()}, "mask": n.mask or MASK_DEFAULTS} for n in nodes]
    return {"schemaVersion": SCHEMA, "minimumEngineVersion": minimum_version(nodes), "format": film_format(fmt), "graph": graph, "bindings": bindings or {}, "documentFingerprint": fingerprint}


def parse_document(text: str) -> dict:
    """A document of schema 1 or 2 as one of schema 2, with the nodes that later versions added, disabled."""
    doc = json.loads(text.removeprefix("﻿"))
    version = doc.get("schemaVersion", 1)
    if not isinstance(version, int) or version > SCHEMA:
        raise ValueError(f"schema {version!r} is newer than {SCHEMA}")
    if version < 2:
        params = (doc.get("effects") or {}).get("halation") or doc.get("params") or {}
        doc = {**doc, "schemaVersion": 2, "graph": [{"id": "halation-main", "type": "halation", "enabled": True, "params": params}]}
    nodes = normalize(doc["graph"])
    have = {n.type for n in nodes}
    nodes += [n for n in (validate_node({"id": x.id, "type": x.type, "enabled": False}) for x in default_graph()) if n.type not in have]
    return to_document(sorted(nodes, key=lambda n: n.effect.stage), doc.get("format"), doc.get("bindings"), doc.get("documentFingerprint"))


def load(doc: dict) -> list[Node]:
    return normalize(doc["graph"])


MAX_BUNDLE_BYTES, MAX_BUNDLE_DOCS = 10 << 20, 10_000


def bundle(documents: list[dict], source: str, exported_at: str) -> str:
    if len(documents) > MAX_BUNDLE_DOCS:
        raise ValueError("too many documents")
    return json.dumps({"kind": "documents", "bundleVersion": 1, "source": source, "exportedAt": exported_at, "documents": documents, "crc32": zlib.crc32(stable_json(documents).encode())})


def unbundle(text: str) -> tuple[list[dict], list[tuple[int, str]]]:
    """Valid documents, and (place, reason) of the others; a wrong checksum refuses the whole."""
    if len(text.encode()) > MAX_BUNDLE_BYTES:
        raise ValueError("bundle too large")
    raw = json.loads(text)
    if raw.get("kind") != "documents" or zlib.crc32(stable_json(raw["documents"]).encode()) != raw["crc32"]:
        raise ValueError("bundle is damaged")
    good, bad = [], []
    for i, doc in enumerate(raw["documents"]):
        try:
            good.append(parse_document(json.dumps(doc)))
        except (ValueError, NotImplementedError, KeyError) as e:
            bad.append((i, str(e)))
    return good, bad
