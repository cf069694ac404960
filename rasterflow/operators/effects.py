"""The six effects of the graph over NumPy planes: each has defaults, ranges, an identity test, a support and apply.

A block is a dict: rgb (3, h, w), a (h, w), y0 and x0 (position in the frame) and what earlier nodes leave for later ones.
"""

from __future__ import annotations

import math

import numpy as np

from rasterflow.functions.gates import BLUE_RESPONSE, GREEN_RESPONSE, RED_RESPONSE, halation_threshold, threshold_linear
from rasterflow.functions.rng import fnv1a, gaussian_array
from rasterflow.operators import kernels as K
from rasterflow.operators.stencil import box_radius, gaussian_kernel

ss = K.smoothstep
#: Half the width over which a source goes from one class to the next.
CLASS_SOFTNESS = 0.25
# Width of the exposed frame in millimetres by gauge.
APERTURE_MM = {"8mm": 5.79, "16mm": 12.52, "35mm": 24.89, "65mm": 52.15}


def film_format(value: dict | None) -> dict:
    value = value or {}
    iso = value.get("iso")
    ok = isinstance(iso, (int, float)) and not isinstance(iso, bool) and 0 < iso <= 12800
    return {"gauge": value.get("gauge") if value.get("gauge") in APERTURE_MM else "35mm", "iso": iso if ok else 250}


def pixels_per_mm(fmt: dict, full_width: float) -> float:
    return full_width / APERTURE_MM[fmt["gauge"]]


def luma(rgb: np.ndarray) -> np.ndarray:
    return 0.2126 * rgb[0] + 0.7152 * rgb[1] + 0.0722 * rgb[2]


class Effect:
    """A node's kind. Defaults, ranges and choices are fixed values: documents mean the same with them everywhere."""

    type = ""
    stage = 0
    defaults: dict = {}
    ranges: dict = {}
    choices: dict = {}

    def params(self, given: dict | None) -> dict:
        p = {**self.defaults, **(given or {})}
        for key, (low, high) in self.ranges.items():
            v = p[key]
            if not isinstance(v, (int, float)) or isinstance(v, bool) or not math.isfinite(v) or not low <= v <= high:
                raise ValueError(f"{self.type}: {key} must be finite and in [{low}, {high}]")
        for key, allowed in self.choices.items():
            if p[key] not in allowed:
                raise ValueError(f"{self.type}: {key} must be one of {allowed}")
        return p

    def identity(self, p: dict) -> bool:
        return p.get("amount", 1) == 0

    def support(self, p: dict, ctx: dict) -> int:
        return 0

    def near(self, p: dict, ctx: dict) -> int:
        """The support without blurs that are taken of the whole frame at reduced sizes."""
        return self.support(p, ctx)

    def reach(self, p: dict, ctx: dict) -> int:
        """The support of what is blurred at reduced sizes."""
        return 0

    def wide(self, block: dict, p: dict, ctx: dict) -> list[tuple[str, np.ndarray, float, int]]:
        """(name, plane, sigma, scale) of the blurs at reduced sizes."""
        return []

    def wide_blur(self, p: dict, ctx: dict):
        """What blurs a reduced plane by a sigma."""
        raise NotImplementedError

    def apply(self, block: dict, p: dict, ctx: dict) -> dict:
        raise NotImplementedError(f"effect {self.type!r} is declared but not implemented")


class Defringe(Effect):
    type, stage = "defringe", 10
    defaults = {"amount": 0.65, "radiusPx": 1.5, "threshold": 0.08, "softness": 0.12, "edgeSensitivity": 1}
    ranges = {"amount": (0, 1), "radiusPx": (0.5, 4), "threshold": (0, 1), "softness": (0.01, 0.5), "edgeSensitivity": (0, 2)}

    def identity(self, p):
        return p["amount"] == 0 or p["edgeSensitivity"] == 0

    def support(self, p, ctx):
        return math.ceil(5 * p["radiusPx"])

    def apply(self, block, p, ctx):
        r, g, b = block["rgb"]
        radius = max(0.05, p["radiusPx"] * ctx.get("previewScale", 1))
        one = K.box3 if ctx.get("quality") == "fast" else K.gaussian
        y, cg, co = (r + 2 * g + b) / 4, (-r + 2 * g - b) / 4, (r - b) / 2
        yb, cb = one(y, radius), one(cg, radius)
        es = p["edgeSensitivity"]
        mix = p["amount"] * ss(0.01 / es, 0.08 / es, abs(y - yb)) * ss(p["threshold"], p["threshold"] + p["softness"], abs(cg - cb)) * block["a"].clip(0, 1)
        cg = cg + (cb - cg) * mix
        return {**block, "rgb": np.stack([y - cg + co, y + cg, y - cg - co])}


class Halation(Effect):
    type, stage = "halation", 30
    defaults = {
        "strength": 0, "sigma": 7, "sigmaUnits": "pixels", "threshold": 0.7, "thresholdUnits": "linear", "sourceSoftness": 0.05, "backgroundSoftness": 0.08,
        "smoothness": 0.15, "backgroundThreshold": 0.3, "sourceImpact": 0.65, "amplify": 1, "sourceExpansion": 0, "redTail": 0, "blueCompensation": 0,
        "colorDensity": 0, "sourceInteriorProtection": 0, "hotSourceThreshold": 0.1, "hotCoreStrength": 0.75, "globalSourceThreshold": 0.75,
        "spectralSensitivity": 0, "redLayerThresholdBias": 0, "redshift": (1, 0.12, 0.02), "sigmaRatio": (1, 0.55, 0.35), "globalDiffusion": 0.03,
        "centerAttenuation": 0.4, "blendMode": "additive", "diffusionMode": "fast", "extraction": "threshold", "spillMix": 0.5, "rolloff": 0, "profile": "standard",
    }
    ranges = {
        "strength": (0, 100), "sigma": (1e-9, 1e9), "threshold": (-8, 8), "sourceSoftness": (0, 1), "backgroundSoftness": (0, 1), "smoothness": (0, 1), "backgroundThreshold": (-8, 8),
        "sourceImpact": (0, 1), "amplify": (0, 4), "sourceExpansion": (0, 1), "redTail": (0, 1), "blueCompensation": (0, 1), "colorDensity": (0, 1),
        "sourceInteriorProtection": (0, 1), "hotSourceThreshold": (0, 4), "hotCoreStrength": (0, 1), "globalSourceThreshold": (0, 4), "spectralSensitivity": (0, 1),
        "redLayerThresholdBias": (0, 1), "globalDiffusion": (0, 1e9), "centerAttenuation": (0, 1), "spillMix": (0, 1), "rolloff": (0, 1),
    }
    choices = {"blendMode": ("additive", "screen"), "diffusionMode": ("quality", "fast"), "extraction": ("threshold", "spill"), "sigmaUnits": ("pixels", "diagonal"), "thresholdUnits": ("linear", "stops")}
    # The two built-in presets, as changes to the defaults.
    presets = {
        "standard": {
            "strength": 68, "sigma": 3.6, "sigmaUnits": "diagonal", "threshold": 0.74, "sourceSoftness": 0.04, "backgroundSoftness": 0.10, "smoothness": 0.14, "backgroundThreshold": 0.36,
            "sourceImpact": 0.88, "amplify": 1.65, "sourceExpansion": 0.16, "redTail": 0.28, "blueCompensation": 0.35, "colorDensity": 0.045, "sourceInteriorProtection": 1,
            "hotSourceThreshold": 0.42, "hotCoreStrength": 0.62, "globalSourceThreshold": 1.05, "spectralSensitivity": 1, "redshift": (1.08, 0.10, 0.01), "sigmaRatio": (1.05, 0.50, 0.28),
            "globalDiffusion": 0.008, "centerAttenuation": 0.45, "extraction": "spill", "spillMix": 0.55,
        },
        "tungsten-800": {
            "strength": 82, "sigma": 5.2, "sigmaUnits": "diagonal", "threshold": 0.86, "sourceSoftness": 0.03, "backgroundSoftness": 0.24, "smoothness": 0.14, "backgroundThreshold": 0.48,
            "sourceImpact": 1, "amplify": 2.2, "sourceExpansion": 0.85, "redTail": 0.80, "blueCompensation": 0.90, "colorDensity": 0.68, "sourceInteriorProtection": 0,
            "hotSourceThreshold": 0.45, "hotCoreStrength": 0.90, "globalSourceThreshold": 0.78, "spectralSensitivity": 1, "redshift": (1.25, 0.12, 0), "sigmaRatio": (1.15, 0.42, 0.18),
            "globalDiffusion": 0.05, "centerAttenuation": 0.35, "extraction": "spill", "spillMix": 0.7, "profile": "tungsten-800",
        },
    }

    def params(self, given):
        given = dict(given or {})
        if given.pop("sourceThresholdMode", None) == "red-layer":
            given.setdefault("redLayerThresholdBias", 1)
        if "thresholdSoftness" in given:
            soft = given.pop("thresholdSoftness")
            given = {"sourceSoftness": soft, "backgroundSoftness": soft, **given}
        p = super().params(given)
        for key in ("redshift", "sigmaRatio"):
            if len(p[key]) != 3 or not all(math.isfinite(v) for v in p[key]):
                raise ValueError(f"halation: {key} must be three finite numbers")
        return p

    def identity(self, p):
        return p["strength"] == 0

    def sigma(self, p, ctx):
        s = p["sigma"] / 1000 * math.hypot(ctx["width"], ctx["height"]) if p["sigmaUnits"] == "diagonal" else p["sigma"]
        return s * ctx.get("previewScale", 1)

    def support(self, p, ctx):
        s = self.sigma(p, ctx)
        tail = max(r for r, _ in K.lobes(p, True)) * max(p["sigmaRatio"])
        broad = max(12, 4 * s) if p["globalDiffusion"] > 0 else 0
        grown = math.ceil(max(0.5, s) * 1.3) if p["sourceExpansion"] > 0 else 0
        return math.ceil(5 * max(s * tail, broad)) + grown + 16

    def grown(self, p, ctx):
        return math.ceil(max(0.5, self.sigma(p, ctx)) * 1.3) + 1 if p["sourceExpansion"] > 0 else 0

    def fast(self, p, ctx):
        # a graph's quality leaves the node's own diffusion as it is; only a request for speed overrides it
        return {**p, "diffusionMode": "fast"} if ctx.get("forceFast") else p

    def sizes(self, p, ctx):
        """(name, sigma, scale) of all blurs."""
        p = self.fast(p, ctx)
        sigma, quality = self.sigma(p, ctx), p["diffusionMode"] == "quality"
        out = [(f"s{i}{k}", s, scale) for i, ratio in enumerate(p["sigmaRatio"]) for k, (s, _, scale) in enumerate(K.lobe_sizes(sigma * ratio, p, i == 0))]
        if p["sourceInteriorProtection"] > 0:
            context = max(2, sigma * 1.25)
            out += [("envelope", max(0.5, sigma * 0.7), 1), ("around", context, K.lobe_scale(context, quality))]
        if p["globalDiffusion"] > 0:
            broad = max(12, sigma * 4)
            out.append(("glow", broad, K.lobe_scale(broad, quality)))
        return out

    def near(self, p, ctx):
        return math.ceil(5 * max((s for _, s, scale in self.sizes(p, ctx) if scale == 1), default=0)) + self.grown(p, ctx) + 8

    def reach(self, p, ctx):
        return self.grown(p, ctx)

    def wide(self, block, p, ctx):
        p = self.fast(p, ctx)
        f = self.extract(block, p, self.sigma(p, ctx))
        plane = lambda n: f["Y"] if n == "around" else self.broad(f, p) if n == "glow" else f["src"][int(n[1])]
        return [(n, plane(n), s, scale) for n, s, scale in self.sizes(p, ctx) if scale > 1]

    def wide_blur(self, p, ctx):
        quality = self.fast(p, ctx)["diffusionMode"] == "quality"
        return lambda q, s: K.blur(q, s, quality)

    @staticmethod
    def broad(f, p):
        return (0.88 * f["src"][0] + 0.12 * f["src"][1]) * ss(p["globalSourceThreshold"] - CLASS_SOFTNESS, p["globalSourceThreshold"] + CLASS_SOFTNESS, f["U"])

    @staticmethod
    def layers(r, g, b):
        """Saturation and the three layers' responses to a colour's hue."""
        r, g, b = (np.maximum(0, c) for c in (r, g, b))
        top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
        delta = top - low
        neutral = (top <= 1e-12) | (delta <= 1e-12)
        d = np.where(neutral, 1, delta)
        h = np.where(top == r, ((g - b) / d + 6) % 6, np.where(top == g, (b - r) / d + 2, (r - g) / d + 4))
        i = np.floor(h).astype(int) % 6
        t = h - np.floor(h)
        t = t * t * (3 - 2 * t)
        pick = lambda table: np.where(neutral, 1, np.take(table, i) + (np.take(table, (i + 1) % 6) - np.take(table, i)) * t)
        return np.where(neutral, 0, delta / np.where(neutral, 1, top)), pick(RED_RESPONSE), pick(GREEN_RESPONSE), pick(BLUE_RESPONSE)

    def extract(self, block, p, sigma):
        r, g, b = block["rgb"]
        a = block["a"].clip(0, 1)
        y, m = luma(block["rgb"]), np.maximum(np.maximum(r, g), b)
        spill = p["spillMix"] if p["extraction"] == "spill" else 0
        t = halation_threshold(p["threshold"], p["thresholdUnits"])
        t = 1e30 if t is None else t
        bt = threshold_linear(p["backgroundThreshold"], p["thresholdUnits"])
        t0, t1, bias, hot = t - p["sourceSoftness"] / 2, t + p["sourceSoftness"] / 2, p["redLayerThresholdBias"], p["hotSourceThreshold"]
        pos = [np.maximum(0, c) for c in (r, g, b)]
        saturation, red, green, blue = self.layers(*pos)
        mix = ss(0, 1, p["spectralSensitivity"]) * ss(0.35, 0.80, saturation) if p["spectralSensitivity"] > 0 else np.zeros_like(y)
        gains = [1 + mix * (x - 1) for x in (red, green, blue)]
        confidence = 1 + mix * (red.clip(0, 1) - 1)

        def exposure(e):
            safe = np.maximum(e, 1e-12)
            got = np.where(e <= 1, (e - t) / max(1e-6, 1 - t), 1 + np.log2(safe)) if t < 1 else np.maximum(0, np.log2(safe / max(t, 1e-6)))
            return np.where(e <= t, 0, got)

        def response(u):
            raw = np.maximum(0, u) ** (1 + 1.5 * p["sourceImpact"])
            return 8 * raw / (7 + raw)

        def path(e, mask, trust):
            u = exposure(e)
            amplitude = mask * a * trust * response(u)
            u = u * trust
            hotness = ss(hot - CLASS_SOFTNESS, hot + CLASS_SOFTNESS, u)
            norm = np.where(e > 1e-8, amplitude / np.maximum(e, 1e-8), 0)
            exposures = [np.maximum(0, k[0] * pos[0] + k[1] * pos[1] + k[2] * pos[2]) for k in ((0.82, 0.16, 0.02), (0.08, 0.74, 0.03), (0.01, 0.03, 0.06))]
            src = [x * norm * gain for x, gain in zip(exposures, gains, strict=True)]
            src[1] = src[1] * (0.12 + 0.88 * hotness)
            return np.stack([u, amplitude, *src])

        e = np.maximum(0, y * (1 - spill) + m * spill)
        mask = ss(t0, t1, y) * (1 - spill) + ss(t0, t1, m) * spill
        fields = path(e, mask, 1.0)
        er = np.maximum(0, 0.82 * r + 0.16 * g + 0.02 * b)
        if bias > 0:
            fields = fields + (path(er, ss(t0, t1, er), confidence) - fields) * bias
        u, w, *src = fields
        back = 1 - ss(bt - p["backgroundSoftness"], bt, np.clip(0.82 * r + 0.18 * g, 0, 1))
        peak = np.maximum(np.maximum(pos[0], pos[1]), pos[2])
        cool = np.where(peak > 1e-8, np.maximum(0, pos[2] - pos[0]) / np.maximum(peak, 1e-8), 0)
        gate = back + (1 - back) * cool * p["blueCompensation"]
        k, x = None, p["sourceExpansion"]
        if x > 0:
            support = K.max_square(np.clip(src[0] * ss(hot - CLASS_SOFTNESS, hot + CLASS_SOFTNESS, u), 0, 1), max(1, math.ceil(max(0.5, sigma) * (0.45 + 0.85 * x))))
            low = max(0, t * (1 - 0.68 * x))
            end = max(low + max(0.02, p["sourceSoftness"] * 2), t)
            candidate = ss(low, end, e) * a
            if bias > 0:
                candidate = candidate + (ss(low, end, er) * confidence * a - candidate) * bias
            allowed = candidate * support * (confidence if p["sourceInteriorProtection"] > 0 else 1)
            grown = allowed * x * 0.42
            w = np.maximum(w, grown)
            src[0], src[1] = np.maximum(src[0], grown), np.maximum(src[1], grown * (0.12 + 0.12 * support))
            k = allowed if p["sourceInteriorProtection"] > 0 else None
        amp = p["amplify"]
        src = [s * f for s, f in zip(src, (amp, amp if amp <= 1 else 1 + (amp - 1) * 0.55, amp if amp <= 1 else 1 + (amp - 1) * 0.15), strict=True)]
        return {"Y": y, "G": gate, "U": u, "W": w * amp, "K": k, "src": src}

    def halo(self, block, f, p, sigma, wide=None):
        quality = p["diffusionMode"] == "quality"
        one = lambda q, s: K.blur(q, s, quality)
        src, u = f["src"], f["U"]
        spread = [K.psf(s, sigma * ratio, p, i == 0, wide, f"s{i}") * shift for i, (s, ratio, shift) in enumerate(zip(src, p["sigmaRatio"], p["redshift"], strict=True))]
        hot = ss(p["hotSourceThreshold"] - CLASS_SOFTNESS, p["hotSourceThreshold"] + CLASS_SOFTNESS, u)
        attenuation = p["centerAttenuation"] * (1 - hot + hot * (1 - p["hotCoreStrength"]) ** 3)
        legacy = [np.maximum(0, d - attenuation * s) for d, s in zip(spread, src, strict=True)]
        relief = np.maximum(hot, 1 - np.exp(-48 * legacy[0])) * p["hotCoreStrength"]
        protect, density, potential = p["sourceInteriorProtection"], None, legacy
        if protect > 0:
            envelope = one(src[0], max(0.5, sigma * 0.7))
            context = max(2, sigma * 1.25)
            around = K.scaled(f["Y"], context, K.lobe_scale(context, quality), one, wide, "around")
            if p["colorDensity"] > 0:
                density = 1 - protect * ss(0.015, 0.08, np.maximum(src[0], envelope) / max(1, p["amplify"]))
            ratio = np.where(src[0] > 1e-8, np.minimum(1, envelope / np.maximum(src[0], 1e-8)), 1)
            compact = np.maximum(hot * (1 - ss(0.22, 0.72, ratio)), f["K"].clip(0, 1) if f["K"] is not None else 0)
            free = compact * (1 - ss(0.32, 0.62, around))
            held = protect * (1 - free * (1 - ss(0.04, 0.42, u)))
            edge = [np.maximum(0, d - shift * s) for d, s, shift in zip(spread, src, p["redshift"], strict=True)]
            potential = [x * (1 - held) + z * held for x, z in zip(legacy, edge, strict=True)]
            surface = ss(0.45, 0.72, f["Y"]) * ss(0.38, 0.68, around)
            edge_relief = (1 - np.exp(-48 * edge[0])) * p["hotCoreStrength"] * (1 - surface)
            gated = protect * (1 - free)
            relief = relief * (1 - gated) + edge_relief * gated
        gate = f["G"] + (1 - f["G"]) * relief
        if protect > 0 and p["spectralSensitivity"] > 0:
            pos = [np.maximum(0, c) for c in block["rgb"]]
            saturation, red, _, _ = self.layers(*pos)
            emitter = (1 - ss(0.02, 0.25, red.clip(0, 1))) * ss(0.28, 0.72, np.maximum(np.maximum(pos[0], pos[1]), pos[2]))
            gate = gate * (1 - ss(0.35, 0.80, saturation) * emitter * ss(0, 1, p["spectralSensitivity"]))
        out = [x * gate for x in potential]
        if p["globalDiffusion"] > 0:
            broad = max(12, sigma * 4)
            scale = K.lobe_scale(broad, quality)
            glow = K.scaled(f["Y"] if wide and scale > 1 else self.broad(f, p), broad, scale, one, wide, "glow")
            y = np.maximum(0, f["Y"])
            value = (1 - np.exp(-np.maximum(0, glow) * 0.75)) / 0.75 * p["globalDiffusion"] * ss(0.03, 0.3, y) * (1 - ss(0.75, 1.8, y))
            out = [o + value * k for o, k in zip(out, (1, 0.12, 0.025), strict=True)]
        return out, density

    def apply(self, block, p, ctx):
        p = self.fast(p, ctx)
        sigma = self.sigma(p, ctx)
        f = self.extract(block, p, sigma)
        halo, gate = self.halo(block, f, p, sigma, ctx.get("wide"))
        rgb, alpha = block["rgb"], p["strength"] / 100 * 2
        gain = [np.where(c <= 0, 1, np.where(c < 1, 1 - c, 1 / np.maximum(1, c))) if p["blendMode"] == "screen" else 1 for c in rgb]
        e = [g * np.maximum(0, h) * alpha for g, h in zip(gain, halo, strict=True)]
        density = p["colorDensity"] * (gate if gate is not None else 1)
        excess = np.maximum(0, e[0] - np.maximum(e[1], e[2]))
        peak = np.maximum(1e-8, rgb.max(0))
        cool = np.clip((np.maximum(rgb[1], rgb[2]) - rgb[0]) / peak, 0, 1)
        y = np.maximum(0, luma(rgb))
        mask = np.minimum(0.78, density * (1 - np.exp(-6 * excess * (1 + 1.6 * p["blueCompensation"] * cool))) * (1 - 0.86 * ss(0, 1, (y - 0.70) / 0.35)))
        safe = np.maximum(e[0], 1e-8)
        gr, br = np.clip(e[1] / safe, 0.12, 0.38), np.clip(e[2] / safe, 0.035, 0.12)
        tr = np.minimum(y / np.maximum(1e-8, 0.2126 + 0.7152 * gr + 0.0722 * br), y * 2.4 + 0.05)
        mixed = np.stack([c + (to - c) * mask for c, to in zip(rgb, (tr, tr * gr, tr * br), strict=True)])
        lift = np.maximum(0, y - luma(mixed))
        plain = (density <= 0) | (e[0] <= 1e-12) | (excess <= 1e-12)
        return {**block, "rgb": np.where(plain, rgb, mixed + lift) + np.stack(e)}


class Bloom(Effect):
    type, stage = "bloom", 40
    defaults = {"thresholdEV": 2, "softnessEV": 1, "radius": 0.7, "amplify": 0.55, "saturation": 0.85, "saveLights": 0.45}
    ranges = {"thresholdEV": (-2, 8), "softnessEV": (0.1, 4), "radius": (0.05, 5), "amplify": (0, 4), "saturation": (0, 1.5), "saveLights": (0, 1)}
    lobes = (("core", 0.22, 0.62), ("mid", 0.75, 0.28), ("tail", 2.4, 0.10))

    def identity(self, p):
        return p["amplify"] == 0

    def radius(self, p, ctx):
        return p["radius"] * 0.01 * math.hypot(ctx["width"], ctx["height"]) * ctx.get("previewScale", 1)

    def support(self, p, ctx):
        return math.ceil(5 * 2.4 * self.radius(p, ctx)) + 16

    def sizes(self, p, ctx):
        radius = self.radius(p, ctx)
        return [(name, weight, max(0.05, radius * ratio), K.bloom_scale(max(0.05, radius * ratio), name)) for name, ratio, weight in self.lobes]

    def near(self, p, ctx):
        return math.ceil(5 * max((s for _, _, s, scale in self.sizes(p, ctx) if scale == 1), default=0)) + 8

    def source(self, block, p):
        t = 0.18 * 2 ** p["thresholdEV"]
        gate = ss(t, t * 2 ** p["softnessEV"], block["rgb"].max(0))
        src = np.maximum(0, block["rgb"]) * gate * block["a"].clip(0, 1)
        y = luma(src)
        return gate, np.maximum(0, y + (src - y) * p["saturation"])

    def wide(self, block, p, ctx):
        _, src = self.source(block, p)
        return [(f"{name}{i}", c, s, scale) for name, _, s, scale in self.sizes(p, ctx) if scale > 1 for i, c in enumerate(src)]

    def wide_blur(self, p, ctx):
        return K.bloom_one(ctx.get("quality") != "fast")

    def apply(self, block, p, ctx):
        rgb, quality = block["rgb"], ctx.get("quality") != "fast"
        gate, src = self.source(block, p)
        glow = np.stack([sum(w * K.bloom_blur(c, s, name, quality, ctx.get("wide"), f"{name}{i}") for name, w, s, _ in self.sizes(p, ctx)) for i, c in enumerate(src)])
        glow = glow * p["amplify"] * (1 - p["saveLights"] * gate)
        return {**block, "rgb": rgb + glow, "bloom_base": rgb, "bloom_glow": glow}


class HighlightProtection(Effect):
    type, stage = "highlightProtection", 50
    defaults = {"amount": 0.5, "thresholdEV": 2.5, "softnessEV": 1}
    ranges = {"amount": (0, 1), "thresholdEV": (0, 8), "softnessEV": (0.01, 8)}

    def apply(self, block, p, ctx):
        if "bloom_base" not in block:
            return block
        base, t = block["bloom_base"], 0.18 * 2 ** p["thresholdEV"]
        keep = 1 - p["amount"] * ss(t, t * 2 ** p["softnessEV"], base.max(0))
        out = {k: v for k, v in block.items() if k not in ("bloom_base", "bloom_glow")}
        return {**out, "rgb": base + block["bloom_glow"] * keep}


class FilmResolution(Effect):
    type, stage = "filmResolution", 60
    defaults = {"amount": 1, "response": 1, "toeLoss": 0.25, "shoulderLoss": 0.15, "profile": "negative"}
    ranges = {"amount": (0, 1.5), "response": (0.5, 2), "toeLoss": (0, 1), "shoulderLoss": (0, 1)}
    choices = {"profile": ("negative", "positive")}

    def sigma(self, p, ctx):
        fmt = film_format(ctx.get("format"))
        f50 = (42 if p["profile"] == "positive" else 56) * min(1.25, max(0.75, (250 / fmt["iso"]) ** 0.10)) * p["response"]
        cycles = min(120, max(12, f50)) / pixels_per_mm(fmt, ctx["width"])
        return math.sqrt(math.log(2)) / (math.sqrt(2) * math.pi * max(cycles, 1e-4)) * ctx.get("previewScale", 1)

    def support(self, p, ctx):
        s = self.sigma(p, ctx)
        return 0 if s < 0.15 else math.ceil(3 * s * 2.2) + 3

    def weights(self, rgb, p):
        """How far a pixel goes to its blur: more in deep shadows and in bright lights."""
        ev = np.log2(np.maximum(1e-6, luma(rgb)) / 0.18)
        toe, shoulder = 1 - ss(-6, -2, ev), ss(2, 6, ev)
        return np.clip(p["amount"] * (1 + p["toeLoss"] * toe + p["shoulderLoss"] * shoulder), 0, 1.5)

    def apply(self, block, p, ctx):
        s = self.sigma(p, ctx)
        if s < 0.15:
            return block
        one = K.box3 if ctx.get("quality") == "fast" else K.gaussian
        rgb, w = block["rgb"], self.weights(block["rgb"], p)
        near, wide = (np.stack([one(c, s * k) for c in rgb]) for k in (1, 2.2))
        return {**block, "rgb": np.where(w <= 1, rgb + w * (near - rgb), (2 - w) * near + (w - 1) * wide)}


class Grain(Effect):
    type, stage = "grain", 70
    defaults = {"amount": 1, "size": 1, "roughness": 0.55, "chroma": 0.18, "profile": "negative", "mode": "analogue", "seedMode": "randomOnCreate", "seed": 0x4F1BBCDC}
    ranges = {"amount": (0, 2), "size": (0.5, 2), "roughness": (0, 1), "chroma": (0, 1), "seed": (0, 0xFFFFFFFF)}
    choices = {"profile": ("negative", "positive"), "mode": ("analogue", "fast"), "seedMode": ("fixed", "randomOnCreate")}

    def scales(self, p, ctx):
        """(weight, sigma) of the grain sizes."""
        fmt, scale = film_format(ctx.get("format")), ctx.get("previewScale", 1)
        size = 7.5 * min(2.2, max(0.65, (fmt["iso"] / 250) ** 0.28)) * p["size"] * pixels_per_mm(fmt, ctx["width"]) / 1000 * scale
        fine, mid, coarse = 0.295 + 0.3 * p["roughness"], 0.38, 0.325 - 0.3 * p["roughness"]
        s = [k * size / 2.35482 for k in (0.65, 1.35, 2.8)]
        if p["mode"] == "fast":
            return [(fine + mid, math.sqrt((fine * s[0] ** 2 + mid * s[1] ** 2) / (fine + mid))), (coarse, s[2])]
        return [(fine, s[0]), (mid, s[1]), (coarse, s[2])]

    def field(self, p, ctx, y0, x0, h, w, scale, channel, sigma):
        """A correlated unit field at absolute coordinates: the same wherever a band begins."""
        fast = p["mode"] == "fast"
        pad = 0 if sigma < 0.15 else 3 * box_radius(sigma) if fast else math.ceil(3 * sigma)
        ys, xs = np.arange(y0 - pad, y0 + h + pad)[:, None], np.arange(x0 - pad, x0 + w + pad)[None, :]
        raw = gaussian_array(int(p["seed"]), fnv1a(ctx.get("nodeId", "grain-main")), xs, ys, scale, channel).astype(float)
        if sigma < 0.15:
            return raw
        if fast:
            k = np.ones(1)
            for _ in range(3):
                k = np.convolve(k, np.full(2 * box_radius(sigma) + 1, 1 / (2 * box_radius(sigma) + 1)))
            out = K.box3(raw, sigma)
        else:
            k, out = np.array(gaussian_kernel(sigma)), K.gaussian(raw, sigma)
        return (out / (k * k).sum())[pad : pad + h, pad : pad + w]

    def apply(self, block, p, ctx):
        p = {**p, "mode": "fast"} if ctx.get("quality") == "fast" else p
        rgb = block["rgb"]
        h, w = rgb.shape[1:]
        fields = np.zeros_like(rgb)
        shared, own = math.sqrt(1 - 0.18 * p["chroma"]), math.sqrt(0.18 * p["chroma"])
        for k, (weight, sigma) in enumerate(self.scales(p, ctx)):
            fields += math.sqrt(weight) * shared * self.field(p, ctx, block["y0"], block["x0"], h, w, k, 0, sigma)
            if own > 0:
                for c in range(3):
                    fields[c] += math.sqrt(weight) * own * self.field(p, ctx, block["y0"], block["x0"], h, w, k, c + 1, sigma)
        x = np.log2(np.maximum(luma(rgb), 1e-6) / 0.18)
        envelope = 0.35 + 0.75 * np.exp(-0.5 * ((x - 0.3) / 1.4) ** 2) if p["profile"] == "positive" else 0.42 + 0.58 * np.exp(-0.5 * ((x + 0.5) / 2) ** 2)
        d = math.log(2) * 0.085 * p["amount"] * math.sqrt(film_format(ctx.get("format"))["iso"] / 250) * envelope
        gain = np.exp(np.clip(d * fields - 0.5 * d * d, -20, 20))
        return {**block, "rgb": rgb + block["a"] * (rgb * gain - rgb)}


class Reserved(Effect):
    """A declared node without an implementation: refused when a graph is validated, before any job."""

    def __init__(self, kind: str, stage: int):
        self.type, self.stage = kind, stage

    def params(self, given):
        raise NotImplementedError(f"effect {self.type!r} is declared but not implemented")


EFFECTS = {e.type: e for e in (Defringe(), Reserved("vignette", 20), Halation(), Bloom(), HighlightProtection(), FilmResolution(), Grain(), Reserved("damage", 80), Reserved("overscan", 90))}
