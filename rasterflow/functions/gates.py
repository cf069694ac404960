"""Soft thresholds, masks and responses as Column expressions; plan-time thresholds as plain functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Responses of the red, green and blue layers at the six hues, from red over yellow to magenta.
RED_RESPONSE = (1.45, 1.15, 0.62, 0.015, 0.002, 0.82)
GREEN_RESPONSE = (0.35, 1.25, 0.85, 0.008, 0.001, 0.12)
BLUE_RESPONSE = (0.10, 0.08, 0.04, 0.002, 0.0, 0.04)
MIDDLE_GREY = 0.18
HIGHLIGHT_LIMIT = 8.0


def unit(v: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))


def smoothstep(a: float, b: float, x: Column) -> Column:
    if a == b:
        return F.when(x >= b, 1.0).otherwise(0.0)
    t = unit((x - a) / (b - a))
    return t * t * (3 - 2 * t)


def threshold_linear(value: float, units: str = "linear") -> float:
    return MIDDLE_GREY * 2**value if units == "stops" else value


def halation_threshold(value: float, units: str = "linear") -> float | None:
    """Linear threshold of the light-scattering node; None where its control is at the off end."""
    pivot, end = (3.0, 4.0) if units == "stops" else (0.9, 1.0)
    if value >= end:
        return None
    if value > pivot:
        value = pivot + (value - pivot) * (end - pivot) / max(1e-9, end - value)
    return threshold_linear(value, units)


def source_exposure(e: Column, t: float) -> Column:
    if t < 1:
        return F.when(e <= t, 0.0).when(e <= 1, (e - t) / max(1e-6, 1 - t)).otherwise(1 + F.log2(F.greatest(e, F.lit(1.0))))
    return F.when(e <= t, 0.0).otherwise(F.greatest(F.lit(0.0), F.log2(F.greatest(e, F.lit(t)) / max(t, 1e-6))))


def highlight_response(u: Column, impact: float) -> Column:
    raw = F.pow(F.greatest(F.lit(0.0), u), F.lit(1 + 1.5 * min(1.0, max(0.0, impact))))
    return HIGHLIGHT_LIMIT * raw / (HIGHLIGHT_LIMIT - 1 + raw)


def legacy_response(u: Column, impact: float) -> Column:
    raw = F.pow(F.greatest(F.lit(0.0), u), F.lit(1 + 1.5 * min(1.0, max(0.0, impact))))
    return HIGHLIGHT_LIMIT * (1 - F.exp(-raw / HIGHLIGHT_LIMIT))


def hue(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """hue (0 to 1), saturation and the three layers' responses; neutral colours respond with 1."""
    r, g, b = (F.greatest(F.lit(0.0), c) for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    delta = top - low
    neutral = (top <= 1e-12) | (delta <= 1e-12)
    safe = F.when(neutral, 1.0).otherwise(delta)
    h6 = F.when(top == r, F.pmod((g - b) / safe + 6, F.lit(6.0))).when(top == g, (b - r) / safe + 2).otherwise((r - g) / safe + 4)
    at = F.pmod(F.floor(h6), F.lit(6)).cast("int")
    t = h6 - F.floor(h6)
    t = t * t * (3 - 2 * t)

    def response(table) -> Column:
        first, second = (F.element_at(F.array(*map(F.lit, x)), at + 1) for x in (table, table[1:] + table[:1]))
        return F.when(neutral, 1.0).otherwise(first + (second - first) * t)

    return {
        "hue": F.when(neutral, 0.0).otherwise(h6 / 6),
        "saturation": F.when(neutral, 0.0).otherwise(delta / F.when(neutral, 1.0).otherwise(top)),
        "red": response(RED_RESPONSE), "green": response(GREEN_RESPONSE), "blue": response(BLUE_RESPONSE),
    }


def luma_mask(y: Column, low: float, high: float, softness: float, invert: bool = False) -> Column:
    ev = F.log2(F.greatest(F.lit(2.0**-24), y) / MIDDLE_GREY)
    m = smoothstep(low - softness, low, ev) * (1 - smoothstep(high, high + softness, ev))
    return 1 - m if invert else m


def masked(before: Column, after: Column, mask: Column) -> Column:
    """An effect's result as far as the mask lets it through; where it is 0, exactly what was there."""
    m = unit(mask)
    return F.when(m == 0, before).otherwise(before + (after - before) * m)


def masked_contribution(added: Column, mask: Column) -> Column:
    return added * unit(mask)


def exposure_envelope(y: Column, profile: str = "negative") -> Column:
    x = F.log2(F.greatest(y, F.lit(1e-6)) / MIDDLE_GREY)
    if profile == "positive":
        return 0.35 + 0.75 * F.exp(-0.5 * F.pow((x - 0.3) / 1.4, F.lit(2)))
    return 0.42 + 0.58 * F.exp(-0.5 * F.pow((x + 0.5) / 2.0, F.lit(2)))


def screen_gain(base: Column) -> Column:
    return F.when(base <= 0, 1.0).when(base < 1, 1 - base).otherwise(1 / F.greatest(F.lit(1.0), base))


def let(value: Column, body) -> Column:
    """body(value) with the value taken once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def density_composite(rgb, halo, density: Column, blue: float) -> list[Column]:
    """Colour moved towards the halo's red-orange at equal luma, then the halo added."""
    names = [*"rgb", "er", "eg", "eb", "density"]
    start = F.struct(*[c.alias(n) for c, n in zip((*rgb, *halo, density), names, strict=True)])

    def shares(v: Column) -> Column:
        r, g, b, er, eg, eb = (v[n] for n in names[:6])
        excess = F.greatest(F.lit(0.0), er - F.greatest(eg, eb))
        cool = unit((F.greatest(g, b) - r) / F.greatest(F.lit(1e-8), r, g, b))
        y = F.greatest(F.lit(0.0), 0.2126 * r + 0.7152 * g + 0.0722 * b)
        safe = F.greatest(er, F.lit(1e-8))
        gr = F.least(F.lit(0.38), F.greatest(F.lit(0.12), eg / safe))
        br = F.least(F.lit(0.12), F.greatest(F.lit(0.035), eb / safe))
        plain = (v["density"] <= 0) | (er <= 1e-12) | (excess <= 1e-12)
        return F.struct(y.alias("y"), (excess * (1 + 1.6 * blue * cool)).alias("energy"), unit((y - 0.70) / 0.35).alias("t"), gr.alias("gr"), br.alias("br"), plain.alias("plain"))

    def mixed(v: Column, s: Column) -> Column:
        y, t = s["y"], s["t"]
        mask = F.least(F.lit(0.78), v["density"] * (1 - F.exp(-6 * s["energy"])) * (1 - 0.86 * t * t * (3 - 2 * t)))
        tr = F.least(y / F.greatest(F.lit(1e-8), 0.2126 + 0.7152 * s["gr"] + 0.0722 * s["br"]), y * 2.4 + 0.05)
        return let(F.struct(mask.alias("m"), tr.alias("tr")), lambda q: F.array(*[v[c] + (to - v[c]) * q["m"] for c, to in zip("rgb", (q["tr"], q["tr"] * s["gr"], q["tr"] * s["br"]), strict=True)]))

    def done(v: Column, s: Column, c: Column) -> Column:
        lift = F.greatest(F.lit(0.0), s["y"] - (0.2126 * c[0] + 0.7152 * c[1] + 0.0722 * c[2]))
        return F.array(*[F.when(s["plain"], v[n]).otherwise(c[i] + lift) + v["e" + n] for i, n in enumerate("rgb")])

    out = let(start, lambda v: let(shares(v), lambda s: let(mixed(v, s), lambda c: done(v, s, c))))
    return [out[i] for i in range(3)]


def sigma_pixels(sigma: float, units: str, width: int, height: int) -> float:
    return sigma / 1000 * math.hypot(width, height) if units == "diagonal" else sigma
