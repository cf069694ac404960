"""NumPy kernels over whole planes or halo-padded row blocks, for filters too wide or too recursive for windows."""

from __future__ import annotations

import math

import numpy as np

from rasterflow.operators.stencil import box_radius, gaussian_kernel


def smoothstep(a, b, x):
    if a == b:
        return (np.asarray(x) >= b).astype(float)
    t = np.clip((x - a) / (b - a), 0, 1)
    return t * t * (3 - 2 * t)


def _convolve(p: np.ndarray, kernel, axis: int) -> np.ndarray:
    r = len(kernel) // 2
    width = [(0, 0), (0, 0)]
    width[axis] = (r, r)
    padded = np.pad(p, width, mode="edge")
    n, out = p.shape[axis], np.zeros_like(p)
    for k, w in enumerate(kernel):
        out += w * (padded[:, k : k + n] if axis else padded[k : k + n])
    return out


def box3(p: np.ndarray, sigma: float) -> np.ndarray:
    """Three box passes per axis by running sums: cost independent of the radius."""
    r = box_radius(sigma)
    for _ in range(3 if r else 0):
        for axis in (1, 0):
            width = [(0, 0), (0, 0)]
            width[axis] = (r + 1, r)
            total = np.cumsum(np.pad(p, width, mode="edge"), axis)
            n = p.shape[axis]
            p = (total[:, 2 * r + 1 : 2 * r + 1 + n] - total[:, :n] if axis else total[2 * r + 1 : 2 * r + 1 + n] - total[:n]) / (2 * r + 1)
    return p


def gaussian(p: np.ndarray, sigma: float) -> np.ndarray:
    k = gaussian_kernel(sigma)
    return _convolve(_convolve(p, k, 1), k, 0)


def recursive_gaussian(p: np.ndarray, sigma: float) -> np.ndarray:
    """Third-order recursive Gaussian: forward and backward along an axis, all lines of the other axis at once."""
    q = 0.98711 * sigma - 0.9633 if sigma >= 2.5 else 3.97156 - 4.14554 * math.sqrt(max(0, 1 - 0.26891 * sigma))
    b0 = 1.57825 + 2.44413 * q + 1.4281 * q**2 + 0.422205 * q**3
    taps = np.array([2.44413 * q + 2.85619 * q**2 + 1.26661 * q**3, -(1.4281 * q**2 + 1.26661 * q**3), 0.422205 * q**3]) / b0
    gain, pad = 1 - taps.sum(), max(2, math.ceil(5 * sigma))
    for axis in (1, 0):
        n = p.shape[axis]
        before = np.minimum(np.arange(pad, 0, -1), n - 1)
        after = np.maximum(0, n - 1 - np.arange(1, pad + 1))
        lines = np.moveaxis(np.take(p, np.concatenate([before, np.arange(n), after]), axis), axis, 0)
        for way in (1, -1):
            lines = lines[::-1] if way < 0 else lines
            out, past = np.empty_like(lines), [np.zeros(lines.shape[1])] * 3
            for i, v in enumerate(lines):
                out[i] = gain * v + taps[0] * past[0] + taps[1] * past[1] + taps[2] * past[2]
                past = [out[i], past[0], past[1]]
            lines = out[::-1] if way < 0 else out
        p = np.moveaxis(lines[pad : pad + n], 0, axis)
    return np.ascontiguousarray(p)


def max_square(p: np.ndarray, radius: float) -> np.ndarray:
    """Running maxima from both sides of blocks: cost independent of the radius."""
    r = math.floor(radius)
    if r < 1:
        return p
    for axis in (1, 0):
        lines = np.moveaxis(p, axis, 0)
        n, width = len(lines), 2 * r + 1
        blocks = -(-(n + 2 * r) // width)
        padded = np.full((blocks * width, lines.shape[1]), -np.inf)
        padded[r : r + n] = lines
        cut = padded.reshape(blocks, width, -1)
        ahead = np.maximum.accumulate(cut, axis=1).reshape(padded.shape)
        back = np.maximum.accumulate(cut[:, ::-1], axis=1)[:, ::-1].reshape(padded.shape)
        p = np.moveaxis(np.maximum(back[:n], ahead[2 * r : 2 * r + n]), 0, axis)
    return np.ascontiguousarray(p)


def shrink(p: np.ndarray, s: int) -> np.ndarray:
    h, w = p.shape
    rows, cols = np.arange(0, h, s), np.arange(0, w, s)
    total = np.add.reduceat(np.add.reduceat(p, rows, 0), cols, 1)
    return total / np.outer(np.diff(np.append(rows, h)), np.diff(np.append(cols, w)))


def grow(low: np.ndarray, h: int, w: int, s: int) -> np.ndarray:
    """Bilinear: extrapolated before the first centre, repeated past the last."""

    def place(n: int, cells: int):
        f = (np.arange(n) + 0.5) / s - 0.5
        first = np.maximum(0, np.floor(f)).astype(int)
        return first, np.minimum(first + 1, cells - 1), f - first

    y0, y1, ty = place(h, low.shape[0])
    x0, x1, tx = place(w, low.shape[1])
    rows = low[y0] * (1 - ty)[:, None] + low[y1] * ty[:, None]
    return rows[:, x0] * (1 - tx) + rows[:, x1] * tx


def lobes(params: dict, red: bool) -> list[tuple[float, float]]:
    """(sigma ratio, weight) of core, shoulder and tail."""
    s = min(1.0, max(0.0, params.get("smoothness", 0.15)))
    out = [[0.22 + 0.1 * s, 0.65 - 0.22 * s], [0.62 + 0.25 * s, 0.27 + 0.08 * s], [1.35 + 0.55 * s, 0.08 + 0.14 * s]]
    tail = min(1.0, max(0.0, params.get("redTail", 0)))
    if red and tail > 0:
        out[0][1] *= 1 - 0.34 * tail
        out[1] = [out[1][0] * (1 + 0.16 * tail), out[1][1] * (1 + 0.62 * tail)]
        out[2] = [out[2][0] * (1 + 0.42 * tail), out[2][1] * (1 + 1.9 * tail)]
        total = sum(w for _, w in out)
        out = [[r, w / total] for r, w in out]
    return [(r, w) for r, w in out]


def lobe_scale(sigma: float, quality: bool) -> int:
    return max([1, *(s for s in (2, 4, 8) if sigma / s >= (4 if quality else 3))])


def blur(p: np.ndarray, sigma: float, quality: bool) -> np.ndarray:
    if sigma <= 0.01:
        return p
    if not quality:
        return box3(p, sigma)
    return gaussian(p, sigma) if sigma < 4 else recursive_gaussian(p, sigma)


def scaled(p: np.ndarray, sigma: float, scale: int, one, wide=None, name: str = "") -> np.ndarray:
    """A blur at a reduced size. wide: gives those of a whole frame, where p is a part of it."""
    if scale == 1:
        return one(p, sigma)
    return wide(name, scale, p.shape) if wide else grow(one(shrink(p, scale), sigma / scale), *p.shape, scale)


def lobe_sizes(sigma: float, params: dict, red: bool) -> list[tuple[float, float, int]]:
    """(sigma, weight, scale) of the lobes: the core at full size, wider ones at reduced sizes."""
    quality = params["diffusionMode"] == "quality"
    return [(sigma * r, w, 1 if k == 0 else lobe_scale(sigma * r, quality)) for k, (r, w) in enumerate(lobes(params, red))]


def psf(p: np.ndarray, sigma: float, params: dict, red: bool = False, wide=None, name: str = "") -> np.ndarray:
    """The weighted lobes of a plane."""
    one = lambda q, s: blur(q, s, params["diffusionMode"] == "quality")
    return sum(w * scaled(p, s, scale, one, wide, f"{name}{k}") for k, (s, w, scale) in enumerate(lobe_sizes(sigma, params, red)))


def bloom_scale(sigma: float, name: str) -> int:
    return 1 if name == "core" else (4 if sigma >= 16 else 2) if name == "mid" else (8 if sigma >= 32 else 4)


def bloom_one(quality: bool):
    return lambda q, s: box3(q, s) if not quality else gaussian(q, s) if s < 0.4 else recursive_gaussian(q, s)


def bloom_blur(p: np.ndarray, sigma: float, name: str, quality: bool, wide=None, label: str = "") -> np.ndarray:
    return scaled(p, sigma, bloom_scale(sigma, name), bloom_one(quality), wide, label)
