"""Deterministic coordinate hashing: unsigned 32-bit arithmetic in 64-bit columns, and the same in NumPy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterflow.functions.gates import let

M32 = 0xFFFFFFFF
GOLDEN = 0x9E3779B9


def fnv1a(text: str) -> int:
    h = 0x811C9DC5
    for byte in text.encode("utf-8", "replace"):
        h = (h ^ byte) * 0x01000193 & M32
    return h


def fmix32(h: int) -> int:
    h &= M32
    h = (h ^ h >> 16) * 0x85EBCA6B & M32
    h = (h ^ h >> 13) * 0xC2B2AE35 & M32
    return h ^ h >> 16


def hash32(seed: int, *words: int) -> int:
    h = fmix32(seed ^ GOLDEN)
    for w in words:
        h = fmix32(h ^ w & M32)
    return h


def derive_seed(previous: int, fingerprint: str, node_id: str) -> int:
    return fmix32(previous ^ fnv1a(fingerprint) ^ fnv1a(node_id) ^ GOLDEN)


def multiply(a: Column, b: int) -> Column:
    """a * b modulo 2^32 without leaving the range of a 64-bit integer."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * b
    high = (F.shiftrightunsigned(a, 16) * b).bitwiseAND(F.lit(0xFFFF)) * 65536
    return (low + high).bitwiseAND(F.lit(M32))


def fmix32_column(h: Column) -> Column:
    h = multiply(h.bitwiseXOR(F.shiftrightunsigned(h, 16)), 0x85EBCA6B)
    h = multiply(h.bitwiseXOR(F.shiftrightunsigned(h, 13)), 0xC2B2AE35)
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16))


def u32(c: Column) -> Column:
    return c.cast("long").bitwiseAND(F.lit(M32))


def fmix32_array(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint32)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def gaussian_array(seed: int, node: int, x: np.ndarray, y: np.ndarray, scale: int, channel: int) -> np.ndarray:
    """Twelve uniforms less six, summed in single precision, at each coordinate (arrays of integers)."""
    h = np.full(np.broadcast(x, y).shape, fmix32(fmix32(seed ^ GOLDEN) ^ node), np.uint32)
    for w in (x, y):
        h = fmix32_array(h ^ (np.asarray(w, np.int64) & M32).astype(np.uint32))
    h = fmix32_array(fmix32_array(h ^ np.uint32(scale)) ^ np.uint32(channel))
    total = np.zeros(h.shape, np.float32)
    for k in range(12):
        total = (total.astype(np.float64) + fmix32_array(h ^ np.uint32(k)) / 2.0**32).astype(np.float32)
    return (total.astype(np.float64) - 6).astype(np.float32)


def fmix32_once(h: Column) -> Column:
    """fmix32_column for chains: each step's value is taken once, so expressions don't multiply."""
    h = let(h, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 16)))
    h = let(let(h, lambda v: multiply(v, 0x85EBCA6B)), lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 13)))
    return let(let(h, lambda v: multiply(v, 0xC2B2AE35)), lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 16)))


def hash32_column(seed: int, *words: Column | int) -> Column:
    """hash32 with columns among its words; those before the first column are taken on the driver."""
    h: Column | int = fmix32(seed ^ GOLDEN)
    for w in words:
        if isinstance(w, int) and isinstance(h, int):
            h = fmix32(h ^ w & M32)
        else:
            h = fmix32_once((F.lit(h).cast("long") if isinstance(h, int) else h).bitwiseXOR(u32(F.lit(w) if isinstance(w, int) else w)))
    return h


def gaussian_column(seed: int, node: str, x: Column, y: Column, scale: int, channel: int) -> Column:
    """Twelve uniforms less six at each coordinate, every sum rounded to single precision."""
    draw = lambda h: F.transform(F.array(*[F.lit(k).cast("long") for k in range(12)]), lambda k: fmix32_once(h.bitwiseXOR(k)) / float(1 << 32))
    drawn = let(hash32_column(seed, fnv1a(node), x, y, scale, channel), draw)
    total = F.aggregate(drawn, F.lit(0.0).cast("float"), lambda t, u: (t.cast("double") + u).cast("float"))
    return (total.cast("double") - 6).cast("float")


def derive_seed_column(previous: Column, fingerprint: str, node_id: str) -> Column:
    return fmix32_once(u32(previous).bitwiseXOR(F.lit(fnv1a(fingerprint) ^ fnv1a(node_id) ^ GOLDEN)))
