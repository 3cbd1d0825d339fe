"""Minimal PNG writer for test pictures (stdlib zlib + struct)."""

from __future__ import annotations

from pathlib import Path

import numpy as np

from sightline.sources.standins import encode_png


def write_png(path: Path, pixels: np.ndarray) -> Path:
    """8-bit RGB (H x W x 3), RGBA (H x W x 4) or gray (H x W) -> PNG file."""
    Path(path).write_bytes(encode_png(pixels))
    return Path(path)


def noise(seed: int, size: int = 128) -> np.ndarray:
    """Random RGB picture; the same seed gives the same picture."""
    return np.random.default_rng(seed).integers(0, 256, size=(size, size, 3), dtype=np.uint8)


def flat(color: tuple[int, int, int], size: int = 128) -> np.ndarray:
    return np.broadcast_to(np.array(color, dtype=np.uint8), (size, size, 3)).copy()


def smooth(size: int = 128, seed: int = 5) -> np.ndarray:
    """A smooth, textured picture (coarse noise, bilinearly enlarged) that
    keeps its look when resized."""
    rng = np.random.default_rng(seed)
    cells = size // 8
    base = rng.normal(size=(cells + 2, cells + 2, 3))
    pos = np.linspace(0, cells, size)
    i0 = np.floor(pos).astype(int)
    f = pos - i0
    fy, fx = f[:, None, None], f[None, :, None]
    a, b = base[i0][:, i0], base[i0][:, i0 + 1]
    c, d = base[i0 + 1][:, i0], base[i0 + 1][:, i0 + 1]
    v = a * (1 - fy) * (1 - fx) + b * (1 - fy) * fx + c * fy * (1 - fx) + d * fy * fx
    v = (v - v.min()) / (v.max() - v.min()) * 255
    return v.round().astype(np.uint8)


def half_size(px: np.ndarray) -> np.ndarray:
    """2 x 2 box average: a smaller copy of the same picture."""
    a = px.astype(np.float64)
    small = (a[0::2, 0::2] + a[1::2, 0::2] + a[0::2, 1::2] + a[1::2, 1::2]) / 4
    return small.round().astype(np.uint8)
