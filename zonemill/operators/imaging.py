"""Image kernels on 8-bit grey arrays (rows, columns), for use inside ``mapInArrow``: whole-array numpy, no pixel loops."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a pixel in each layout; YUV layouts count their luma plane, which is read like Gray8.
LAYOUTS = {"Gray8": 1, "Rgb24": 3, "Bgr24": 3, "Rgba32": 4, "Bgra32": 4, "Nv21": 1, "Nv12": 1, "I420": 1}
MOST_BYTES, MOST_PIXELS = 128 << 20, 150_000_000


def required_bytes(width: Column, height: Column, stride: Column, layout: Column) -> Column:
    """Bytes that a buffer of this geometry needs; null for a geometry that can't be."""
    per = F.element_at(F.create_map(*(F.lit(v) for kv in LAYOUTS.items() for v in kv)), layout)
    row = F.when(stride == 0, width * per).otherwise(stride)
    return F.when((width > 0) & (height > 0) & (row >= width * per), row.cast("long") * (height - 1) + width * per)


def luma(rgb: np.ndarray, alpha: np.ndarray | None = None) -> np.ndarray:
    """Grey of (..., 3) red, green, blue; transparent pixels over white."""
    grey = (rgb.astype(np.int32) @ np.array([77, 150, 29], dtype=np.int32)) >> 8
    if alpha is not None:
        a = alpha.astype(np.int32)
        grey = (grey * a + 255 * (255 - a)) // 255
    return grey.astype(np.uint8)


def from_buffer(data: bytes, width: int, height: int, stride: int = 0, layout: str = "Gray8", rotation: int = 0) -> np.ndarray:
    """Grey image of a raw buffer, turned clockwise by ``rotation`` degrees (a multiple of 90)."""
    per = LAYOUTS[layout]
    row = stride or width * per
    need = row * (height - 1) + width * per
    if width <= 0 or height <= 0 or row < width * per or len(data) < need or rotation % 90:
        raise ValueError("the buffer does not fit its geometry")
    flat = np.frombuffer(data, dtype=np.uint8, count=need)
    px = np.lib.stride_tricks.as_strided(flat, (height, width, per), (row, per, 1))
    if per == 1:
        grey = px[:, :, 0].copy()
    else:
        rgb = px[:, :, 2::-1] if layout.startswith("Bgr") else px[:, :, :3]
        grey = luma(rgb, px[:, :, 3] if per == 4 else None)
    return np.ascontiguousarray(np.rot90(grey, -(rotation // 90)))


def downscale(img: np.ndarray, most: int) -> np.ndarray:
    """The long side brought to ``most`` by averages of whole source pixels; smaller images as they are."""
    h, w = img.shape
    if max(h, w) <= most:
        return img
    nh, nw = (max(1, int(np.rint(s * most / max(h, w)))) for s in (h, w))
    edges = [np.stack(((np.arange(n) * s) // n, np.maximum((np.arange(n) * s) // n + 1, (np.arange(1, n + 1) * s) // n))) for n, s in ((nh, h), (nw, w))]
    total = np.pad(img.astype(np.int64), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    (y0, y1), (x0, x1) = edges
    box = total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)]
    return (box // np.outer(y1 - y0, x1 - x0)).astype(np.uint8)


def sample(img: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values at fractional places, edges repeated, rounded half to even."""
    iy, ix = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
    fy, fx = y - iy, x - ix
    at = lambda dy, dx: img[np.clip(iy + dy, 0, img.shape[0] - 1), np.clip(ix + dx, 0, img.shape[1] - 1)]
    top = at(0, 0) * (1 - fx) + at(0, 1) * fx
    low = at(1, 0) * (1 - fx) + at(1, 1) * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def resize(img: np.ndarray, width: int, height: int) -> np.ndarray:
    y = (np.arange(height) + 0.5) * (img.shape[0] / height) - 0.5
    x = (np.arange(width) + 0.5) * (img.shape[1] / width) - 0.5
    return sample(img, *np.meshgrid(y, x, indexing="ij"))


def rotate(img: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned about its centre within its own frame."""
    h, w = img.shape
    dy, dx = np.meshgrid(np.arange(h) - (h - 1) / 2, np.arange(w) - (w - 1) / 2, indexing="ij")
    a = np.deg2rad(degrees)
    return sample(img, (h - 1) / 2 + dx * np.sin(a) + dy * np.cos(a), (w - 1) / 2 + dx * np.cos(a) - dy * np.sin(a))


def percentile(img: np.ndarray, percent: int) -> int:
    """The smallest grey value that ``percent`` of the pixels, rounded down to whole pixels, do not exceed."""
    run = np.cumsum(np.bincount(img.ravel(), minlength=256))
    return int(np.searchsorted(run, img.size * percent // 100))


def normalise(v: np.ndarray) -> np.ndarray:
    """Zero mean and unit norm in float32; only centred if the norm is under 1e-6."""
    out = v.astype(np.float32) - np.float32(v.mean())
    norm = np.sqrt((out * out).sum())
    return out / norm if norm >= 1e-6 else out


def halve(img: np.ndarray) -> np.ndarray:
    """Means of two by two."""
    h, w = img.shape[0] // 2 * 2, img.shape[1] // 2 * 2
    return img[:h, :w].reshape(h // 2, 2, w // 2, 2).mean(axis=(1, 3))


def blur(img: np.ndarray) -> np.ndarray:
    """Mean of each pixel and its neighbours inside the image."""
    pad = lambda a: np.pad(a, 1)
    view = lambda a: np.lib.stride_tricks.sliding_window_view(pad(a), (3, 3)).sum(axis=(2, 3))
    return view(img.astype(np.float64)) / view(np.ones_like(img, dtype=np.float64))


def edge_rows(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Map of strong horizontal gradients and their count by row."""
    g = np.zeros(img.shape, dtype=np.int64)
    g[:, 1:-1] = np.abs(img[:, 2:].astype(np.int64) - img[:, :-2])
    strong = g > max(18, int(3 * g.sum()) // img.size)
    return strong, strong.sum(axis=1)


def row_runs(counts: np.ndarray) -> list[tuple[int, int]]:
    """(first, one past the last) of rows whose smoothed count passes a quarter of the peak and 12; none under a peak of 20."""
    wide = np.pad(counts.astype(np.int64), 1)
    near = np.minimum(np.arange(len(counts)) + 2, len(counts)) - np.maximum(np.arange(len(counts)) - 1, 0)
    smooth = (wide[:-2] + wide[1:-1] + wide[2:]) // near
    if not len(smooth) or smooth.max() < 20:
        return []
    on = np.pad((smooth >= max(12, smooth.max() // 4)).astype(np.int8), 1)
    step = np.diff(on)
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))
