"""Map images: features in layer order, polygons filled, lines drawn, PNG bytes out; one task an image."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Layer order from back to front, by style number.
ORDER = (2, 3, 0, 4, 1, 9, 8, 10, 7, 6, 5)
COLORS = {0: (170, 211, 223), 1: (150, 190, 220), 2: (173, 209, 158), 3: (200, 250, 204), 4: (217, 208, 201), 5: (233, 144, 160), 6: (252, 214, 164), 7: (247, 250, 191), 8: (255, 255, 255), 9: (250, 128, 114), 10: (112, 112, 112)}
WIDTHS = {5: 3, 6: 2, 7: 2}
LAND = (242, 239, 233)


def project(lon: np.ndarray, lat: np.ndarray, box: tuple[int, int, int, int], width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Pixels of nanodegrees; integer arithmetic, north is up."""
    x = (lon - box[0]) * (width - 1) // (box[2] - box[0])
    y = (box[3] - lat) * (height - 1) // (box[3] - box[1])
    return x, y


def fill(image: np.ndarray, xs: np.ndarray, ys: np.ndarray, color: tuple[int, int, int]) -> None:
    """Even-odd polygon fill by scanline, at pixel centres."""
    h, w, _ = image.shape
    x2, y2 = np.roll(xs, -1), np.roll(ys, -1)
    for row in range(max(0, int(ys.min())), min(h - 1, int(ys.max())) + 1):
        c = row + 0.5
        cross = (ys <= c) != (y2 <= c)
        if not cross.any():
            continue
        at = np.sort(xs[cross] + (c - ys[cross]) * (x2[cross] - xs[cross]) / (y2[cross] - ys[cross]))
        for a, b in zip(at[::2], at[1::2], strict=False):
            image[row, max(0, int(np.ceil(a - 0.5))) : max(0, min(w, int(np.floor(b - 0.5)) + 1))] = color


def line(image: np.ndarray, x0: int, y0: int, x1: int, y1: int, color: tuple[int, int, int], width: int = 1) -> None:
    """A straight line with a square brush; parts outside the image are cut."""
    h, w, _ = image.shape
    n = max(abs(x1 - x0), abs(y1 - y0), 1)
    t = np.arange(n + 1)
    xs, ys = x0 + (2 * t * (x1 - x0) + n) // (2 * n), y0 + (2 * t * (y1 - y0) + n) // (2 * n)
    r = width // 2
    for dx in range(-r, width - r):
        for dy in range(-r, width - r):
            x, y = xs + dx, ys + dy
            ok = (x >= 0) & (x < w) & (y >= 0) & (y < h)
            image[y[ok], x[ok]] = color


def png(image: np.ndarray) -> bytes:
    """PNG bytes: a palette of up to 256 colours where they suffice, else RGB."""
    h, w, _ = image.shape
    flat = image.reshape(-1, 3)
    colors, index = np.unique(flat, axis=0, return_inverse=True)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    small = len(colors) <= 256
    rows = index.reshape(h, w).astype(np.uint8) if small else flat.reshape(h, w * 3)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, 3 if small else 2, 0, 0, 0)
    palette = chunk(b"PLTE", colors.astype(np.uint8).tobytes()) if small else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + palette + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def draw(features: pd.DataFrame, box: tuple[int, int, int, int], width: int, height: int) -> np.ndarray:
    """Pixels of features (style, flags, lons, lats), areas first within a layer, then lines."""
    image = np.empty((height, width, 3), np.uint8)
    image[:] = LAND
    for style in ORDER:
        part = features[features["style"] == style]
        for areas in (True, False):
            for f in part[(part["flags"] & 1 == 1) == areas].itertuples():
                x, y = project(np.asarray(f.lons), np.asarray(f.lats), box, width, height)
                if areas:
                    fill(image, x, y, COLORS[style])
                else:
                    for a in range(len(x) - 1):
                        line(image, int(x[a]), int(y[a]), int(x[a + 1]), int(y[a + 1]), COLORS[style], WIDTHS.get(style, 1))
    return image


def render(features: DataFrame, box: tuple[int, int, int, int], width: int, height: int) -> DataFrame:
    """image_id and png of each image's features (image_id, style, flags, lons, lats); an image is bounded by its viewport."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["style", "flags"], kind="mergesort")
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "png": [png(draw(ordered, box, width, height))]})

    return features.groupBy("image_id").applyInPandas(one, "image_id long, png binary")
