"""Page images in numpy: ink, contrast, noise and skew, what to do about them, and the repairs themselves."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Pixels, with the edge that denoising needs, that are held in one array.
AT_ONCE = 1 << 18
SCHEMA = "readable boolean, blank boolean, ink_ratio double, contrast_std double, noise_score double, skew_deg double"


def gray(data, width: int, height: int, channels: int) -> np.ndarray | None:
    """Pixels of an image row (blue, green, red by the row) as gray levels."""
    if data is None or not width or not height:
        return None
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    return np.rint(a[..., :3] @ [0.114, 0.587, 0.299]) if channels >= 3 else a[..., 0]


def stacks(images: list, edge: int = 0):
    """(indices, array of images) of those that aren't None: images of one shape lie in one array, of AT_ONCE pixels or a single image."""
    by_shape: dict = {}
    for i, img in enumerate(images):
        if img is not None:
            by_shape.setdefault(img.shape, []).append(i)
    for (h, w), found in by_shape.items():
        n = max(1, AT_ONCE // ((h + 2 * edge) * (w + 2 * edge)))
        for at in range(0, len(found), n):
            yield found[at : at + n], np.stack([images[i] for i in found[at : at + n]])


def noise(img: np.ndarray):
    """Variance of the 4-neighbour Laplacian over 10000, of an image or each of a stack; edges are mirrored without repeating the edge."""
    if min(img.shape[-2:]) < 2:
        return np.zeros(img.shape[:-2])[()]
    p = np.pad(img, [(0, 0)] * (img.ndim - 2) + [(1, 1)] * 2, mode="reflect")
    lap = p[..., :-2, 1:-1] + p[..., 2:, 1:-1] + p[..., 1:-1, :-2] + p[..., 1:-1, 2:] - 4 * img
    return np.var(lap.reshape(*img.shape[:-2], -1), -1) / 10000


def otsu(img: np.ndarray) -> int:
    """The level that splits the histogram with the greatest variance between both sides."""
    h = np.bincount(img.astype(np.uint8).ravel(), minlength=256).astype(float)
    n, s = np.cumsum(h), np.cumsum(h * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (s[-1] * n / n[-1] - s) ** 2 / (n * (n[-1] - n))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def skew(img: np.ndarray) -> float:
    """Degrees between the axes and the least-area rectangle round the dark pixels; 0 beyond 15 or for under 50 pixels.

    The rectangle of least area has a side on an edge of the convex hull, so hull edges are all that is tried.
    """
    if img.size < 50:
        return 0.0
    y, x = np.nonzero(img <= otsu(img))
    if len(x) < 50:
        return 0.0
    # only a row's first and last dark pixel can be corners of the hull
    at = np.flatnonzero(np.append(True, y[1:] != y[:-1]))
    ends = np.append(at[1:], len(y)) - 1
    hull = _hull(np.unique(np.stack([np.append(x[at], x[ends]), np.append(y[at], y[ends])], 1).astype(float), axis=0))
    if len(hull) < 3:
        return 0.0
    best = (np.inf, 0.0)
    for d in np.roll(hull, -1, 0) - hull:
        u = d / np.hypot(*d)
        a, b = hull @ u, hull @ np.array([-u[1], u[0]])
        best = min(best, (np.ptp(a) * np.ptp(b), float(np.degrees(np.arctan2(u[1], u[0])) % 90)))
    angle = best[1] if best[1] <= 45 else best[1] - 90
    return -angle if abs(angle) < 15 else 0.0


def _hull(points: np.ndarray) -> np.ndarray:
    def half(ps):
        out: list = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


def _grays(b: pd.DataFrame) -> list:
    return [gray(d, int(w), int(h), int(c)) for w, h, c, d in zip(b["width"], b["height"], b["nChannels"], b["data"])]


def profiles(images: list, blank_below: float = 0.002) -> list[tuple]:
    """SCHEMA of gray images, None for an unreadable one; images of one shape are measured together."""
    out: list[tuple] = [(False, True, None, None, None, None)] * len(images)
    for at, s in stacks(images):
        flat = s.reshape(len(s), -1)
        ink = (flat < 200).mean(1)
        for i, k, std, rough in zip(at, ink.tolist(), flat.std(1).tolist(), noise(s).tolist()):
            out[i] = (True, k < blank_below, k, std, rough, skew(images[i]))
    return out


def analyze(images: DataFrame, blank_below: float = 0.002) -> DataFrame:
    """images(origin, width, height, nChannels, data) -> origin and SCHEMA; an unreadable image is blank, too."""

    def run(batches):
        for b in batches:
            out = pd.DataFrame(profiles(_grays(b), blank_below), columns=["readable", "blank", "ink_ratio", "contrast_std", "noise_score", "skew_deg"])
            yield pd.concat([b[["origin"]].reset_index(drop=True), out], axis=1)

    return images.mapInPandas(run, f"origin string, {SCHEMA}")


def rotate(img: np.ndarray, degrees: float) -> np.ndarray:
    """Turned counter-clockwise about the middle pixel, by cubic interpolation (a = -0.75); beyond the edge lies the edge's pixel."""
    h, w = img.shape
    cy, cx, t = h // 2, w // 2, np.radians(degrees)
    yy, xx = np.mgrid[:h, :w].astype(float)
    dx, dy = xx - cx, yy - cy
    sx, sy = cx + dx * np.cos(t) - dy * np.sin(t), cy + dx * np.sin(t) + dy * np.cos(t)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)

    def weight(d):
        d = np.abs(d)
        return np.where(d <= 1, (1.25 * d - 2.25) * d * d + 1, np.where(d < 2, ((-0.75 * d + 3.75) * d - 6) * d + 3, 0))

    out = np.zeros((h, w))
    for j in range(-1, 3):
        wy, row = weight(sy - (y0 + j)), np.clip(y0 + j, 0, h - 1)
        for i in range(-1, 3):
            out += wy * weight(sx - (x0 + i)) * img[row, np.clip(x0 + i, 0, w - 1)]
    return np.clip(np.rint(out), 0, 255)


def _blurred(img: np.ndarray, kernel: np.ndarray, mode: str) -> np.ndarray:
    """Convolution with a kernel along both axes, one after the other."""
    r, (h, w) = len(kernel) // 2, img.shape[-2:]
    p = np.pad(img, [(0, 0)] * (img.ndim - 2) + [(r, r)] * 2, mode=mode)
    p = sum(k * p[..., i : i + h, :] for i, k in enumerate(kernel))
    return sum(k * p[..., i : i + w] for i, k in enumerate(kernel))


def binarize(img: np.ndarray, size: int = 31, below: float = 15) -> np.ndarray:
    """White where a pixel is over the Gaussian mean of its surroundings less `below`; the Gaussian's width follows from its size. One image or a stack."""
    sigma = 0.3 * ((size - 1) / 2 - 1) + 0.8
    kernel = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    mean = np.rint(_blurred(img.astype(float), kernel / kernel.sum(), "edge"))
    return np.where(img > mean - below, 255.0, 0.0)


#: Pixels beyond an image's edge that denoising looks at.
EDGE = 21 // 2 + 7 // 2


def denoise(img: np.ndarray, strength: float = 10, template: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means: each pixel is the mean of those around it, weighted by how alike the patches about them are. One image or a stack of one shape."""
    (h, w), t, r = img.shape[-2:], template // 2, search // 2
    p = np.pad(img.astype(float), [(0, 0)] * (img.ndim - 2) + [(r + t, r + t)] * 2, mode="reflect" if min(h, w) > r + t else "edge")
    own = p[..., r : r + h + 2 * t, r : r + w + 2 * t]
    total, weight = np.zeros(img.shape), np.zeros(img.shape)
    for dy in range(search):
        for dx in range(search):
            other = p[..., dy : dy + h + 2 * t, dx : dx + w + 2 * t]
            c = np.cumsum((own - other) ** 2, -2)  # sums over patches, as differences of running sums
            s = c[..., 2 * t :, :].copy()
            s[..., 1:, :] -= c[..., : h - 1, :]
            c = np.cumsum(s, -1)
            s = c[..., 2 * t :].copy()
            s[..., 1:] -= c[..., : w - 1]
            k = np.exp(-np.maximum(s, 0) / (template * strength) ** 2)
            total += k * other[..., t : t + h, t : t + w]
            weight += k
    return np.rint(total / weight)


def png(img: np.ndarray) -> bytes:
    """A gray image as a PNG file."""
    a = img.astype(np.uint8)
    raw = np.concatenate([np.zeros((len(a), 1), np.uint8), a], 1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def repaired(images: list, skew_deg, deskew, noisy, pale) -> list[bytes | None]:
    """PNG files of gray images, None where nothing is to be done. In this order, each step where its gate asks for it: a page is turned against its skew, denoised, binarized.

    Denoising compares 441 shifts of a page, so it is the dear one; images of one shape are shifted together.
    """
    todo = [img if img is not None and (a or b or c) else None for img, a, b, c in zip(images, deskew, noisy, pale)]
    for i, img in enumerate(todo):
        if img is not None and deskew[i]:
            todo[i] = rotate(img, -skew_deg[i])
    for step, asked, edge in ((denoise, noisy, EDGE), (binarize, pale, 15)):
        for at, s in stacks([img if asked[i] else None for i, img in enumerate(todo)], edge):
            for i, img in zip(at, step(s)):
                todo[i] = img
    return [None if img is None else png(img) for img in todo]


def repair(images: DataFrame) -> DataFrame:
    """images(origin, width, height, nChannels, data, skew_deg, deskew, denoise, binarize) -> origin, png: the repaired page, null where nothing is to be done."""

    def run(batches):
        for b in batches:
            flags = [b[c].fillna(False).astype(bool).tolist() for c in ("deskew", "denoise", "binarize")]
            yield pd.DataFrame({"origin": b["origin"], "png": repaired(_grays(b), b["skew_deg"].tolist(), *flags)})

    return images.mapInPandas(run, "origin string, png binary")


def triaged(images: DataFrame, blank_below: float = 0.002, least_angle: float = 0.3, noise_above: float = 0.15, contrast_below: float = 40) -> DataFrame:
    """images(origin, width, height, nChannels, data) -> origin, SCHEMA, the gates and png: analyze, gates and repair in one pass, so no image is read twice or sent anywhere."""

    def run(batches):
        for b in batches:
            grays = _grays(b)
            out = pd.DataFrame(profiles(grays, blank_below), columns=["readable", "blank", "ink_ratio", "contrast_std", "noise_score", "skew_deg"])
            ok = out["readable"] & ~out["blank"]
            out["deskew"], out["denoise"], out["binarize"] = ok & (out["skew_deg"].abs() >= least_angle), ok & (out["noise_score"] > noise_above), ok & (out["contrast_std"] < contrast_below)
            out["png"] = repaired(grays, out["skew_deg"].tolist(), *(out[c].tolist() for c in ("deskew", "denoise", "binarize")))
            yield pd.concat([b[["origin"]].reset_index(drop=True), out], axis=1)

    return images.mapInPandas(run, f"origin string, {SCHEMA}, deskew boolean, denoise boolean, binarize boolean, png binary")


def gates(profiles: DataFrame, least_angle: float = 0.3, noise_above: float = 0.15, contrast_below: float = 40) -> DataFrame:
    """profiles plus deskew, denoise and binarize: which steps a page needs."""
    ok = "readable AND NOT blank"
    return profiles.selectExpr("*", f"{ok} AND abs(skew_deg) >= {least_angle!r}D AS deskew", f"{ok} AND noise_score > {noise_above!r}D AS denoise", f"{ok} AND contrast_std < {contrast_below!r}D AS binarize")
