"""Whole-raster numpy kernels: what runs inside one Arrow batch row. A raster is uint8, (height, width) or (height, width, 3) in B, G, R order.

Published algorithms, with their free choices fixed here: sums are exact where integers allow, ties take the first,
erosion and dilation ignore what is outside, filters reflect about the edge pixel, adaptive means repeat it.
"""

from __future__ import annotations

import math

import numpy as np

# ---- colour and pointwise -------------------------------------------------------------------------------------


def to_u8(x: np.ndarray) -> np.ndarray:
    """Rounded half to even, saturated."""
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def gray(bgr: np.ndarray) -> np.ndarray:
    if bgr.ndim == 2:
        return bgr
    b, g, r = (bgr[..., k].astype(np.int64) for k in range(3))
    return ((299 * r + 587 * g + 114 * b + 500) // 1000).astype(np.uint8)


def to_bgr(x: np.ndarray) -> np.ndarray:
    return np.repeat(x[..., None], 3, axis=2) if x.ndim == 2 else x


def bgr_to_ycrcb(x: np.ndarray) -> np.ndarray:
    b, g, r = (x[..., k].astype(np.float64) for k in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return to_u8(np.stack([y, (r - y) * 0.713 + 128, (b - y) * 0.564 + 128], axis=2))


def ycrcb_to_bgr(x: np.ndarray) -> np.ndarray:
    y, cr, cb = (x[..., k].astype(np.float64) for k in range(3))
    return to_u8(np.stack([y + 1.773 * (cb - 128), y - 0.714 * (cr - 128) - 0.344 * (cb - 128), y + 1.403 * (cr - 128)], axis=2))


def bgr_to_hsv(x: np.ndarray) -> np.ndarray:
    """Hue in 0..179."""
    b, g, r = (x[..., k].astype(np.float64) for k in range(3))
    top, low = x.max(axis=2).astype(np.float64), x.min(axis=2).astype(np.float64)
    d = top - low
    safe = np.where(d == 0, 1, d)
    h = np.where(top == r, (g - b) / safe, np.where(top == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 60
    h = np.where(d == 0, 0, h % 360) / 2
    return np.stack([np.rint(h) % 180, to_u8(np.where(top == 0, 0, d / np.where(top == 0, 1, top) * 255)), top], axis=2).astype(np.uint8)


def hsv_to_bgr(x: np.ndarray) -> np.ndarray:
    h, s, v = x[..., 0] / 30.0, x[..., 1] / 255.0, x[..., 2].astype(np.float64)
    sector, f = np.floor(h).astype(int) % 6, h - np.floor(h)
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    r, g, b = (np.choose(sector, c) for c in ((v, q, p, p, t, v), (t, v, v, q, p, p), (p, p, t, v, v, q)))
    return to_u8(np.stack([b, g, r], axis=2))


def contrast(x: np.ndarray, alpha: float = 1.5, beta: float = 10) -> np.ndarray:
    return to_u8(np.abs(alpha * x.astype(np.float64) + beta))


def gamma_table(gamma: float) -> np.ndarray:
    return (np.power(np.arange(256) / 255.0, 1.0 / gamma) * 255).astype(np.uint8)


def apply_gamma(x: np.ndarray, gamma: float = 1.0) -> np.ndarray:
    return x if abs(gamma - 1.0) < 1e-3 else gamma_table(gamma)[x]


def saturate(bgr: np.ndarray, factor: float = 1.2) -> np.ndarray:
    hsv = bgr_to_hsv(bgr)
    hsv[..., 1] = np.clip(hsv[..., 1] * float(factor), 0, 255).astype(np.uint8)
    return hsv_to_bgr(hsv)


def minmax(x: np.ndarray) -> np.ndarray:
    """Stretched to 0..255, truncated; a flat raster is 0."""
    low, high = float(x.min()), float(x.max())
    return np.zeros(x.shape, np.uint8) if high == low else ((x - low) * (255.0 / (high - low)) + 1e-9).astype(np.uint8)


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.clip(a.astype(int) - b, 0, 255).astype(np.uint8)


def weighted(a: np.ndarray, wa: float, b: np.ndarray, wb: float) -> np.ndarray:
    return to_u8(a * float(wa) + b * float(wb))


def jet(x: np.ndarray) -> np.ndarray:
    """The blue-to-red colour map, piecewise linear."""
    v = x / 255.0 * 4
    return to_u8(np.stack([np.clip(np.minimum(v - k + 1.5, k + 1.5 - v), 0, 1) * 255 for k in (1, 2, 3)], axis=-1))


def tint(bgr: np.ndarray, mask: np.ndarray, color=(0, 255, 0), share: float = 0.7) -> np.ndarray:
    out = to_bgr(bgr).copy()
    at = mask > 0
    out[at] = ((1 - share) * out[at] + np.array(color) * share).astype(np.uint8)
    return out


def resize(x: np.ndarray, height: int, width: int, nearest: bool = False) -> np.ndarray:
    h, w = x.shape[:2]
    if nearest:
        return x[np.minimum(np.arange(height) * h // height, h - 1)][:, np.minimum(np.arange(width) * w // width, w - 1)]
    y, z = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in ((height, h), (width, w)))
    y0, z0 = y.astype(int), z.astype(int)
    y1, z1 = np.minimum(y0 + 1, h - 1), np.minimum(z0 + 1, w - 1)
    shape = (-1, 1) + (1,) * (x.ndim - 2)
    fy, fz = (y - y0).reshape((-1, 1) + (1,) * (x.ndim - 2)), (z - z0).reshape((1,) + shape[:1] + (1,) * (x.ndim - 2))
    x = x.astype(np.float64)
    top, low = (x[a][:, z0] * (1 - fz) + x[a][:, z1] * fz for a in (y0, y1))
    return to_u8(top * (1 - fy) + low * fy)


def beside(images: list[np.ndarray], gap: int = 0) -> np.ndarray:
    """Colour rasters side by side, padded with white to one height."""
    images = [to_bgr(x) for x in images]
    h = max(x.shape[0] for x in images)
    pad = [np.pad(x, ((0, h - x.shape[0]), (0, gap), (0, 0)), constant_values=255) for x in images]
    return np.concatenate(pad, axis=1)


def stacked(images: list[np.ndarray]) -> np.ndarray:
    """Colour rasters on top of each other, padded with white to one width."""
    images = [to_bgr(x) for x in images]
    w = max(x.shape[1] for x in images)
    return np.concatenate([np.pad(x, ((0, 0), (0, w - x.shape[1]), (0, 0)), constant_values=255) for x in images])


# ---- thresholds -------------------------------------------------------------------------------------------------


def otsu(x: np.ndarray) -> int:
    """The first threshold with the largest between-class variance; class 0 is v <= threshold."""
    n = np.bincount(x.reshape(-1), minlength=256).astype(np.float64)
    below, sums = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    ok = (below > 0) & (above > 0)
    gap = sums[-1] * below - below[-1] * sums
    score = np.where(ok, gap * gap / np.where(ok, below * above, 1), -1.0)
    return int(np.argmax(score)) if ok.any() else 0


def ink_otsu(x: np.ndarray) -> np.ndarray:
    return np.where(x <= otsu(x), 255, 0).astype(np.uint8)


def bright_otsu(x: np.ndarray) -> np.ndarray:
    return np.where(x > otsu(x), 255, 0).astype(np.uint8)


def _window_sums(x: np.ndarray, block: int, mode: str) -> np.ndarray:
    r = block // 2
    p = np.pad(x.astype(np.int64), r, mode=mode)
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return s[block:, block:] - s[:-block, block:] - s[block:, :-block] + s[:-block, :-block]


def ink_adaptive(x: np.ndarray, block: int = 31, c: int = 3) -> np.ndarray:
    """Ink where v <= local mean - c, compared exactly; an even block grows by one."""
    block += 1 - block % 2
    return np.where((x.astype(np.int64) + c) * block * block <= _window_sums(x, block, "edge"), 255, 0).astype(np.uint8)


def bright_adaptive(x: np.ndarray, block: int = 21, c: int = 5) -> np.ndarray:
    """Bright where v > Gaussian local mean - c."""
    mean = to_u8(separable(x, gaussian_weights(block), mode="edge"))
    return np.where(x.astype(int) > mean.astype(int) - c, 255, 0).astype(np.uint8)


def auto_invert(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    on = mask > 0
    fg = x[on].mean() if on.any() else 255
    bg = x[~on].mean() if not on.all() else 0
    return 255 - mask if fg < bg else mask


def polarity(x: np.ndarray, mask: np.ndarray, invert: str) -> np.ndarray:
    return 255 - mask if invert == "true" else auto_invert(x, mask) if invert == "auto" else mask


def cascade(x: np.ndarray, method: str = "auto", invert: str = "auto", low: float = 0.02, high: float = 0.98) -> np.ndarray:
    """Otsu; where that fills too little or too much adaptive; where that does, closed edges."""
    steps = {
        "otsu": lambda: polarity(x, bright_otsu(x), invert),
        "adaptive": lambda: polarity(x, bright_adaptive(x), invert),
        "canny": lambda: close(canny_median(x, 0.66, 1.33), ellipse(5), 2),
    }
    if method != "auto":
        if method not in steps:
            raise ValueError(f"unknown method: {method}")
        return steps[method]()
    for name in ("otsu", "adaptive"):
        mask = steps[name]()
        if low <= (mask > 0).mean() <= high:
            return mask
    return steps["canny"]()


# ---- filters ----------------------------------------------------------------------------------------------------


def gaussian_weights(size: int, sigma: float = 0.0) -> np.ndarray:
    sigma = sigma if sigma > 0 else 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = np.exp(-((np.arange(size) - (size - 1) / 2) ** 2) / (2 * sigma * sigma))
    return w / w.sum()


def separable(x: np.ndarray, weights: np.ndarray, mode: str = "reflect") -> np.ndarray:
    r = len(weights) // 2
    out = x.astype(np.float64)
    for axis in range(2):
        pad = [(r, r) if k == axis else (0, 0) for k in range(out.ndim)]
        p = np.pad(out, pad, mode=mode if out.shape[axis] > 1 else "edge")
        n = out.shape[axis]
        out = sum(w * p.take(range(k, k + n), axis=axis) for k, w in enumerate(weights))
    return out


def gaussian(x: np.ndarray, size: int = 5, sigma: float = 0.0) -> np.ndarray:
    if size <= 0:
        size = int(round(sigma * 6 + 1)) | 1
    return to_u8(separable(x, gaussian_weights(size, sigma)))


def bilateral(x: np.ndarray, d: int = 5, sigma_color: float = 30, sigma_space: float = 15) -> np.ndarray:
    r, total, norm = d // 2, 0.0, 0.0
    p = np.pad(x.astype(np.float64), r, mode="reflect" if min(x.shape) > r else "edge")
    h, w = x.shape
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dy * dy + dx * dx > r * r:
                continue
            v = p[r + dy : r + dy + h, r + dx : r + dx + w]
            k = np.exp(-(dy * dy + dx * dx) / (2 * sigma_space**2) - (v - x) ** 2 / (2 * sigma_color**2))
            total, norm = total + k * v, norm + k
    return to_u8(total / norm)


def _stencil(x: np.ndarray, offsets: dict[tuple[int, int], int]) -> np.ndarray:
    p, (h, w) = np.pad(x.astype(np.int64), 1, mode="reflect" if min(x.shape) > 1 else "edge"), x.shape
    return sum(k * p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for (dy, dx), k in offsets.items())


def sobel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gx = _stencil(x, {(-1, -1): -1, (-1, 1): 1, (0, -1): -2, (0, 1): 2, (1, -1): -1, (1, 1): 1})
    gy = _stencil(x, {(-1, -1): -1, (1, -1): 1, (-1, 0): -2, (1, 0): 2, (-1, 1): -1, (1, 1): 1})
    return gx, gy


def laplacian(x: np.ndarray) -> np.ndarray:
    return _stencil(x, {(-1, -1): 2, (-1, 1): 2, (1, -1): 2, (1, 1): 2, (0, 0): -8})


def _edge_mask(size: np.ndarray, threshold: str | float) -> np.ndarray:
    m = minmax(size)
    return bright_otsu(m) if threshold == "auto" else np.where(m > float(threshold), 255, 0).astype(np.uint8)


def sobel_edges(x: np.ndarray, threshold: str | float = "auto") -> np.ndarray:
    gx, gy = sobel(x)
    return _edge_mask(np.sqrt((gx * gx + gy * gy).astype(np.float64)), threshold)


def laplacian_edges(x: np.ndarray, threshold: str | float = "auto") -> np.ndarray:
    return _edge_mask(np.abs(laplacian(x)).astype(np.float64), threshold)


def canny(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """L1 gradient, non-maximum suppression in four directions, hysteresis by components."""
    gx, gy = sobel(x)
    m = np.abs(gx) + np.abs(gy)
    p, (h, w) = np.pad(m, 1), x.shape
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    ax, ay = np.abs(gx), np.abs(gy)
    flat, steep = ay <= ax * math.tan(math.pi / 8), ay >= ax * math.tan(3 * math.pi / 8)
    same = (gx >= 0) == (gy >= 0)
    before = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(same, at(-1, -1), at(-1, 1))))
    after = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(same, at(1, 1), at(1, -1))))
    peak = (m > before) & (m >= after) & (m > low)
    labels, stats = components(peak)
    strong = np.zeros(len(stats) + 1, bool)
    strong[labels[peak & (m > high)]] = True
    strong[0] = False
    return np.where(strong[labels], 255, 0).astype(np.uint8)


def canny_median(x: np.ndarray, low: float, high: float) -> np.ndarray:
    v = float(np.median(x))
    return canny(x, max(0.0, low * v), min(255.0, high * v))


def texture_edges(bgr: np.ndarray, method: str = "fusion", sigma: float = 0.33, threshold: str | float = "auto", close_k: int = 3, blur_k: int = 3) -> np.ndarray:
    x = gray(bgr)
    if blur_k > 1:
        x = gaussian(x, blur_k)
    by_canny = lambda: canny_median(x, 1 - sigma, 1 + sigma)
    if method == "sobel":
        e = sobel_edges(x, threshold)
    elif method == "laplacian":
        e = laplacian_edges(x, threshold)
    elif method == "fusion":
        e = by_canny() | sobel_edges(x, threshold) | laplacian_edges(x, threshold)
    else:
        e = by_canny()
    if close_k > 1:
        e = close(e, ellipse(close_k))
    return np.where(e > 0, 255, 0).astype(np.uint8)


def clahe(x: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation; clipped counts are spread evenly over all bins."""
    h, w = x.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(x, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric")
    cells = p.reshape(tiles, th, tiles, tw).transpose(0, 2, 1, 3).reshape(tiles * tiles, -1)
    hist = np.zeros((tiles * tiles, 256))
    np.add.at(hist, (np.repeat(np.arange(tiles * tiles), th * tw), cells.reshape(-1)), 1)
    limit = max(1, int(clip * th * tw / 256)) if clip > 0 else th * tw
    over = np.maximum(hist - limit, 0).sum(axis=1, keepdims=True)
    hist = np.minimum(hist, limit) + over / 256
    table = to_u8(hist.cumsum(axis=1) * (255.0 / (th * tw))).reshape(tiles, tiles, 256).astype(np.float64)
    y, z = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, z0 = np.floor(y).astype(int), np.floor(z).astype(int)
    fy, fz = (y - y0)[:, None], (z - z0)[None, :]
    ya, yb, za, zb = (np.clip(v, 0, tiles - 1) for v in (y0, y0 + 1, z0, z0 + 1))
    pick = lambda a, b: table[a[:, None], b[None, :], x]
    return to_u8((pick(ya, za) * (1 - fz) + pick(ya, zb) * fz) * (1 - fy) + (pick(yb, za) * (1 - fz) + pick(yb, zb) * fz) * fy)


def enhance(bgr: np.ndarray, on: bool = True, clip: float = 4.0, tiles: int = 8, factor: float = 1.2, gamma: float = 1.0) -> np.ndarray:
    if not on:
        return bgr
    ycc = bgr_to_ycrcb(bgr)
    ycc[..., 0] = clahe(ycc[..., 0], clip, tiles)
    return apply_gamma(saturate(ycrcb_to_bgr(ycc), factor), gamma)


# ---- morphology -------------------------------------------------------------------------------------------------


def ellipse(size: int) -> np.ndarray:
    r = size // 2
    if r == 0:
        return np.ones((1, 1), bool)
    y = np.arange(size) - r
    half = np.rint(r * np.sqrt(np.maximum(r * r - y * y, 0) / (r * r))).astype(int)
    return np.abs(np.arange(size) - r)[None, :] <= half[:, None]


def element(size: int, kind: str = "iso") -> np.ndarray:
    """iso (ellipse), h, v, d1, d2, rect, cross; odd sizes; other kinds are ellipses."""
    size = max(1, int(size)) | 1
    if kind == "h":
        return np.ones((1, size), bool)
    if kind == "v":
        return np.ones((size, 1), bool)
    if kind == "d1":
        return np.eye(size, dtype=bool)
    if kind == "d2":
        return np.eye(size, dtype=bool)[:, ::-1]
    if kind == "rect":
        return np.ones((size, size), bool)
    if kind == "cross":
        k = np.zeros((size, size), bool)
        k[size // 2] = k[:, size // 2] = True
        return k
    return ellipse(size)


def _extreme(x: np.ndarray, shape: np.ndarray, least: bool) -> np.ndarray:
    ry, rx = shape.shape[0] // 2, shape.shape[1] // 2
    p = np.pad(x, ((ry, ry), (rx, rx)), constant_values=255 if least else 0)
    h, w = x.shape
    parts = (p[dy : dy + h, dx : dx + w] for dy, dx in zip(*np.nonzero(shape), strict=True))
    out = next(parts).copy()
    for part in parts:
        (np.minimum if least else np.maximum)(out, part, out=out)
    return out


def erode(x: np.ndarray, shape: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        x = _extreme(x, shape, True)
    return x


def dilate(x: np.ndarray, shape: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        x = _extreme(x, shape[::-1, ::-1], False)
    return x


def close(x: np.ndarray, shape: np.ndarray, times: int = 1) -> np.ndarray:
    return erode(dilate(x, shape, times), shape, times)


def open_(x: np.ndarray, shape: np.ndarray, times: int = 1) -> np.ndarray:
    return dilate(erode(x, shape, times), shape, times)


def blackhat(x: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return subtract(close(x, shape), x)


def heal(x: np.ndarray, kernel: int = 3, times: int = 1, directions=("iso", "h", "v"), smooth: bool = False) -> np.ndarray:
    """Close gaps in dark strokes, one direction after the other."""
    out = 255 - (bilateral(x, 5, 30, 15) if smooth else x)
    for d in directions:
        out = close(out, element(kernel, d), times)
    return 255 - out


def cleanup(mask: np.ndarray, close_k: int = 7, open_k: int = 5, close_times: int = 2, open_times: int = 1) -> np.ndarray:
    return open_(close(mask, ellipse(close_k), close_times), ellipse(open_k), open_times)


def keep_ink(x: np.ndarray, kernel: int = 9, strength: float = 0.6, unsharp: float = 0.2) -> np.ndarray:
    """Darken strokes by their black-hat, then sharpen."""
    out = subtract(x, to_u8(blackhat(x, element(kernel, "rect")) * strength))
    return weighted(out, 1 + unsharp, gaussian(out, 0, 1.0), -unsharp) if unsharp > 1e-6 else out


# ---- components -------------------------------------------------------------------------------------------------


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-connected labels from 1 in the order of their first pixels, and (x, y, w, h, area) of each.

    Works on runs of each row: neighbouring rows' runs that touch are joined, labels then halve their paths."""
    h, w = mask.shape
    on = np.pad(mask > 0, ((0, 0), (1, 1))).astype(np.int8)
    edge = np.diff(on, axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    n = len(row)
    if not n:
        return np.zeros((h, w), np.int32), np.zeros((0, 5), np.int64)
    # runs as sorted numbers of a line in which each row has w + 2 places
    wide = w + 2
    lo, hi = row * wide + start, row * wide + end
    first = np.searchsorted(hi, lo - wide, side="left")  # ends at or after this run's start, a row above
    last = np.searchsorted(lo, hi - wide, side="right")
    count = np.maximum(last - first, 0)
    a = np.repeat(np.arange(n), count)
    b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    ok = row[b] == row[a] - 1
    a, b = a[ok], b[ok]
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    roots, label = np.unique(label, return_inverse=True)
    k = len(roots)
    x0, x1, y0, y1, area = np.full(k, w), np.zeros(k, int), np.full(k, h), np.zeros(k, int), np.zeros(k, int)
    np.minimum.at(x0, label, start)
    np.maximum.at(x1, label, end)
    np.minimum.at(y0, label, row)
    np.maximum.at(y1, label, row + 1)
    np.add.at(area, label, end - start)
    flat = np.zeros(h * w + 1, np.int64)
    np.add.at(flat, row * w + start, label + 1)
    np.add.at(flat, row * w + end, -(label + 1))
    return flat.cumsum()[:-1].reshape(h, w).astype(np.int32), np.stack([x0, y0, x1 - x0, y1 - y0, area], axis=1)


def biggest(mask: np.ndarray) -> np.ndarray:
    labels, stats = components(mask)
    return np.where(labels == 1 + int(np.argmax(stats[:, 4])), 255, 0).astype(np.uint8) if len(stats) else mask


def select(labels: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The pixels of the kept components."""
    return np.where(np.concatenate([[False], keep])[labels], 255, 0).astype(np.uint8)


def local_background(x: np.ndarray, part: np.ndarray, radius: int = 5) -> int:
    """The truncated median of the ring around a component, of its surroundings if it has none."""
    ys, xs = np.nonzero(part)
    if not len(ys):
        return 240
    y0, y1, x0, x1 = max(0, ys.min() - radius), ys.max() + radius + 1, max(0, xs.min() - radius), xs.max() + radius + 1
    view, own = x[y0:y1, x0:x1], part[y0:y1, x0:x1]
    ring = (dilate(own.astype(np.uint8), ellipse(2 * radius + 1)) > 0) & ~own
    return int(np.median(view[ring] if ring.any() else view))


def fill_components(x: np.ndarray, labels: np.ndarray, which: np.ndarray, radius: int = 5) -> np.ndarray:
    """Components (numbers from 1) painted with their local background, all estimated on the raster as it came."""
    out = x.copy()
    for k in which:
        part = labels == k
        out[part] = local_background(x, part, radius)
    return out


# ---- profiles ---------------------------------------------------------------------------------------------------


def coverage(mask: np.ndarray, axis: int) -> np.ndarray:
    """Share of ink of each column (axis 0) or row (1), single precision."""
    n = max(1, mask.shape[axis])
    return ((mask > 0).sum(axis=axis) * 255).astype(np.float32) / np.float32(n * 255.0)


def runs(cover: np.ndarray, least: float, closed: bool = False) -> np.ndarray:
    """(start, end) of maximal stretches above `least` (at least it, if closed)."""
    on = np.concatenate([[0], (cover >= least if closed else cover > least).astype(np.int8), [0]])
    return np.stack([np.flatnonzero(np.diff(on) == 1), np.flatnonzero(np.diff(on) == -1)], axis=1)


# ---- distances and skeletons ------------------------------------------------------------------------------------


def distance(mask: np.ndarray, straight: float = 0.955, diagonal: float = 1.3693) -> np.ndarray:
    """Chamfer distance to the nearest blank pixel in a 3 x 3 neighbourhood; outside does not count."""
    d = np.where(mask > 0, np.inf, 0.0)
    for _ in range(d.shape[0] + d.shape[1]):
        p = np.pad(d, 1, constant_values=np.inf)
        h, w = d.shape
        steps = [p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] + (diagonal if dy and dx else straight) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
        new = np.minimum(d, np.minimum.reduce(steps))
        if (new == d).all():
            break
        d = new
    return d.astype(np.float32)


def skeleton(mask: np.ndarray) -> np.ndarray:
    """What openings by a cross take from each erosion; stops when an erosion changes nothing."""
    out, cross, x = np.zeros(mask.shape, np.uint8), element(3, "cross"), np.where(mask > 0, 255, 0).astype(np.uint8)
    while x.any():
        small = erode(x, cross)
        out |= subtract(x, dilate(small, cross))
        if (small == x).all():
            break
        x = small
    return out


def weak_points(mask: np.ndarray, least_width: float = 2, ratio: float = 0.3, reach: int = 5) -> list[tuple[int, int, float]]:
    """Skeleton junctions that are thin, and thin for their surroundings."""
    s, d = skeleton(mask) > 0, distance(mask)
    p, (h, w) = np.pad(s, 1).astype(int), s.shape
    near = sum(p[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)) - s
    out = []
    for y, x in zip(*np.nonzero(s & (near >= 3)), strict=True):
        region = d[max(0, y - reach) : y + reach + 1, max(0, x - reach) : x + reach + 1]
        if d[y, x] < least_width and d[y, x] < region[region > 0].mean() * ratio:
            out.append((int(y), int(x), float(d[y, x])))
    return out


def break_weak(mask: np.ndarray, least_width: float = 2, ratio: float = 0.3, least_area: int = 10) -> np.ndarray:
    """Cut discs at weak points where all parts that are left are large enough."""
    out = np.where(mask > 0, 255, 0).astype(np.uint8)
    ys, xs = np.ogrid[: mask.shape[0], : mask.shape[1]]
    for y, x, thick in weak_points(mask, least_width, ratio):
        r = max(1, int(thick + 1))
        trial = np.where((ys - y) ** 2 + (xs - x) ** 2 <= r * r, 0, out).astype(np.uint8)
        areas = components(trial)[1][:, 4]
        if len(areas) and (areas >= least_area).all():
            out = trial
    return out


# ---- contours ---------------------------------------------------------------------------------------------------

#: Clockwise neighbours in image coordinates (dx, dy), from the right.
AROUND = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def _follow(f: np.ndarray, y: int, x: int, toward: int, mark: int) -> list[tuple[int, int]]:
    """One border of the padded label raster `f` from (y, x); `toward` is the direction of the blank neighbour."""
    first = next((d % 8 for d in range(toward, toward + 8) if f[y + AROUND[d % 8][1], x + AROUND[d % 8][0]]), None)
    if first is None:
        f[y, x] = -mark
        return [(x - 1, y - 1)]
    points, cy, cx, back = [], y, x, first
    while True:
        points.append((cx - 1, cy - 1))
        crossed = False
        for k in range(1, 9):
            d = (back - k) % 8
            if f[cy + AROUND[d][1], cx + AROUND[d][0]]:
                break
            crossed |= d == 0
        if crossed:
            f[cy, cx] = -mark
        elif f[cy, cx] == 1:
            f[cy, cx] = mark
        ny, nx = cy + AROUND[d][1], cx + AROUND[d][0]
        if (ny, nx) == (y, x) and (cy, cx) == (y + AROUND[first][1], x + AROUND[first][0]):
            return points
        cy, cx, back = ny, nx, (d + 4) % 8


def borders(mask: np.ndarray, external: bool = True) -> list[tuple[list[tuple[int, int]], bool]]:
    """(points, is hole) of all borders, by border following; only outermost ones if external."""
    f = np.pad((mask > 0).astype(np.int64), 1)
    if external:
        # holes have no part in outer borders: what the outside does not reach is filled
        blank, _ = _components4(f == 0)
        f = (blank != blank[0, 0]).astype(np.int64)
    out, mark = [], 1
    for y in range(1, f.shape[0] - 1):
        for x in np.flatnonzero(f[y, 1:-1]) + 1:
            if f[y, x] == 1 and f[y, x - 1] == 0:
                mark += 1
                out.append((_follow(f, y, x, 4, mark), False))
            elif f[y, x] >= 1 and f[y, x + 1] == 0:
                mark += 1
                out.append((_follow(f, y, x, 0, mark), True))
    return out


def _components4(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """4-connected labels, spread until they settle row by row and column by column."""
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape) + 1, 0)
    while True:
        new = label
        for axis in (0, 1):
            x = np.moveaxis(new, axis, 1)
            gate = x > 0
            group = np.cumsum(np.pad(~gate[:, 1:] | ~gate[:, :-1], ((0, 0), (1, 0)), constant_values=True), axis=1) + np.arange(len(x))[:, None] * (x.shape[1] + 1)
            low = np.full(group.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, group[gate], x[gate])
            new = np.moveaxis(np.where(gate, low[group], 0), 1, axis)
        if (new == label).all():
            return label, int((np.unique(label) > 0).sum())
        label = new


def area(points) -> float:
    p = np.asarray(points, np.float64)
    x, y = p[:, 0], p[:, 1]
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def perimeter(points) -> float:
    p = np.asarray(points, np.float64)
    return float(np.hypot(*(np.roll(p, -1, axis=0) - p).T).sum())


def chain(points: list, kind: str = "none", reach: int = 7) -> list:
    """none: all points; simple: ends of straight stretches; tc89, tc89_l1: dominant points by curvature over a
    region of support (Teh and Chin), cosine or L1."""
    n = len(points)
    if kind == "none" or n < 3:
        return points
    p = np.asarray(points)
    turn = ((np.roll(p, -1, 0) - p) != (p - np.roll(p, 1, 0))).any(axis=1)
    if kind == "simple":
        return [points[i] for i in np.flatnonzero(turn)] or points[:1]
    curve = np.zeros(n)
    for i in np.flatnonzero(turn):
        best = None
        for k in range(1, min(reach, (n - 1) // 2) + 1):
            a, b = p[(i - k) % n], p[(i + k) % n]
            chord = math.hypot(*(b - a))
            off = abs((b - a)[0] * (a - p[i])[1] - (b - a)[1] * (a - p[i])[0])
            ratio = off / (chord * chord) if chord else math.inf
            if best is not None and ratio <= best:
                break
            best = ratio
            u, v = p[i] - a, b - p[i]
            curve[i] = np.abs(v / k - u / k).sum() if kind == "tc89_l1" else 1 - float(u @ v) / max(1e-12, math.hypot(*u) * math.hypot(*v))
    strong = [i for i in range(n) if curve[i] > 0 and curve[i] >= max(curve[i - 1], curve[(i + 1) % n])]
    return [points[i] for i in strong] or points[:1]


def simplify(points: list, ratio: float) -> list:
    """Douglas and Peucker on a closed curve, cut at its first point and the farthest from it."""
    n, eps = len(points), ratio * perimeter(points)
    if n < 3 or eps <= 0:
        return points
    p = np.asarray(points, np.float64)
    far = int(np.argmax(((p - p[0]) ** 2).sum(axis=1)))
    ring, keep, todo = np.vstack([p, p[:1]]), {0, far}, [(0, far), (far, n)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, d = ring[i], ring[j] - ring[i]
        length = math.hypot(*d)
        off = ring[i + 1 : j] - a
        gap = np.abs(d[0] * off[:, 1] - d[1] * off[:, 0]) / length if length else np.hypot(*off.T)
        k = int(np.argmax(gap))
        if gap[k] > eps:
            keep.add(i + 1 + k)
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return [points[i] for i in sorted(keep)]


def hull(points) -> list:
    """Convex hull, counter-clockwise in x-right, y-down coordinates from the smallest point."""
    pts = sorted(set(map(tuple, points)))
    if len(pts) < 3:
        return pts

    def half(some):
        out = []
        for q in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def draw(image: np.ndarray, points, color=(0, 255, 0), thickness: int = 2) -> np.ndarray:
    """A closed polyline of square pens on a copy of the image."""
    out, r = to_bgr(image).copy(), thickness // 2
    p = [*points, points[0]]
    for (x0, y0), (x1, y1) in zip(p, p[1:], strict=False):
        n = int(max(abs(x1 - x0), abs(y1 - y0))) + 1
        for x, y in zip(np.rint(np.linspace(x0, x1, n)).astype(int), np.rint(np.linspace(y0, y1, n)).astype(int), strict=True):
            out[max(0, y - r) : y - r + max(1, thickness), max(0, x - r) : x - r + max(1, thickness)] = color
    return out
