"""Refining one character's raster: component tiers, noise, projection trims, border spikes, crops."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np

from ..config import Border, ComponentFilter, Noise, Settings, Trim
from . import kernels as K

# ---- components -------------------------------------------------------------------------------------------------


def tiers(stats: np.ndarray, width: int, height: int, how: ComponentFilter) -> tuple[np.ndarray, np.ndarray]:
    """0 border touch, 1 edge zone, 2 interior for each component, and whether it goes."""
    x, y, w, h, area = stats.T
    least = np.maximum(1, (np.array([how.touch_ratio, how.zone_ratio, how.interior_ratio]) * (width * height)).astype(int))
    within = lambda m: (x <= m) | (y <= m) | (x + w >= width - m) | (y + h >= height - m)
    tier = np.where(within(how.touch_margin), 0, np.where(within(how.zone_margin), 1, 2))
    odd = (np.maximum(w / np.maximum(1, h), h / np.maximum(1, w)) >= how.max_aspect) | (np.minimum(w, h) <= how.min_dim)
    return tier, (area < least[tier]) | ((tier < 2) & odd)


def filter_components(mask: np.ndarray, how: ComponentFilter) -> np.ndarray:
    labels, stats = K.components(mask)
    return K.select(labels, ~tiers(stats, mask.shape[1], mask.shape[0], how)[1]) if len(stats) else mask


# ---- noise ------------------------------------------------------------------------------------------------------


def is_noise(stats: np.ndarray, how: Noise) -> np.ndarray:
    """Components of the light band to paint over: large ones, and small slender ones."""
    w, h, area = stats[:, 2], stats[:, 3], stats[:, 4]
    slender = (np.maximum(w, h) / np.maximum(np.minimum(w, h), 1) > how.max_aspect) & (area < how.slender_area)
    return (area >= how.least_area) & (area <= how.most_area) & ((area > how.large_area) | slender)


def remove_noise(x: np.ndarray, how: Noise) -> np.ndarray:
    labels, stats = K.components((x > how.dark) & (x < how.light))
    return K.fill_components(x, labels, 1 + np.flatnonzero(is_noise(stats, how))) if len(stats) else x


def remove_noise_dual(x: np.ndarray, strict: float = 0.7, loose: float = 1.2, least: int = 5, most: float = 0.1, verify: bool = True) -> np.ndarray:
    """Components between two multiples of Otsu's threshold."""
    t = K.otsu(x)
    labels, stats = K.components((x <= int(t * loose)) & (x > int(t * strict)))
    which = [k for k in range(1, len(stats) + 1) if least <= stats[k - 1, 4] <= int(x.size * most) and (not verify or _noise_shape(x, labels == k, stats[k - 1]))]
    return K.fill_components(x, labels, which)


def _noise_shape(x: np.ndarray, part: np.ndarray, stat: np.ndarray, least_compact: float = 0.1) -> bool:
    w, h, area = stat[2:]
    if max(w, h) / max(min(w, h), 1) > 8:
        return True
    rim = int((K.canny(part.astype(np.uint8) * 255, 50, 150) > 0).sum())
    compact = 4 * np.pi * area / max(rim * rim, 1) if rim else 0
    return bool(compact < least_compact or (x[part].mean() > 180 and x[part].std() < 20))


def remove_noise_band(x: np.ndarray, band: tuple[int, int] = (150, 220), least: int = 5) -> np.ndarray:
    """All components of a gray band that are large enough."""
    labels, stats = K.components((x >= band[0]) & (x <= band[1]))
    return K.fill_components(x, labels, 1 + np.flatnonzero(stats[:, 4] >= least))


def remove_noise_hybrid(x: np.ndarray) -> np.ndarray:
    return remove_noise_band(remove_noise_dual(x))


# ---- projection trims -------------------------------------------------------------------------------------------


def _inner_runs(runs: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Start of the first run that ends after `low` and end of the last that starts before `high`; where all runs
    are in a margin, the last run stands for either."""
    head, tail = np.flatnonzero(runs[:, 1] > low), np.flatnonzero(runs[:, 0] < high)
    return int(runs[head[0] if len(head) else -1, 0]), int(runs[tail[-1] if len(tail) else -1, 1])


def _tighten(cover: np.ndarray, left: int, right: int, level: float) -> tuple[int, int]:
    """Move both ends over coverage up to `level`, and keep at least one place."""
    n, full = len(cover), np.flatnonzero(cover > level)
    after, before = full[full >= left], full[full < right]
    left = int(after[0]) if len(after) else max(left, n)
    right = int(before[-1]) + 1 if len(before) else min(right, 0)
    left = max(0, min(n - 1, left))
    return left, max(left + 1, min(n, right))


def trim_axis(mask: np.ndarray, axis: int, how: Trim) -> tuple[int, int]:
    """(low, high) of the columns (axis 0) or rows (1) to keep."""
    cover = K.coverage(mask, axis)
    n, top = len(cover), float(cover.max(initial=0))
    if top <= 0:
        return 0, n
    detect, cut = (x[2 * axis : 2 * axis + 2] for x in (how.detect, how.cut))
    found = K.runs(cover, max(how.run_least, how.run_ratio * top))
    if not len(found):
        limit = [n if c <= 0 else round(n * min(c, 1.0)) for c in cut]
        left, right = min(limit[0], n), max(min(limit[0], n) + 1, n - limit[1])
        return max(0, min(n - 1, left)), min(n, max(left + 1, right))
    low, high = (round(n * min(d, 1.0)) for d in detect)
    inner = _inner_runs(found, low, max(0, n - high))
    first, last = int(found[0, 0]), int(found[-1, 1])
    left, right = min(inner[0], first + int((last - first) * cut[0])), max(last - int((last - first) * cut[1]), inner[1])
    return _tighten(cover, left, right, how.tighten)


def trim_box(mask: np.ndarray, how: Trim) -> tuple[int, int, int, int]:
    """(left, right, top, bottom): columns first, then the rows of what they leave."""
    h, w = mask.shape
    if not h or not w:
        return 0, w, 0, h
    left, right = trim_axis(mask, 0, how)
    return left, right, *trim_axis(mask[:, left:right], 1, how)


def binarize(x: np.ndarray, how: Trim) -> np.ndarray:
    return K.ink_adaptive(x, how.adaptive_block, how.adaptive_c) if how.binarize == "adaptive" else K.ink_otsu(x)


def trim_gray(x: np.ndarray, how: Trim) -> tuple[int, int, int, int]:
    return trim_box(binarize(x, how), how) if x.size else (0, x.shape[1], 0, x.shape[0])


def primary_run(cover: np.ndarray, found: np.ndarray, mass_ratio: float = 0.5, length_ratio: float = 0.3, tighten: float = 0.01) -> tuple[int, int]:
    """The heaviest run, or the longest where the heaviest is light or short, without blank ends."""
    n = len(cover)
    if not len(found):
        return 0, n
    mass, size = np.array([cover[a:b].sum() for a, b in found]), found[:, 1] - found[:, 0]
    k = int(np.argmax(mass))
    if mass[k] < mass.sum() * mass_ratio or size[k] < n * length_ratio:
        k = int(np.argmax(size))
    a, b = (int(v) for v in found[k])
    full = np.flatnonzero(cover[a:b] > tighten)
    a, b = (a + int(full[0]), a + int(full[-1]) + 1) if len(full) else (b, b)
    a = max(0, min(n - 1, a))
    return a, max(a + 1, min(n, b))


# ---- borders ----------------------------------------------------------------------------------------------------


def spikes(cover: np.ndarray, top: float, width: int, how: Border) -> list[dict]:
    """The runs of a profile that begins at the outer edge, each with what decides whether it is a border. Profiles of
    whole numbers are compared exactly, by fractions."""
    whole = cover.dtype.kind in "iu"
    share = (lambda p: Fraction(str(p))) if whole else float
    mean_of = (lambda x: Fraction(int(x.sum()), len(x))) if whole else (lambda x: float(x.mean()))
    shortest = max(1, int(width * how.spike_least))
    longest = max(shortest, int(width * how.spike_most))
    least = top * share(how.threshold)
    out = []
    for start, end in K.runs(cover, math.ceil(least) if whole else least, closed=True):
        if end == len(cover):
            continue  # it does not end within the margin
        size = int(end - start)
        mean, after = mean_of(cover[start:end]), mean_of(cover[end : end + size])
        drop = mean - after
        ok = start <= how.tolerance and shortest <= size <= longest and drop >= top * share(how.gradient) and drop >= mean * share(how.prominence)
        out.append({"start": int(start), "end": int(end), "mean": float(mean), "after": float(after), "drop": float(drop), "border": bool(ok)})
    return out


def _longest(found: list[dict]) -> dict | None:
    return max((s for s in found if s["border"]), key=lambda s: s["end"] - s["start"], default=None)


def border_cuts(mask: np.ndarray, how: Border) -> tuple[int, int]:
    """Columns to cut at the left and at the right, one pass."""
    h, w = mask.shape
    cover = K.coverage(mask, 0) if h and w else np.zeros(0, np.float32)
    top, margin = float(cover.max(initial=0)), int(w * how.width_ratio)
    if top <= 0:
        return 0, 0
    left = _longest(spikes(cover[:margin], top, w, how))
    # a margin of no columns makes the right side the whole profile
    right = _longest(spikes(cover[-margin:][::-1], top, w, how))
    outer = 0 if right is None else right["start"] + 1 if how.right_cut == "outermost" else right["end"]
    return (left["end"] if left else 0), outer


def vertical_bounds(mask: np.ndarray, how: Border) -> tuple[int, int]:
    h, w = mask.shape
    if not h or not w:
        return 0, h
    cover = K.coverage(mask, 1)
    top = float(cover.max())
    found = K.runs(cover, max(0.001, 0.01 * top)) if top > 0 else np.zeros((0, 2), int)
    if not len(found):
        return 0, h
    inner = _inner_runs(found, int(h * how.detect[0]), max(0, h - int(h * how.detect[1])))
    first, last = int(found[0, 0]), int(found[-1, 1])
    upper = min(inner[0], first + int((last - first) * how.cut[0])) if inner[0] > first else inner[0]
    lower = max(inner[1], last - int((last - first) * how.cut[1])) if inner[1] < last else inner[1]
    return _tighten(cover, upper, lower, max(0.005, 0.005 * top))


def trim_border(mask: np.ndarray, how: Border) -> tuple[int, int, int, int]:
    """(left, right, top, bottom): passes of border cuts until none is found, then rows if any column was cut."""
    h, w = mask.shape
    if not h or not w:
        return 0, w, 0, h
    left, right = 0, w
    for _ in range(how.iterations):
        cuts = border_cuts(mask[:, left:right], how)
        if cuts == (0, 0):
            break
        n = right - left
        a = max(0, min(n - 1, cuts[0]))
        left, right = left + a, left + max(a + 1, min(n, n - cuts[1]))
    top, bottom = vertical_bounds(mask[:, left:right], how) if (left, right) != (0, w) else (0, h)
    left, top = max(0, min(w - 1, left)), max(0, min(h - 1, top))
    return left, max(left + 1, min(w, right)), top, max(top + 1, min(h, bottom))


def border_effect(before: np.ndarray, after: np.ndarray) -> dict:
    a, b = K.ink_otsu(K.gray(before)) > 0, K.ink_otsu(K.gray(after)) > 0
    removed, total = int((a & ~b).sum()), int(a.sum())
    return {"removed_area": removed, "total_area": total, "removal_ratio": removed / max(1, total), "has_effect": removed > 0}


# ---- one character ----------------------------------------------------------------------------------------------

#: Mode names and what they stand for.
MODES = {"ccprojection": "ccprojection", "cc_projection": "ccprojection", "projection": "ccprojection", "projection_only": "projection_only", "cc_debug": "cc_debug"}


def refine(bgr: np.ndarray, box: tuple[int, int, int, int], how: Settings, trace: dict | None = None) -> tuple[tuple[int, int, int, int], np.ndarray] | None:
    """The refined (x, y, w, h) of a detected (x, y, w, h) and its cleaned crop; None where nothing is left. `trace`
    receives the numbers behind it: parts painted over, parts, parts removed, both trims, the left margin's runs."""
    height, width = bgr.shape[:2]
    x, y, w, h = box
    l, r, t, b = how.refine.expand  # noqa: E741
    x0, y0, x1, y1 = max(0, x - l), max(0, y - t), min(width, x + w + r), min(height, y + h + b)
    roi = bgr[y0:y1, x0:x1]
    if roi.size == 0:
        return None
    shade = K.gray(roi)
    if trace is not None:
        light = K.components((shade > how.noise.dark) & (shade < how.noise.light))[1]
        trace["noise_parts"] = int(is_noise(light, how.noise).sum()) if how.noise.enabled and len(light) else 0
    if how.noise.enabled:
        shade = remove_noise(shade, how.noise)
    mask, mode = binarize(shade, how.trim), MODES.get(how.refine.mode, "ccprojection")
    if trace is not None:
        stats = K.components(mask)[1]
        filtered = mode != "projection_only" and len(stats) > 0
        trace |= {"parts": len(stats), "removed_parts": int(tiers(stats, mask.shape[1], mask.shape[0], how.components)[1].sum()) if filtered else 0}
    if mode != "projection_only":
        mask = filter_components(mask, how.components)
    left, right, top, bottom = (0, roi.shape[1], 0, roi.shape[0]) if mode == "cc_debug" else trim_box(mask, how.trim)
    if trace is not None:
        inner = mask[top:bottom, left:right]
        cover = K.coverage(inner, 0)
        margin = cover[: int(len(cover) * how.border.width_ratio)]
        runs = spikes(margin, float(cover.max(initial=0)), len(cover), how.border) if how.border.enabled and cover.any() else []
        border = trim_border(inner, how.border) if how.border.enabled else (0, inner.shape[1], 0, inner.shape[0])
        trace |= {"trim": [left, right, top, bottom], "border": list(border), "spikes": runs}
    if how.border.enabled:
        a, c, d, e = trim_border(mask[top:bottom, left:right], how.border)
        left, right, top, bottom = left + a, left + c, top + d, top + e
    pad = how.refine.final_pad
    left, right, top, bottom = max(0, left - pad), min(roi.shape[1], right + pad), max(0, top - pad), min(roi.shape[0], bottom + pad)
    crop = np.where(mask > 0, shade, 255).astype(np.uint8)[top:bottom, left:right]
    return (x0 + left, y0 + top, max(1, right - left), max(1, bottom - top)), crop


def overlay(bgr: np.ndarray, boxes: list[tuple[int, int, int, int]], crops: list[np.ndarray]) -> np.ndarray:
    """The original beside a white page on which the crops stand at their refined places."""
    page = np.full(K.to_bgr(bgr).shape, 255, np.uint8)
    for (x, y, w, h), crop in zip(boxes, crops, strict=True):
        w, h = min(w, page.shape[1] - x), min(h, page.shape[0] - y)
        if w > 0 and h > 0 and crop.size:
            page[y : y + h, x : x + w] = K.to_bgr(K.resize(crop, h, w, nearest=True))
    return K.beside([bgr, page])
