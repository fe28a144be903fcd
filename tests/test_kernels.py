"""Raster kernels: hand-worked fixtures and properties."""

import numpy as np
import pytest

from sumi.config import Border, ComponentFilter, Noise, Settings, Trim
from sumi.operators import glyphs as G
from sumi.operators import kernels as K


@pytest.fixture
def rng():
    return np.random.default_rng(0)


def bars(cover, height=20):
    """A mask whose columns have the given share of ink."""
    return np.stack([np.where(np.arange(height) < round(c * height), 255, 0) for c in cover], axis=1).astype(np.uint8)


def test_runs():
    assert K.runs(np.array([0, 0.2, 0.3, 0, 0, 0.5]), 0.01).tolist() == [[1, 3], [5, 6]]
    assert K.runs(np.zeros(0), 0.01).tolist() == []


def test_axis_trim():
    assert G.trim_axis(bars([0.5, 0, 0, 0.5, 0.5, 0.5, 0.5, 0, 0, 0]), 0, Trim()) == (3, 7)
    assert G.trim_axis(np.zeros((4, 6), np.uint8), 0, Trim()) == (0, 6)


def test_trim_lies_inside(rng):
    for _ in range(50):
        m = np.where(rng.random((int(rng.integers(1, 30)), int(rng.integers(1, 30)))) < 0.3, 255, 0).astype(np.uint8)
        for left, right, top, bottom in (G.trim_box(m, Trim()), G.trim_border(m, Border())):
            assert 0 <= left < right <= m.shape[1] and 0 <= top < bottom <= m.shape[0]


@pytest.mark.parametrize("x,y,w,h,area,tier,removed", [(1, 50, 10, 10, 100, 0, True), (2, 50, 10, 10, 100, 1, False), (2, 20, 5, 60, 300, 1, True), (40, 40, 8, 8, 39, 2, True), (40, 40, 8, 8, 40, 2, False)])
def test_tiers(x, y, w, h, area, tier, removed):
    # margins let a touching component start one further out than a zone one
    how = ComponentFilter()
    kind, gone = G.tiers(np.array([[x, y, w, h, area]]), 100, 100, how)
    assert (kind[0], gone[0]) == (tier, removed)


def test_noise_rule():
    stats = np.array([[0, 0, 10, 10, 51], [0, 0, 8, 8, 50], [0, 0, 1, 2, 2], [0, 0, 16, 1, 16], [0, 0, 15, 1, 15]])
    assert G.is_noise(stats, Noise()).tolist() == [True, False, False, True, False]


def test_border_cuts():
    cover = np.zeros(100)
    cover[[1, 2]] = 0.9
    assert G.border_cuts(bars(cover), Border())[0] == 3
    cover = np.zeros(100)
    cover[[97, 98]] = 0.9
    assert G.border_cuts(bars(cover), Border())[1] == 2
    assert G.border_cuts(bars(cover), Border(right_cut="symmetric"))[1] == 3


def test_gradient_limit():
    cover = np.full(100, 0.1)
    cover[0:3], cover[3:10] = 0.6, 0.325
    cover[50] = 0.9
    spike = G.spikes(K.coverage(bars(cover, 40), 0)[:20], 0.9, 100, Border(threshold=0.5))[0]
    assert spike["drop"] == pytest.approx(0.275, abs=0.02) and not spike["border"]


def test_components_match_flood_fill(rng):
    for _ in range(30):
        m = rng.random((int(rng.integers(1, 20)), int(rng.integers(1, 20)))) < rng.random()
        labels, stats = K.components(m)
        seen, k = np.zeros(m.shape, int), 0
        for y, x in zip(*np.nonzero(m), strict=True):
            if seen[y, x]:
                continue
            k += 1
            todo = [(y, x)]
            seen[y, x] = k
            while todo:
                a, b = todo.pop()
                for c in range(max(0, a - 1), min(m.shape[0], a + 2)):
                    for d in range(max(0, b - 1), min(m.shape[1], b + 2)):
                        if m[c, d] and not seen[c, d]:
                            seen[c, d] = k
                            todo.append((c, d))
        assert (labels == seen).all() and len(stats) == k
        for i in range(k):
            ys, xs = np.nonzero(seen == i + 1)
            assert stats[i].tolist() == [xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1, len(ys)]


def test_component_filter_is_idempotent(rng):
    m = np.where(rng.random((40, 40)) < 0.35, 255, 0).astype(np.uint8)
    once = G.filter_components(m, ComponentFilter())
    assert (G.filter_components(once, ComponentFilter()) == once).all() and (once <= m).all()


def test_morphology_orders(rng):
    x = rng.integers(0, 256, (17, 23)).astype(np.uint8)
    for shape in (K.element(3, k) for k in ("iso", "h", "v", "d1", "d2", "rect", "cross")):
        assert (K.close(x, shape) >= x).all() and (K.open_(x, shape) <= x).all()
        assert (K.erode(x, shape) <= x).all() and (K.dilate(x, shape) >= x).all()
        assert (255 - K.dilate(255 - x, shape) == K.erode(x, shape[::-1, ::-1])).all()


def test_projection_is_symmetric(rng):
    m = np.where(rng.random((9, 14)) < 0.4, 255, 0).astype(np.uint8)
    assert (K.coverage(m, 0) == K.coverage(m.T, 1)).all()


def test_otsu_by_search(rng):
    x = rng.integers(0, 256, 300).astype(np.uint8)

    def score(t):
        a, b = x[x <= t].astype(float), x[x > t].astype(float)
        return len(a) * len(b) * (a.mean() - b.mean()) ** 2 if len(a) and len(b) else -1

    assert score(K.otsu(x)) == pytest.approx(max(score(t) for t in range(256)))
    assert K.otsu(np.full(9, 7, np.uint8)) == 0


def test_colour_round_trips(rng):
    x = rng.integers(0, 256, (30, 30, 3)).astype(np.uint8)
    assert np.abs(K.ycrcb_to_bgr(K.bgr_to_ycrcb(x)).astype(int) - x).max() <= 3
    assert np.abs(K.hsv_to_bgr(K.bgr_to_hsv(x)).astype(int) - x).max() <= 8
    assert (K.apply_gamma(x, 1.0) == x).all() and (K.enhance(x, on=False) == x).all()


def test_auto_invert():
    x = np.full((3, 3), 9, np.uint8)
    assert (K.auto_invert(x, np.zeros((3, 3), np.uint8)) == 0).all()
    x[0] = 1
    assert K.auto_invert(x, np.where(x == 1, 255, 0).astype(np.uint8))[0, 0] == 0


def test_flat_rasters_survive_filters():
    flat = np.full((8, 8), 50, np.uint8)
    for f in (K.gaussian, K.bilateral, K.clahe, K.sobel_edges, K.laplacian_edges, lambda x: K.canny(x, 10, 20), K.keep_ink, K.heal, K.ink_adaptive):
        assert f(flat).shape == (8, 8)
    assert (K.gaussian(flat) == 50).all() and (K.bilateral(flat) == 50).all() and not K.canny(flat, 10, 20).any()


def test_skeleton_stops_on_full_raster():
    assert K.skeleton(np.full((5, 5), 255, np.uint8)).shape == (5, 5)


def test_distance():
    m = np.zeros((5, 5), np.uint8)
    m[1:4, 1:4] = 255
    assert K.distance(m)[2, 2] == pytest.approx(2 * 0.955, abs=1e-3) and K.distance(m)[0, 0] == 0


def test_borders_of_a_ring():
    m = np.zeros((7, 7), np.uint8)
    m[1:6, 1:6] = 255
    m[3, 3] = 0
    outer = K.borders(m, external=True)
    assert len(outer) == 1 and K.area(outer[0][0]) == 16 and len(outer[0][0]) == 16
    both = K.borders(m, external=False)
    assert [hole for _, hole in both] == [False, True]
    assert K.chain(outer[0][0], "simple") == [(1, 1), (1, 5), (5, 5), (5, 1)]
    assert len(K.simplify(outer[0][0], 0.05)) == 4
    assert K.perimeter(outer[0][0]) == 16


def test_border_of_one_pixel():
    m = np.zeros((3, 3), np.uint8)
    m[1, 1] = 255
    assert K.borders(m) == [([(1, 1)], False)]


def test_contours_trace_each_component(rng):
    for _ in range(20):
        m = np.where(rng.random((12, 12)) < 0.45, 255, 0).astype(np.uint8)
        found = K.borders(m, external=True)
        labels, stats = K.components(m)
        marked = {int(labels[y, x]) for points, _ in found for x, y in points}
        assert all(m[y, x] for points, _ in found for x, y in points)
        assert marked <= set(range(1, len(stats) + 1)) and len(found) <= len(stats)


def test_hull():
    assert K.hull([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]


def test_resize_and_panels():
    x = np.arange(16, dtype=np.uint8).reshape(4, 4)
    assert (K.resize(x, 4, 4) == x).all() and K.resize(x, 8, 2, nearest=True).shape == (8, 2)
    assert K.beside([x, x[:2]]).shape == (4, 8, 3) and K.stacked([x, x[:, :2]]).shape == (8, 4, 3)
    assert K.draw(x, [(0, 0), (3, 0)], thickness=1)[0, :, 1].tolist() == [255] * 4


def test_refine_gives_a_crop_of_its_box(rng):
    page = np.full((60, 60, 3), 255, np.uint8)
    page[20:40, 22:38] = 20
    box, crop = G.refine(page, (15, 15, 30, 30), Settings())
    assert crop.shape == (box[3], box[2]) and 13 <= box[0] <= 22 and box[0] + box[2] >= 38
    assert G.refine(page, (100, 100, 5, 5), Settings()) is None
    assert G.overlay(page, [box], [crop]).shape == (60, 120, 3)


def test_saturation_and_conversions_by_formula():
    rng = np.random.default_rng(11)
    x = rng.integers(0, 256, (6, 7, 3)).astype(np.uint8)
    import colorsys

    hsv = K.bgr_to_hsv(x)
    back = K.hsv_to_bgr(hsv)
    assert np.abs(back.astype(int) - x).max() <= 6  # hue has 180 steps
    for (i, j), _ in np.ndenumerate(x[..., 0]):
        b, g, r = (int(v) / 255 for v in x[i, j])
        h, s, v = colorsys.rgb_to_hsv(r, g, b)
        assert abs(float(hsv[i, j, 2]) - 255 * v) <= 1 and abs(float(hsv[i, j, 1]) - 255 * s) <= 1.5
    more = K.bgr_to_hsv(K.saturate(x, 1.5))
    assert (more[..., 1].astype(int) + 8 >= hsv[..., 1]).all()


def test_jet_goes_from_blue_to_red():
    ramp = K.jet(np.arange(256, dtype=np.uint8).reshape(16, 16)).reshape(256, 3).astype(int)
    assert ramp[0][0] > 100 and ramp[0][2] == 0 and ramp[255][2] > 100 and ramp[255][0] == 0
    assert ramp[128][1] > 200
    assert (np.diff(ramp[:, 2])[:200] >= 0).all()


def test_adaptive_and_bilateral_by_loops():
    rng = np.random.default_rng(12)
    x = rng.integers(0, 256, (9, 8)).astype(np.uint8)
    w = K.gaussian_weights(5)
    p = np.pad(x.astype(float), 2, mode="edge")
    got, smooth = K.bright_adaptive(x, 5, 5), K.bilateral(x, 5, 30, 15)
    q = np.pad(x.astype(float), 2, mode="reflect")
    for (i, j), v in np.ndenumerate(x):
        mean = np.rint(sum(w[a] * w[b] * p[i + a, j + b] for a in range(5) for b in range(5)))
        assert got[i, j] == (255 if int(v) > mean - 5 else 0)
        near = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4]
        k = [np.exp(-(a * a + b * b) / 450 - (q[i + 2 + a, j + 2 + b] - v) ** 2 / 1800) for a, b in near]
        assert smooth[i, j] == np.rint(sum(c * q[i + 2 + a, j + 2 + b] for c, (a, b) in zip(k, near, strict=True)) / sum(k))


def test_canny_marks_a_step_and_nothing_flat():
    x = np.zeros((20, 20), np.uint8)
    x[:, 10:] = 200
    edges = K.canny(x, 50, 150) > 0
    assert edges[5:15].any(axis=1).all() and set(np.flatnonzero(edges[10])) <= {9, 10}
    assert not K.canny(np.full((20, 20), 90, np.uint8), 50, 150).any()


def test_clahe_keeps_order_within_a_tile_and_flat_stays_flat():
    rng = np.random.default_rng(13)
    x = rng.integers(0, 256, (16, 16)).astype(np.uint8)
    y = K.clahe(x, 2.0, 1)
    order = np.argsort(x.reshape(-1), kind="stable")
    assert (np.diff(y.reshape(-1)[order].astype(int)) >= 0).all()
    assert len(np.unique(K.clahe(np.full((16, 16), 50, np.uint8), 2.0, 2))) == 1


def test_skeleton_lies_inside_and_is_thin():
    mask = np.zeros((20, 20), np.uint8)
    mask[4:14, 3:17] = 255
    thin = K.skeleton(mask) > 0
    assert thin.any() and not (thin & (mask == 0)).any() and thin.sum() < 0.5 * (mask > 0).sum()


def test_weak_connections_by_loops(rng):
    """Thin junctions found pixel by pixel, and cuts that leave only parts that are large enough."""
    cut = 0
    for _ in range(60):
        mask = np.pad(rng.random((9, 9)) < 0.72, 1)
        s, d = K.skeleton(mask) > 0, K.distance(mask)
        want = []
        for y in range(11):
            for x in range(11):
                near = sum(bool(s[a, b]) for a in range(max(0, y - 1), min(11, y + 2)) for b in range(max(0, x - 1), min(11, x + 2))) - 1
                if s[y, x] and near >= 3 and d[y, x] < 2:
                    around = [d[a, b] for a in range(max(0, y - 3), min(11, y + 4)) for b in range(max(0, x - 3), min(11, x + 4)) if d[a, b] > 0]
                    if d[y, x] < np.mean(around) * 0.9:
                        want.append((y, x))
        assert [(y, x) for y, x, _ in K.weak_points(mask, 2, 0.9, 3)] == want
        out = K.break_weak(mask, 2, 0.9, 3) > 0
        assert not (out & ~mask).any()
        if (out != mask).any():
            cut += 1
            assert (K.components(out)[1][:, 4] >= 3).all()
        assert ((K.break_weak(mask, 2, 0.9, 10_000) > 0) == mask).all()
    assert cut and K.break_weak(np.zeros((5, 5), bool)).max() == 0


def test_png_is_read_back_by_its_chunks(rng):
    """The encoder's files hold the raster: signature, checksums and rows by the format's own rules."""
    import struct
    import zlib

    from sumi.sources.images import encode_png

    for x in (rng.integers(0, 256, (5, 7), np.uint8), rng.integers(0, 256, (4, 3, 3), np.uint8)):
        png, at, parts = encode_png(x), 8, {}
        assert png[:8] == b"\x89PNG\r\n\x1a\n"
        while at < len(png):
            (n,), kind = struct.unpack(">I", png[at : at + 4]), png[at + 4 : at + 8]
            parts[kind] = png[at + 8 : at + 8 + n]
            assert struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + parts[kind])
            at += 12 + n
        w, h, depth, colour = struct.unpack(">IIBB", parts[b"IHDR"][:10])
        assert (h, w, depth, colour) == (*x.shape[:2], 8, 0 if x.ndim == 2 else 2)
        rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(h, -1)
        assert not rows[:, 0].any()
        assert (rows[:, 1:].reshape(x.shape) == (x if x.ndim == 2 else x[..., ::-1])).all()
