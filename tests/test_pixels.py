"""Frame kernels against brute force: full-size colour frames, pooling, resampling in time, sectors, stored segmentations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoloom.operators import frames as O, pixels as X


def as_rows(clip, arrays):
    return [(clip, i, *a.shape, a.ravel().tolist()) for i, a in enumerate(arrays)]


DDL = "clip_id long, frame_no int, height int, width int, channels int, pixels array<int>"


def test_model_input_at_full_size(spark):
    rng = np.random.default_rng(3)
    clip = rng.integers(0, 256, (4, 480, 640, 3))
    clip[1, 100:200] = 255
    got = X.model_input(spark.createDataFrame(as_rows(7, clip), DDL)).first()
    top = clip.max(axis=0)
    luma = np.array([[(int(r) * 19595 + int(g) * 38470 + int(b) * 7471 + 32768) // 65536 for r, g, b in row] for row in top])
    want = np.empty((240, 320))
    for y in range(240):
        for x in range(320):  # centres of a half-size image lie between four pixels
            want[y, x] = np.floor(luma[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].mean() + 0.5)
    assert got.clip_id == 7 and np.array_equal(np.array(got.pixels).reshape(240, 320), want)


@pytest.mark.parametrize("shape", [(5, 7, 1), (3, 2, 3), (4, 4, 4)])
def test_pool_grey_and_resize(spark, shape):
    rng = np.random.default_rng(5)
    clips = {c: rng.integers(0, 256, (9, *shape)) for c in range(3)}
    rows = [r for c, a in clips.items() for r in as_rows(c, a)] + [(0, 99, *shape, None)]
    pooled = {r.clip_id: r for r in X.max_pool(spark.createDataFrame(rows, DDL).repartition(5)).collect()}
    assert set(pooled) == set(clips) and all(np.array_equal(np.array(pooled[c].pixels).reshape(shape), a.max(axis=0)) for c, a in clips.items())
    image = X.grey(clips[1][0])
    same = X.resized(image, *image.shape)
    assert np.array_equal(same, image)
    up = X.resized(image, 9, 11)
    for y in range(9):
        for x in range(11):
            fy, fx = min(max((y + 0.5) * shape[0] / 9 - 0.5, 0), shape[0] - 1), min(max((x + 0.5) * shape[1] / 11 - 0.5, 0), shape[1] - 1)
            y0, x0 = int(fy), int(fx)
            y1, x1 = min(y0 + 1, shape[0] - 1), min(x0 + 1, shape[1] - 1)
            v = (1 - fy + y0) * ((1 - fx + x0) * image[y0, x0] + (fx - x0) * image[y0, x1]) + (fy - y0) * ((1 - fx + x0) * image[y1, x0] + (fx - x0) * image[y1, x1])
            assert abs(up[y, x] - v) <= 0.5 + 1e-9


def test_stretch_and_faults(spark):
    colour = np.array([[[0, 5, 7], [10, 5, 9]]])
    rows = as_rows(1, [colour]) + as_rows(2, [np.full((2, 2, 1), 9)]) + [(3, 0, 1, 1, 1, None)]
    got = {r.clip_id: r.scaled for r in X.normalise(spark.createDataFrame(rows, DDL)).collect()}
    assert got[1] == [0, 0, 0, 1, 0, 1] and got[2] == [0] * 4 and got[3] is None
    for bad in ([(1, 0, 2, 2, 1, [1, 2, 3])], [(1, 0, 1, 1, 2, [1, 2])]):
        with pytest.raises(Exception, match="no frame of height"):
            X.normalise(spark.createDataFrame(bad, DDL)).collect()
    with pytest.raises(Exception, match="differ in shape"):
        X.max_pool(spark.createDataFrame(as_rows(1, [np.zeros((1, 2, 1), int)]) + as_rows(1, [np.zeros((2, 1, 1), int)]), DDL)).collect()


@pytest.mark.parametrize("zoom", [0.3, 0.5, 1.0, 1.7, 3.25, 0.01])
def test_zoom_in_time_is_linear_on_any_grid(spark, zoom):
    rng = np.random.default_rng(11)
    image = rng.random((3, 9))
    rows = [(1, d, 2 * f + 5, float(image[d, f])) for d in range(3) for f in range(9)] + [(2, 0, 4, 0.5)]
    got = O.zoom_in_time(spark.createDataFrame(rows, "clip_id int, depth int, frame_no int, v double"), F.lit(zoom)).collect()
    m = round(9 * zoom)
    want = {(1, d, m - 1 - i): float(np.interp(i * 8 / max(1, m - 1), range(9), image[d])) for d in range(3) for i in range(m)} | ({(2, 0, round(zoom) - 1 - i): 0.5 for i in range(round(zoom))})
    assert {(r.clip_id, r.depth, r.column): pytest.approx(r.v) for r in got} == want


def test_time_zoom_takes_the_larger_scale(spark):
    row = spark.range(1).select(O.time_zoom(F.lit(25.0), F.lit(0.5), F.lit(100), F.lit(64)).alias("speed"), O.time_zoom(F.lit(25.0), F.lit(5.0), F.lit(100), F.lit(64)).alias("square")).first()
    assert row.speed == 2.5 and row.square == 100 / 64


def test_resize_rounds_exact_halves_up():
    """Weights of fifths and twelfths are no binary fractions; a sum that is a half must be one all the same."""
    from fractions import Fraction as Q

    def axis(n, to, i):
        at = min(max(Q(2 * i + 1, 2) * Q(n, to) - Q(1, 2), Q(0)), Q(n - 1))
        low = at.numerator // at.denominator
        return low, min(low + 1, n - 1), at - low

    image = np.random.default_rng(3).integers(0, 256, (8, 8))
    for k in range(40):
        got = X.resized(np.roll(image, k) ^ k, 5, 12)
        own = np.roll(image, k) ^ k
        for r in range(5):
            for q in range(12):
                (y0, y1, fy), (x0, x1, fx) = axis(8, 5, r), axis(8, 12, q)
                v = sum(int(own[y, x]) * a * b for y, a in ((y0, 1 - fy), (y1, fy)) for x, b in ((x0, 1 - fx), (x1, fx))) + Q(1, 2)
                assert got[r, q] == v.numerator // v.denominator
