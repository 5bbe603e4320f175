import numpy as np
import pytest

from zonemill.operators import imaging as I

RNG = np.random.default_rng(1)
IMG = RNG.integers(0, 256, (23, 37)).astype(np.uint8)


def test_buffers():
    rgb = RNG.integers(0, 256, (4, 5, 3)).astype(np.uint8)
    want = ((rgb.astype(int) * [77, 150, 29]).sum(2) >> 8).astype(np.uint8)
    assert (I.from_buffer(rgb.tobytes(), 5, 4, layout="Rgb24") == want).all()
    assert (I.from_buffer(rgb[:, :, ::-1].tobytes(), 5, 4, layout="Bgr24") == want).all()
    clear = np.dstack((rgb, np.zeros((4, 5), np.uint8)))
    assert (I.from_buffer(clear.tobytes(), 5, 4, layout="Rgba32") == 255).all()
    padded = np.pad(IMG, ((0, 0), (0, 3)))
    assert (I.from_buffer(padded.tobytes(), 37, 23, 40) == IMG).all()
    assert (I.from_buffer(IMG.tobytes() + b"uv" * 99, 37, 23, layout="Nv21", rotation=90) == np.rot90(IMG, -1)).all()
    with pytest.raises(ValueError):
        I.from_buffer(b"x", 2, 2)


def test_scaling():
    small = I.downscale(IMG, 10)
    assert small.shape == (6, 10)
    for y in range(6):
        for x in range(10):
            box = IMG[y * 23 // 6 : max(y * 23 // 6 + 1, (y + 1) * 23 // 6), x * 37 // 10 : max(x * 37 // 10 + 1, (x + 1) * 37 // 10)]
            assert small[y, x] == int(box.astype(int).sum()) // box.size
    assert (I.downscale(IMG, 40) == IMG).all() and (I.resize(IMG, 37, 23) == IMG).all()
    assert (I.rotate(IMG, 0) == IMG).all() and (I.rotate(np.full((9, 9), 7, np.uint8), 31) == 7).all()


def test_statistics():
    assert I.percentile(np.array([[1, 2], [3, 200]], np.uint8), 50) == 2
    assert I.percentile(np.array([[5, 6, 7, 8, 9, 10, 11]], np.uint8), 5) == 0  # a third of a pixel rounds down to none
    v = I.normalise(RNG.random(320))
    assert abs(v.sum()) < 1e-4 and abs((v * v).sum() - 1) < 1e-5
    assert I.halve(np.arange(16.0).reshape(4, 4)).tolist() == [[2.5, 4.5], [10.5, 12.5]]
    assert np.allclose(I.blur(np.ones((4, 5))), 1) and I.blur(np.arange(4.0).reshape(2, 2))[0, 0] == 1.5


def test_runs():
    img = np.full((60, 200), 255, np.uint8)
    img[20:30, ::4] = 0
    strong, rows = I.edge_rows(img)
    assert rows[:20].sum() == 0 and rows[25] > 50
    assert I.row_runs(rows) == [(19, 31)]  # smoothing adds the rows beside the dark ones
    assert I.row_runs(np.zeros(9, int)) == []
