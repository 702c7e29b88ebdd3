"""Golden blocks and laws of the numeric core."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays

from tessella.functions import blocks as b
from tessella.functions.columns import permutation

A = np.array([[[0, 0], [255, 255]]])
B = np.array([[[0, 255], [0, 255]]])
R = np.array([[[10, 20], [30, 41]]])
D = np.array([[[7, 9], [100, 3]]])


@pytest.mark.parametrize("ti,out", [*enumerate(["0123", "1302", "3210", "2031", "1032", "2301", "3120", "0213"])])
def test_transforms(ti, out):
    x = np.arange(4).reshape(1, 2, 2)
    assert "".join(map(str, b.transform(x, ti).ravel())) == out
    assert "".join(map(str, permutation(ti, 2))) == out


def test_compositions():
    assert b.compose(A, B, 2).tolist() == [[[0, 0], [0, 255]]]
    assert b.compose(A, B, 3).tolist() == [[[0, 255], [255, 255]]]
    assert b.compose(A, B, 4).tolist() == [[[255, 0], [255, 255]]]
    assert b.compose(A, B, 5).tolist() == [[[255, 255], [0, 255]]]
    four = np.random.default_rng(1).integers(0, 2, (1, 4, 4)) * 255
    x = b.compose(four, four, 6)[0]
    corners = np.zeros((4, 4), bool)
    corners[[0, 0, 3, 3], [0, 3, 0, 3]] = True
    assert ((x == 0) == corners).all()
    assert (b.compose(A, A, 6) == 0).all()
    with pytest.raises(ValueError):
        b.compose(A, B, 7)


def test_errors_and_brightness():
    flat = lambda x: x.reshape(1, -1)
    white, black = np.full((1, 4), 255), np.zeros((1, 4), int)
    assert np.sqrt(b.square_error(white, black, True))[0] == 2.0
    assert np.sqrt(b.square_error(flat(R), flat(D), True))[0] == pytest.approx(18.16590212458495)
    assert np.sqrt(b.square_error(flat(R), flat(D), False))[0] == pytest.approx(80.46117075956576)
    assert b.brightness(R.sum(), D.sum(), 4) == 2
    assert [int(b.brightness(np.int64(r * 4), np.int64(d * 4), 4)) for d, r in ((0, 255), (255, 255), (255, 0), (0, 0))] == [255, 63, -192, 0]


def test_fill_and_unfill():
    ring = np.full((1, 4, 4), 255)
    ring[0, 1:, 1:] = 0
    ring[0, 2, 2] = 255
    full = ring.copy()
    full[0, 2, 2] = 0
    assert (b.fill(ring) == full).all()
    out = b.unfill(np.zeros((1, 8, 8), int))[0]
    assert (out[1:-1, 1:-1] == 255).all() and (out[0] == 0).all() and (out[:, -1] == 0).all()


def test_similarity():
    assert b.cw_ssim(R, R, 5)[0] == pytest.approx(1.0)
    assert b.cw_ssim(A, B, 5)[0] == pytest.approx(0.601451069329, abs=1e-10)
    assert b.cw_ssim(A, B, 2)[0] == pytest.approx(0.555395887334, abs=1e-10)
    assert b.cw_ssim(R, D, 5)[0] == pytest.approx(0.846711621481, abs=1e-10)
    assert b.ssim(np.eye(8)[None] * 255, np.eye(8)[None] * 255)[0] == pytest.approx(1.0)
    assert (b.blur(np.full((1, 12, 12), 255), 5, 1.0) == 254).all()
    half = np.repeat([[[0], [255]]], 4, axis=2).repeat(2, axis=1)
    assert b.image_tversky(half, half)[0] == pytest.approx(0.99999988, abs=1e-7)


def test_translate_crop_resize_label():
    x = np.arange(9).reshape(1, 3, 3)
    assert b.translate(x, 1, -1, 7)[0].tolist() == [[7, 3, 4], [7, 6, 7], [7, 7, 7]]
    assert (b.translate(x, 9, 0, 5) == 5).all()
    assert b.crop(x, (1, 1)).tolist() == [[[4]]]
    assert b.resize(x, (3, 3)) is x
    assert (b.resize(np.full((1, 5, 7), 9), (3, 11)) == 9).all()
    y = np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 0, 1]])
    assert b.label(y).tolist() == [[1, 0, 1], [0, 1, 0], [0, 0, 0], [2, 0, 3]]
    assert (b.label(np.zeros((2, 2), int)) == 0).all()


images = arrays(np.int64, (1, 6, 6), elements=st.sampled_from([0, 127, 128, 129, 255]))


@settings(max_examples=60, deadline=None)
@given(images, images)
def test_laws(x, y):
    turn = x
    for _ in range(4):
        turn = b.transform(turn, 1)
    assert (turn == x).all()
    for ti in (2, 4, 5, 6, 7):
        assert (b.transform(b.transform(x, ti), ti) == x).all()
    assert (b.fill(b.fill(x)) == b.fill(x)).all()
    assert (b.compose(x, y, 2) <= b.compose(x, y, 3)).all()
    assert b.ssim(x, x)[0] == pytest.approx(1.0)
