import math

import numpy as np
import pytest

from cohortlens.operators import augmentation, images
from cohortlens.operators.augmentation import Augmentation


def picture(height=11, width=8, seed=0):
    return np.random.default_rng(seed).random((height, width, 3))


def slow_rotated(image, degrees, fill):
    h, w, _ = image.shape
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    out = np.zeros_like(image)
    for y in range(h):
        for x in range(w):
            dx, dy = x - (w - 1) / 2, y - (h - 1) / 2
            sx, sy = c * dx - s * dy + (w - 1) / 2, s * dx + c * dy + (h - 1) / 2
            value, known = np.zeros(3), 0.0
            for py in range(math.floor(sy), math.floor(sy) + 2):
                for px in range(math.floor(sx), math.floor(sx) + 2):
                    if 0 <= px < w and 0 <= py < h:
                        share = (1 - abs(sx - px)) * (1 - abs(sy - py))
                        value, known = value + share * image[py, px], known + share
            out[y, x] = value * known + (1 - known) * fill
    return out


@pytest.mark.parametrize("degrees", [0, 7.5, -20, 90, 133])
def test_rotation_equals_slow_loops(degrees):
    image, fill = picture(), np.array([0.2, 0.5, 0.9])
    assert np.allclose(augmentation.rotated(image, degrees, fill), slow_rotated(image, degrees, fill))


def test_quarter_turns_and_no_turn():
    image = picture(9, 9)
    assert np.allclose(augmentation.rotated(image, 90, np.zeros(3)), np.rot90(image)) and np.allclose(augmentation.rotated(image, 0, np.zeros(3)), image)


def test_blur_equals_slow_loops():
    image, sigma = picture(6, 5, 2), 0.8
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in (-1, 0, 1)]
    mirror = lambda i, n: -i if i < 0 else 2 * n - 2 - i if i >= n else i
    want = np.zeros_like(image)
    for y in range(6):
        for x in range(5):
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    want[y, x] += kernel[a + 1] * kernel[b + 1] * image[mirror(y + a, 6), mirror(x + b, 5)]
    assert np.allclose(augmentation.blurred(image, sigma), want / sum(kernel) ** 2)
    assert np.allclose(augmentation.blurred(np.full((1, 4, 3), 0.5), 1.0), 0.5)


def test_draws_follow_from_seed_epoch_and_name():
    how, image = Augmentation(0.5, 10, 0.2, 0.2, 0.5, 1.0), picture()
    one = lambda *key: augmentation.augmented(image, how, augmentation.generator(*key), np.zeros(3))
    assert (one(1, 0, "a") == one(1, 0, "a")).all()
    assert all((one(1, 0, "a") != one(*other)).any() for other in ((2, 0, "a"), (1, 1, "a"), (1, 0, "b")))
    assert (augmentation.augmented(image, Augmentation(0), augmentation.generator(1, 0, "a"), np.zeros(3)) == image).all()
    flips = [(augmentation.augmented(image, Augmentation(0.3), augmentation.generator(1, 0, str(i)), np.zeros(3)) == image[:, ::-1]).all() for i in range(400)]
    assert 80 < sum(flips) < 160
    assert 0 <= one(5, 0, "z").min() and one(5, 0, "z").max() <= 1


def test_a_repeated_run_gives_equal_pixels(spark, tmp_path):
    from tests.test_images import png, speckle

    for i in range(6):
        (tmp_path / f"{i}.png").write_bytes(png(speckle(40, 60, i)))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    found = images.decoded(spark, str(tmp_path))
    how, spec = Augmentation(0.5, 10, 0.1, 0.1, 0.5), images.Scaling(16, padding="median")
    run = lambda df, epoch: {r.origin: bytes(r.pixels) for r in augmentation.training_images(df, how, (0.5,) * 3, (0.25, 0.0, 0.25), spec, 3, epoch).collect()}
    one = run(found, 0)
    assert len(one) == 6 and {len(p) for p in one.values()} == {16 * 16 * 3 * 4}
    assert run(found.repartition(5), 0) == one and run(found, 1) != one
