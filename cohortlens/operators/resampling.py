"""Scaling of byte images by separable filters whose reach grows with the shrink factor, in fixed-point numbers.

Each output place weighs the input places within the filter's support around its centre; supports are those of the filter,
times the shrink factor where there is one. Weights add up to one and are rounded to 22 binary digits, sums are rounded to
bytes after each direction, columns first. So results are whole numbers that don't depend on the order of sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

# Binary digits of weights, and weights of red, green and blue in gray (16 binary digits).
DIGITS = 22
RED, GREEN, BLUE = 19595, 38470, 7471


@dataclass(frozen=True)
class Filter:
    support: float
    weight: Callable[[np.ndarray], np.ndarray]


TRIANGLE = Filter(1.0, lambda x: np.maximum(0, 1 - np.abs(x)))
LANCZOS = Filter(3.0, lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0))


def weights(n: int, to: int, kind: Filter) -> np.ndarray:
    """A row of whole numbers for each of ``to`` places: the weights of n input places, times 2**DIGITS."""
    step = n / to
    wide = max(step, 1.0)
    centre = (np.arange(to) + 0.5) * step
    low = np.maximum(0, np.trunc(centre - kind.support * wide + 0.5))
    high = np.minimum(n, np.trunc(centre + kind.support * wide + 0.5))
    place = np.arange(n)
    exact = kind.weight((place + 0.5 - centre[:, None]) / wide) * ((place >= low[:, None]) & (place < high[:, None]))
    exact /= exact.sum(axis=1, keepdims=True)
    return np.trunc(exact * (1 << DIGITS) + np.copysign(0.5, exact))


def _bytes(sums: np.ndarray) -> np.ndarray:
    return np.clip(np.floor_divide(sums + (1 << (DIGITS - 1)), 1 << DIGITS), 0, 255)


def scaled(image: np.ndarray, width: int, height: int, kind: Filter = TRIANGLE) -> np.ndarray:
    """The image (height x width, or with channels last) at another size. Sums stay below 2**53, so doubles hold them exactly."""
    out = image.astype(np.float64)
    for axis, to in ((1, width), (0, height)):
        if image.shape[axis] != to:
            moved = np.moveaxis(out, axis, 0)
            out = np.moveaxis(_bytes(np.tensordot(weights(len(moved), to, kind), moved, axes=1)), 0, axis)
    return out.astype(np.uint8)


def picked(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    """The mask at another size: each place takes what is under its centre."""
    rows, columns = ((2 * np.arange(to) + 1) * n // (2 * to) for n, to in zip(mask.shape, (height, width), strict=True))
    return mask[np.ix_(rows, columns)]


def luma(rgb: np.ndarray) -> np.ndarray:
    """Gray bytes of red, green and blue ones."""
    r, g, b = np.moveaxis(rgb[..., :3].astype(np.int64), -1, 0)
    return ((r * RED + g * GREEN + b * BLUE + (1 << 15)) >> 16).astype(np.uint8)


def perceptual_hash(gray: np.ndarray) -> int:
    """64 bits, as a signed number: low frequencies of the cosine transform of a 32 x 32 image above their median, row by row,
    top bit first."""
    side = 32
    small = scaled(gray, side, side, LANCZOS).astype(np.float64)
    wave = np.cos(np.pi * np.outer(np.arange(8), 2 * np.arange(side) + 1) / (2 * side))
    low = wave @ small @ wave.T
    value = int("".join("1" if b else "0" for b in (low > np.median(low)).ravel()), 2)
    return value - (1 << 64) if value >> 63 else value
