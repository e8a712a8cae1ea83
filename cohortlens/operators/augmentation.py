"""Random changes of scaled images for training: flip, rotation, brightness, contrast and blur, then normalisation.

Images are height x width x channels of floats from 0 to 1. What an image gets follows from seed, epoch and its name alone, so
a repeated task, another order of rows or another number of partitions gives the same pixels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cohortlens.operators.images import Scaling, pixels, preprocessed

# Weights of red, green and blue in the gray that contrast is taken around.
GRAY = np.array([0.2989, 0.587, 0.114])


@dataclass(frozen=True)
class Augmentation:
    flip: float = 0.5
    degrees: float = 0.0
    brightness: float = 0.0
    contrast: float = 0.0
    blur: float = 0.0
    sigma: float = 1.0


def generator(seed: int, epoch: int, name: str) -> np.random.Generator:
    key = hashlib.blake2b(f"{seed}:{epoch}:{name}".encode(), digest_size=16).digest()
    return np.random.Generator(np.random.Philox(key=np.frombuffer(key, np.uint64)))


def rotated(image: np.ndarray, degrees: float, fill: np.ndarray) -> np.ndarray:
    """The image turned counter-clockwise around its centre. Each output pixel looks up where it comes from and takes the four
    pixels there by their nearness; what lies outside counts as nothing, and the missing weight is filled."""
    height, width, channels = image.shape
    turn = np.deg2rad(degrees)
    y, x = np.meshgrid(np.arange(height) - (height - 1) / 2, np.arange(width) - (width - 1) / 2, indexing="ij")
    from_x = np.cos(turn) * x - np.sin(turn) * y + (width - 1) / 2
    from_y = np.sin(turn) * x + np.cos(turn) * y + (height - 1) / 2
    left, top = np.floor(from_x).astype(int), np.floor(from_y).astype(int)
    out, known = np.zeros(image.shape), np.zeros((height, width, 1))
    for right in (0, 1):
        for below in (0, 1):
            px, py = left + right, top + below
            weight = (1 - np.abs(from_x - px)) * (1 - np.abs(from_y - py)) * ((px >= 0) & (px < width) & (py >= 0) & (py < height))
            out += weight[..., None] * image[py.clip(0, height - 1), px.clip(0, width - 1)]
            known += weight[..., None]
    return out * known + (1 - known) * np.broadcast_to(fill, channels)


def blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    """A 3 x 3 Gaussian; beyond the border the image is mirrored at its last pixels."""
    side = np.exp(-0.5 / sigma**2)
    out = image
    for axis in (0, 1):
        if image.shape[axis] > 1:
            wide = np.pad(out, [(1, 1) if a == axis else (0, 0) for a in range(3)], mode="reflect")
            low, mid, high = (np.take(wide, np.arange(k, k + image.shape[axis]), axis) for k in range(3))
            out = (mid + side * (low + high)) / (1 + 2 * side)
    return out


def augmented(image: np.ndarray, how: Augmentation, draws: np.random.Generator, fill: np.ndarray) -> np.ndarray:
    """All draws are made whatever comes of them, so that one setting doesn't change what others get."""
    flip, turn, bright, contrast, blur = draws.random(5)
    spread = lambda share, reach: (2 * share - 1) * reach
    out = image[:, ::-1] if flip < how.flip else image
    if how.degrees:
        out = rotated(out, spread(turn, how.degrees), fill)
    if how.brightness:
        out = np.clip(out * (1 + spread(bright, how.brightness)), 0, 1)
    if how.contrast:
        by = 1 + spread(contrast, how.contrast)
        out = np.clip(by * out + (1 - by) * (out @ GRAY).mean(), 0, 1)
    return blurred(out, how.sigma) if blur < how.blur else out


def training_images(images: DataFrame, how: Augmentation, mean: tuple[float, ...], stdev: tuple[float, ...], spec: Scaling | None = None, seed: int = 0, epoch: int = 0) -> DataFrame:
    """(origin, size, pixels) of each decodable image: scaled, changed by its draws and normalised, as float32 bytes. Corners
    that rotation leaves open get what the padding holds: black, or the median of the image."""
    given = spec or Scaling()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                image = preprocessed(pixels(r.data, r.width, r.height, r.n_channels)[0], given)
                fill = np.zeros(3) if given.padding == "black" else np.median(image.reshape(-1, 3), axis=0)
                out = augmented(image, how, generator(seed, epoch, r.origin), fill)
                rows.append((r.origin, given.size, ((out - np.array(mean)) / np.maximum(stdev, 1e-6)).astype("<f4").tobytes()))
            yield pd.DataFrame(rows, columns=["origin", "size", "pixels"])

    return images.where("width > 0").mapInPandas(run, "origin string, size int, pixels binary")
