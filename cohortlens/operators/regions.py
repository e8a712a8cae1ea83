"""Regions of masks, distances to them, and filters as matrices."""

from __future__ import annotations

import numpy as np


# ---- regions and distances


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """4-connected components: labels from 1 in scan order of their first pixel, and how many there are."""
    height, width = mask.shape
    runs: list[tuple[int, int, int]] = []
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[int] = []
    for y in range(height):
        step = np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]]))
        here = []
        for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            me = len(runs)
            runs.append((y, a, b))
            parent.append(me)
            for other in above:
                if runs[other][1] < b and a < runs[other][2]:
                    low, high = sorted((root(me), root(other)))
                    parent[high] = low
            here.append(me)
        above = here
    labels, names = np.zeros((height, width), np.int64), {}
    for i, (y, a, b) in enumerate(runs):
        labels[y, a:b] = names.setdefault(root(i), len(names) + 1)
    return labels, len(names)


class Regions:
    """The components of a mask as a table: entry 0 is what lies outside of it."""

    def __init__(self, mask: np.ndarray):
        self.labels, count = components(mask)
        self.area = np.bincount(self.labels.ravel(), minlength=count + 1) * (np.arange(count + 1) > 0)

    def meet(self, *lines: np.ndarray) -> np.ndarray:
        """Which regions have a pixel in one of the parts of the label image."""
        met = np.zeros(len(self.area), bool)
        for line in lines:
            met[line.ravel()] = True
        return met & (self.area > 0)

    def pixels(self, chosen: np.ndarray) -> np.ndarray:
        return chosen[self.labels]


def distance(mask: np.ndarray) -> np.ndarray:
    """Steps along rows and columns from each pixel to the mask; at least the sum of both sides where the mask is empty."""
    far = np.where(mask, 0, sum(mask.shape)).astype(np.int64)
    for axis in (0, 1):
        place = np.arange(mask.shape[axis]).reshape((-1, 1) if axis == 0 else (1, -1))
        from_low = np.minimum.accumulate(far - place, axis) + place
        from_high = np.flip(np.minimum.accumulate(np.flip(far + place, axis), axis), axis) - place
        far = np.minimum(from_low, from_high)
    return far


# ---- filters as matrices: an image of height x width is filtered as R @ image @ C.T


def sliding(n: int, kernel: np.ndarray, mirrored: bool) -> np.ndarray:
    """The matrix that weighs the neighbours of each of n places; beyond the border are mirror images, or nothing."""
    out, half = np.zeros((n, n)), len(kernel) // 2
    for k, weight in enumerate(kernel):
        at = np.arange(n) + k - half
        inside = (at >= 0) & (at < n)
        if mirrored:
            at, inside = np.abs(at + 0.5) - 0.5, np.ones(n, bool)  # place -1 is place 0 again
            at = (n - 0.5) - np.abs(at % (2 * n) - (n - 0.5))
        np.add.at(out, (np.flatnonzero(inside), at[inside].astype(int)), weight)
    return out


def filtered(image: np.ndarray, kernel: np.ndarray, mirrored: bool = True) -> np.ndarray:
    rows, columns = (sliding(n, kernel, mirrored) for n in image.shape)
    return rows @ image.astype(np.float64) @ columns.T


def blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    return filtered(image, kernel / kernel.sum())


def opened(mask: np.ndarray, size: int) -> np.ndarray:
    """What size x size squares inside the mask cover; outside the image nothing is set."""
    ones = np.ones(size)
    centres = np.rint(filtered(mask, ones, mirrored=False)) == size * size
    return np.rint(filtered(centres, ones, mirrored=False)) > 0
