"""The band of tissue in a scaled image, and artificial fill at its ends.

Masks are brought down to a summary of each column first (first and last row); what follows works on these few numbers.
Images are height x width with values from 0 to 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from cohortlens.operators.regions import Regions, blurred, distance, opened


@dataclass(frozen=True)
class Spans:
    """The columns of a mask that hold anything, and the first and last row that is set in each."""

    columns: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @classmethod
    def of(cls, mask: np.ndarray) -> Spans:
        column, row = np.nonzero(mask.T)
        columns, start, count = np.unique(column, return_index=True, return_counts=True)
        return cls(columns, row[start], row[start + count - 1])

    def filled(self, shape: tuple[int, int]) -> np.ndarray:
        """The mask of all rows from first to last."""
        edge = np.zeros((shape[0] + 1, shape[1]), np.int64)
        np.add.at(edge, (self.first.clip(0, shape[0]), self.columns), 1)
        np.add.at(edge, ((self.last + 1).clip(0, shape[0]), self.columns), -1)
        return edge.cumsum(axis=0)[:-1] > 0


def otsu(values: np.ndarray, bins: int = 256) -> float:
    """The threshold of most variance between the two sides."""
    counts, edges = np.histogram(values, bins=bins)
    centres = np.convolve(edges, [0.5, 0.5], "valid")
    below = np.cumsum(counts) / counts.sum()
    part = np.cumsum(counts * centres) / counts.sum()
    both = below * (1 - below)
    between = np.divide((part[-1] * below - part) ** 2, both, out=np.full(bins, -1.0), where=both > 0)
    return float(centres[between.argmax()])


# ---- fill at the ends of the content


def local_spread(image: np.ndarray, window: int) -> np.ndarray:
    """Standard deviation in a square around each pixel, from a table of sums; the border mirrors."""
    half = window // 2
    wide = np.pad(image.astype(np.float64), (half, window - 1 - half), mode="symmetric")
    table = np.pad(np.stack([wide, wide**2]), ((0, 0), (1, 0), (1, 0))).cumsum(axis=1).cumsum(axis=2)
    upper, lower = table[:, :-window], table[:, window:]
    mean, square = (lower[:, :, window:] - lower[:, :, :-window] - upper[:, :, window:] + upper[:, :, :-window]) / window**2
    return np.sqrt(np.maximum(square - mean**2, 0))


def at_the_ends(mask: np.ndarray, content: np.ndarray) -> tuple[Regions, np.ndarray]:
    """Regions of the mask, and which of them reach the uppermost or lowest row that holds content."""
    found, rows = Regions(mask), np.nonzero(content)[0]
    ends = found.labels[[rows.min(), rows.max()]] if len(rows) else found.labels[:0]
    return found, found.meet(ends)


def wedge_fill(image: np.ndarray, content: np.ndarray, window: int = 5, tolerance: float = 0.03, least_share: float = 0.001) -> np.ndarray:
    """Artificial fill inside the content: white, or black without texture, in regions that reach its upper or lower end and
    hold at least so much of it; with what is within two steps of them."""
    kinds = {"white": image >= 1 - tolerance, "black": (image <= tolerance) & (local_spread(image, window) < tolerance)}
    found, ending = at_the_ends(content & np.logical_or.reduce(list(kinds.values())), content)
    large = found.area >= least_share * np.count_nonzero(content)
    return content & (distance(found.pixels(ending & large)) <= 2)


# ---- boundaries


def settled(x: np.ndarray, y: np.ndarray, degree: int, tolerance: float, rounds: int = 4) -> np.ndarray:
    """y with points that a robust polynomial in x doesn't agree with moved onto it.

    The polynomial is a projection on a fixed orthonormal basis, with a weight of 0 or 1 for each point. A point agrees if it
    is within ``tolerance``, or three scaled median deviations of the points of weight 1. Agreement gives the next weights;
    this ends when they don't change, when too few points would be left to fit, or after so many rounds."""
    basis = np.linalg.qr(np.vander(np.linspace(-1, 1, int(np.ptp(x)) + 1)[x - x.min()], degree + 1))[0]
    weight = np.ones(len(x))

    def judged(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = basis * weight[:, None]
        curve = basis @ (np.linalg.pinv(part.T @ part) @ (part.T @ y))
        gap = np.abs(y - curve)
        return curve, (gap <= max(tolerance, 3 * 1.4826 * np.median(gap[weight > 0]))).astype(float)

    curve, agrees = judged(weight)
    while (rounds := rounds - 1) and (agrees != weight).any() and agrees.sum() >= degree + 2:
        weight = agrees
        curve, agrees = judged(weight)
    return np.where(agrees > 0, y, np.rint(curve)).astype(y.dtype)


def tissue(smooth: np.ndarray, content: np.ndarray, least_share: float, opening: int) -> np.ndarray:
    """Bright regions of the content, opened by a square: those with enough of their area in all, but for small ones (under a
    quarter of the largest) that reach an end of the content."""
    found, ending = at_the_ends(opened(content & (smooth > otsu(smooth[content])), opening), content)
    share = found.area / max(found.area.sum(), 1)
    minor = ending & (4 * found.area < found.area.max())
    return found.pixels((found.area > 0) & (share >= least_share) & ~minor)


def retina_band(image: np.ndarray, content: np.ndarray, sigma: float = 2.0, margin: int = 4, below: int = 10, least_share: float = 0.05, opening: int = 5, degree: int = 4, tolerance: float = 16.0) -> np.ndarray:
    """The band of tissue: in each column from its first row to its last, but no further than ``below`` rows under the last
    one that is bright among the tissue; both boundaries smoothed, with a margin. Nothing without content or tissue."""
    if image.shape != content.shape:
        raise ValueError("image and content differ in shape")
    if not content.any():
        return np.zeros(content.shape, bool)
    smooth = blurred(np.where(content, image, np.median(image[content])), sigma)
    body = tissue(smooth, content, least_share, opening)
    if not body.any():
        return body
    spans, bright = Spans.of(body), Spans.of(body & (smooth > otsu(smooth[body])))
    limit = dict(zip(bright.columns.tolist(), (bright.last + below).tolist(), strict=True))
    last = np.array([min(row, limit.get(c, row)) for c, row in zip(spans.columns.tolist(), spans.last.tolist(), strict=True)])
    sides = [spans.first, last]
    if len(spans.columns) > degree + 1:
        sides = [settled(spans.columns, side, degree, tolerance) for side in sides]
    return content & Spans(spans.columns, sides[0] - margin, sides[1] + margin).filled(content.shape)
