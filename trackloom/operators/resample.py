"""Bicubic resampling of one image in a task: resize, and rotation about the center."""

from __future__ import annotations

import functools

import numpy as np


def cubic(x: np.ndarray) -> np.ndarray:
    """Keys's interpolating kernel with a = -1/2."""
    x = np.abs(x)
    return np.where(x <= 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


@functools.lru_cache(64)
def weights(n: int, m: int) -> np.ndarray:
    """(m, n): how much every one of n samples counts in each of m; wider kernels when shrinking, edges mirrored."""
    scale = m / n
    stretch = min(1.0, scale)
    reach = int(np.ceil(2 / stretch)) + 1
    center = (np.arange(m) + 0.5) / scale - 0.5
    at = np.floor(center).astype(int)[:, None] + np.arange(-reach, reach + 1)
    w = stretch * cubic(stretch * (center[:, None] - at))
    w /= w.sum(axis=1, keepdims=True)
    mirrored = at % (2 * n)
    mirrored = np.where(mirrored >= n, 2 * n - 1 - mirrored, mirrored)
    out = np.zeros((m, n))
    np.add.at(out, (np.repeat(np.arange(m), at.shape[1]), mirrored.ravel()), w.ravel())
    return out


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Rows x columns (x channels) to ``height`` x ``width``."""
    down = np.tensordot(weights(image.shape[0], height), image, (1, 0))
    return np.moveaxis(np.tensordot(weights(image.shape[1], width), down, (1, 1)), 0, 1)


def rotate(image: np.ndarray, degrees: float) -> np.ndarray:
    """The whole image turned about its center into the smallest upright frame that holds it; zero outside.

    A point at p from the old center is at R p from the new one, R = [c s; -s c]
    for (u, v): see ``rotate_points``.
    """
    h, w = image.shape[:2]
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    wide, high = (int(np.ceil(x - 1e-9)) for x in (abs(c) * w + abs(s) * h, abs(s) * w + abs(c) * h))
    a, b = np.meshgrid(np.arange(wide) - (wide - 1) / 2, np.arange(high) - (high - 1) / 2)
    u, v = c * a - s * b + (w - 1) / 2, s * a + c * b + (h - 1) / 2
    padded = np.pad(image, ((2, 2), (2, 2)) + ((0, 0),) * (image.ndim - 2))
    left, top = np.floor(u).astype(int), np.floor(v).astype(int)
    out = np.zeros((high, wide) + image.shape[2:])
    inside = (u > -1) & (u < w) & (v > -1) & (v < h)
    for i in range(-1, 3):
        for j in range(-1, 3):
            part = cubic(v - top - i) * cubic(u - left - j)
            rows, cols = np.clip(top + i + 2, 0, h + 3), np.clip(left + j + 2, 0, w + 3)
            taken = padded[rows, cols]
            out += np.where(inside, part, 0.0).reshape(part.shape + (1,) * (image.ndim - 2)) * taken
    return out
