"""Separable resampling of 8-bit images, with weights and intermediate sums in fixed point."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Bits behind the point of a weight.
FRACTION = 22


def lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def bicubic(x: np.ndarray) -> np.ndarray:
    """The cubic of slope -1/2."""
    x = np.abs(x)
    near, far = (1.5 * x - 2.5) * x * x + 1, ((-0.5 * x + 2.5) * x - 4) * x + 2
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


#: Kernels, and how far they reach.
KERNELS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], int]] = {"lanczos": (lanczos, 3), "bicubic": (bicubic, 2)}


def weights(n: int, m: int, kernel: str) -> np.ndarray:
    """What each of ``n`` samples adds to each of ``m``, in whole numbers that stand for 2 ** -FRACTION.

    Where the image shrinks, the kernel is as much wider. It is cut off at the border, and its weights add up to one
    before they are rounded, halves away from zero.
    """
    shape, reach = KERNELS[kernel]
    scale = n / m
    wide = max(scale, 1.0)
    out = np.zeros((m, n))
    for k in range(m):
        centre = (k + 0.5) * scale
        low, high = max(0, int(centre - reach * wide + 0.5)), min(n, int(centre + reach * wide + 0.5))
        w = shape((np.arange(low, high) - centre + 0.5) / wide)
        w = w / w.sum() * (1 << FRACTION)
        out[k, low:high] = np.trunc(w + np.copysign(0.5, w))
    return out


def _pass(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows of ``x`` by the weights: sums are rounded to bytes. All numbers are whole and below 2 ** 53, so they are exact."""
    return np.clip(np.floor((x @ w.T + (1 << FRACTION - 1)) / (1 << FRACTION)), 0, 255)


def resize(x: np.ndarray, height: int, width: int, kernel: str) -> np.ndarray:
    """A matrix of bytes in another size: along the rows first, then along the columns; a side that stays is left alone."""
    x = x.astype(float)
    if x.shape[1] != width:
        x = _pass(x, weights(x.shape[1], width, kernel))
    if x.shape[0] != height:
        x = _pass(x.T, weights(x.shape[0], height, kernel)).T
    return x.astype(np.uint8)


def luma(rgb: np.ndarray) -> np.ndarray:
    """Bytes of luminance, by weights in 16 bits."""
    x = rgb.astype(np.int64)
    return ((x[..., 0] * 19595 + x[..., 1] * 38470 + x[..., 2] * 7471 + 0x8000) >> 16).astype(np.uint8)
