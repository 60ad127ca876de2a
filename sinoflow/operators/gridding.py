"""Non-uniform Fourier transforms in two dimensions by gridding.

Points are spread onto, or read off, a grid twice as fine as the modes with a smooth kernel of a few grid steps (an
exponential of a semicircle, Barnett, Magland and af Klinteberg 2019), an FFT goes between grid and modes, and the modes
are divided by the kernel's transform.
"""

from __future__ import annotations

import numpy as np


def _good(n: int) -> int:
    """The least even number of ``n`` or more whose factors are 2, 3 and 5."""
    while True:
        n += n % 2
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 2


class Axis:
    """One axis of ``n`` modes -n//2 .. : the finer grid, the kernel's transform at the modes, and what lies near a point."""

    def __init__(self, n: int, eps: float) -> None:
        self.n, self.wide = n, min(16, max(3, int(np.ceil(-np.log10(eps))) + 2))
        self.fine = max(_good(2 * n), 2 * self.wide)
        self.beta = 2.3 * self.wide
        z, weight = np.polynomial.legendre.leggauss(64 + 2 * self.wide)
        k = np.arange(n) - n // 2
        waves = np.cos(np.outer(k * (np.pi * self.wide / self.fine), z))
        self.kernel = waves @ (weight * np.exp(self.beta * (np.sqrt(1 - z * z) - 1))) * self.wide / 2
        self.place = k % self.fine

    def near(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(grid places, kernel values) about each point."""
        u = np.mod(at / (2 * np.pi) * self.fine, self.fine)
        first = np.ceil(u - self.wide / 2).astype(np.int64)
        step = first[:, None] + np.arange(self.wide)
        z = np.clip((step - u[:, None]) * (2 / self.wide), -1, 1)
        return step % self.fine, np.exp(self.beta * (np.sqrt(1 - z * z) - 1))


class Gridding:
    """Modes -n//2 .. in both axes against waves at the points (x, y), in radians."""

    def __init__(self, x: np.ndarray, y: np.ndarray, n: int, eps: float) -> None:
        axis = Axis(n, eps)
        self.n, self.wide, self.fine, self.kernel, self.place = n, axis.wide, axis.fine, axis.kernel, axis.place
        self.x, self.y = axis.near(x), axis.near(y)

    def from_points(self, values: np.ndarray) -> np.ndarray:
        """out[j, k] = sum of value * exp(i (k x + j y)) over the points."""
        (ix, wx), (iy, wy) = self.x, self.y
        grid = np.zeros(self.fine * self.fine, complex)
        for a in range(self.wide):
            part, row = values * wy[:, a], iy[:, a] * self.fine
            for b in range(self.wide):
                np.add.at(grid, row + ix[:, b], part * wx[:, b])
        modes = np.fft.ifft2(grid.reshape(self.fine, self.fine)) * self.fine**2
        return modes[np.ix_(self.place, self.place)] / np.outer(self.kernel, self.kernel)

    def to_points(self, image: np.ndarray) -> np.ndarray:
        """out = sum of image[j, k] * exp(-i (k x + j y)) at each point."""
        grid = np.zeros((self.fine, self.fine), complex)
        grid[np.ix_(self.place, self.place)] = image / np.outer(self.kernel, self.kernel)
        grid = np.fft.fft2(grid).reshape(-1)
        (ix, wx), (iy, wy) = self.x, self.y
        out = np.zeros(len(ix), complex)
        for a in range(self.wide):
            row, line = iy[:, a] * self.fine, np.zeros(len(ix), complex)
            for b in range(self.wide):
                line += grid[row + ix[:, b]] * wx[:, b]
            out += line * wy[:, a]
        return out
