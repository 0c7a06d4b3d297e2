"""Follow-the-regularised-leader updates on sparse rows."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """FTRL-proximal for one weight vector: per-coordinate rates, L1 for sparse weights, L2 for small ones."""

    def __init__(self, size: int, alpha: float, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def update(self, at, w: np.ndarray, gradient: np.ndarray) -> None:
        """w: weights(at) that the gradient was taken at; `at` has no slot twice."""
        square = gradient * gradient
        sigma = (np.sqrt(self.n[at] + square) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += gradient - sigma * w
        self.n[at] += square
