"""FTRL-proximal (McMahan et al. 2013) over sparse features, one or more outputs."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Per-coordinate learning rates; L1 keeps a weight at zero until its evidence exceeds it."""

    def __init__(self, features: int, outputs: int = 1, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((features, outputs))
        self.n = np.zeros((features, outputs))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def update(self, at: np.ndarray, gradient: np.ndarray, weights: np.ndarray) -> None:
        """One step on the coordinates `at`, each given once, at their present weights."""
        n = self.n[at]
        grown = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * weights
        self.n[at] = grown
