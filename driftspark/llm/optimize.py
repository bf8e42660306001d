"""Limited-memory BFGS for the small models that are fitted on bounded tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimize(
    loss: Callable[[np.ndarray], tuple[float, np.ndarray]],
    start: np.ndarray,
    iterations: int = 100,
    memory: int = 8,
    tolerance: float = 1e-5,
) -> np.ndarray:
    """A minimum of a smooth convex ``loss``, which returns its value and its gradient."""
    x = start.astype(float)
    value, gradient = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(iterations):
        if np.abs(gradient).max() < tolerance:
            break
        direction = gradient.copy()
        factors = []
        for s, y, rho in reversed(steps):
            factor = rho * (s @ direction)
            direction -= factor * y
            factors.append(factor)
        if steps:
            s, y, _ = steps[-1]
            direction *= (s @ y) / (y @ y)
        else:
            direction /= max(1.0, np.sqrt(gradient @ gradient))
        for (s, y, rho), factor in zip(steps, reversed(factors), strict=True):
            direction += (factor - rho * (y @ direction)) * s
        slope = -(gradient @ direction)
        step = 1.0
        while True:
            moved = x - step * direction
            new_value, new_gradient = loss(moved)
            if new_value <= value + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        if step < 1e-10:
            break
        s, y = moved - x, new_gradient - gradient
        if s @ y > 1e-12:
            steps = [*steps, (s, y, 1 / (s @ y))][-memory:]
        x, value, gradient = moved, new_value, new_gradient
    return x
