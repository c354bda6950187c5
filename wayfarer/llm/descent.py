"""Limited-memory quasi-Newton descent for the small models fitted on bounded samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def descend(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int, memory: int = 6) -> np.ndarray:
    """Minimise `loss` (value and gradient) from `w` in at most `steps` steps with a halving line search."""
    value, gradient = loss(w)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, alphas = -gradient, []
        for s, y in reversed(moves):
            a = (s @ direction) / (s @ y)
            alphas.append(a)
            direction = direction - a * y
        if moves:
            s, y = moves[-1]
            direction = direction * ((s @ y) / (y @ y))
        else:
            direction = direction / max(1e-12, np.abs(direction).max())
        for (s, y), a in zip(moves, reversed(alphas)):
            direction = direction + (a - (y @ direction) / (s @ y)) * s
        slope, size = gradient @ direction, 1.0
        if slope >= -1e-14:
            break
        for _ in range(20):
            new_value, new_gradient = loss(w + size * direction)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = size * direction, new_gradient - gradient
        if s @ y > 1e-14:
            moves = [*moves[1 - memory :], (s, y)] if len(moves) >= memory else [*moves, (s, y)]
        w, value, gradient = w + s, new_value, new_gradient
    return w
