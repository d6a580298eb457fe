"""Non-linear fits of binned tables: bins come from Spark, the few parameters are found on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

#: A fit is made of a histogram; a table with more rows than this isn't one.
MOST_BINS = 10_000


def least_squares(model: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, y: np.ndarray, start: list[float], rounds: int = 200) -> np.ndarray:
    """Parameters that minimise the squared error, by damped Gauss-Newton steps with numerical derivatives."""
    p, damp = np.array(start, float), 1e-3
    error = float(((y - model(x, p)) ** 2).sum())
    for _ in range(rounds):
        base = model(x, p)
        steps = 1e-6 * np.maximum(1e-6, np.abs(p))
        jac = np.stack([(model(x, p + np.eye(len(p))[k] * steps[k]) - base) / steps[k] for k in range(len(p))], 1)
        a = jac.T @ jac
        move = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), jac.T @ (y - base), rcond=None)[0]
        new = float(((y - model(x, p + move)) ** 2).sum())
        if np.isfinite(new) and new < error:
            done = error - new < 1e-14 * max(error, 1e-300)
            p, error, damp = p + move, new, damp / 3
            if done:
                break
        else:
            damp *= 5
            if damp > 1e12:
                break
    return p


def _columns(bins: DataFrame, x: str, y: str) -> tuple[np.ndarray, np.ndarray]:
    rows = bins.select(x, y).limit(MOST_BINS + 1).toPandas().astype(float).dropna()
    if len(rows) > MOST_BINS:
        raise ValueError("a fit takes a table of bins, not of rows")
    return rows[x].to_numpy(), rows[y].to_numpy()


def fit_juttner(bins: DataFrame, mass: float, x: str = "p", y: str = "density", start: float = 0.3) -> tuple[float, float]:
    """(amplitude, temperature) of a p^2 exp(-E / T) density."""
    px, py = _columns(bins, x, y)
    shape = lambda p, w: w[0] * p * p * np.exp(-(np.sqrt(p * p + mass * mass) - mass) / max(abs(w[1]), 1e-9))
    a, t = least_squares(shape, px, py, [float(py.max()) if len(py) else 1.0, start])
    return float(a), abs(float(t))


def fit_log_boltzmann(bins: DataFrame, x: str = "e", y: str = "density") -> tuple[float, float]:
    """(offset, temperature) of ln density = offset - E / T over the bins that aren't empty."""
    ex, ey = _columns(bins, x, y)
    ex, ey = ex[ey > 0], np.log(ey[ey > 0])
    offset, slope = least_squares(lambda e, w: w[0] - w[1] * e, ex, ey, [0.0, 1.0])
    return float(offset), float(1 / slope) if slope else float("inf")
