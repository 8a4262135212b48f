"""Least-squares fits of short curves (the lags of a correlation): stretched and double exponentials, and what follows from them.

A curve has a bounded number of lags; curves are fitted in parallel, one group each.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def kww(t, tau, beta):
    return np.exp(-((np.maximum(t, 0) / abs(tau)) ** beta))


def bi_exp(t, a, tau1, tau2):
    return a * np.exp(-t / tau1) + (1 - a) * np.exp(-t / tau2)


def least_squares(f: Callable, t: np.ndarray, y: np.ndarray, start: list[float], rounds: int = 500) -> np.ndarray:
    """Damped Gauss-Newton with a central-difference Jacobian; returns the best parameters found, NaN if none are finite."""
    p, lam = np.array(start, float), 1e-2
    with np.errstate(all="ignore"):
        r = y - f(t, *p)
        best = r @ r
        for _ in range(rounds):
            h = 1e-6 * np.maximum(np.abs(p), 1e-6)
            jac = np.stack([(f(t, *(p + d)) - f(t, *(p - d))) / (2 * d.sum()) for d in np.diag(h)], 1)
            a, g = jac.T @ jac, jac.T @ r
            if not (np.isfinite(a).all() and np.isfinite(g).all()):
                break
            step = np.linalg.lstsq(a + lam * np.diag(np.maximum(np.diag(a), 1e-12)), g, rcond=None)[0]
            q = p + step
            s = y - f(t, *q)
            cost = s @ s
            if np.isfinite(cost) and cost < best:
                done = best - cost <= 1e-14 * best + 1e-300 and np.abs(step).max() <= 1e-10 * np.abs(p).max()
                p, r, best, lam = q, s, cost, max(lam / 5, 1e-12)
                if done:
                    break
            else:
                lam *= 4
                if lam > 1e12:
                    break
    return p if np.isfinite(best) else np.full(len(start), np.nan)


def fit_curves(curves: DataFrame, keys: list[str], t: str, y: str, f: Callable, names: list[str], start: list[float]) -> DataFrame:
    """(keys, parameters): one row per curve; curves with fewer points than parameters give nulls."""
    types = dict(curves.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.dropna(subset=[t, y]).sort_values(t)
        p = least_squares(f, c[t].to_numpy(float), c[y].to_numpy(float), start) if len(c) >= len(names) else [None] * len(names)
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {n: [v] for n, v in zip(names, p, strict=True)})

    return curves.select(*keys, t, y).groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + "".join(f", {n} double" for n in names))


def fit_kww(curves: DataFrame, keys: list[str], t: str = "t", y: str = "c", tau: float = 1.0, beta: float = 0.4) -> DataFrame:
    return fit_curves(curves, keys, t, y, kww, ["tau", "beta"], [tau, beta])


def fit_bi_exp(curves: DataFrame, keys: list[str], t: str = "t", y: str = "c", a: float = 0.5, tau1: float = 100.0, tau2: float = 150.0) -> DataFrame:
    return fit_curves(curves, keys, t, y, bi_exp, ["a", "tau1", "tau2"], [a, tau1, tau2])


def lifetime(a: float, tau1: float, tau2: float) -> float:
    """Integral of the double exponential from 0 on."""
    if tau1 <= 0 or tau2 <= 0:
        raise ValueError("the integral needs positive times")
    return a * tau1 + (1 - a) * tau2


def kww_mean_time(tau: float, beta: float) -> float:
    return tau / beta * math.gamma(1 / beta)
