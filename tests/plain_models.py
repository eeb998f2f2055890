"""Generalised and robust least squares by matrices, for one series."""

import numpy as np


def ar1_covariance(n: int, rho: float) -> np.ndarray:
    return rho ** np.abs(np.subtract.outer(np.arange(n), np.arange(n)))


def _gls(x: np.ndarray, y: np.ndarray, covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    root = np.linalg.cholesky(np.linalg.inv(covariance)).T
    a, b = root @ x, root @ y
    beta, *_ = np.linalg.lstsq(a, b, rcond=None)
    rest = b - a @ beta
    return beta, np.linalg.inv(a.T @ a) * (rest @ rest) / max(len(y) - 2, 1)


def fit_model(x: np.ndarray, y: np.ndarray, model: str, mode: str = "textbook") -> tuple[float, float, float]:
    """Intercept, slope and t of 'ols', 'gls-ar1', 'gls-hs' or 'rls'. mode 'inverted' weighs by the inverse covariance
    as if it were the covariance."""
    design = np.column_stack([np.ones_like(x), x])
    beta, cov = _gls(design, y, np.eye(len(x)))
    rest = y - design @ beta
    if model in ("gls-ar1", "gls-hs"):
        if model == "gls-ar1":
            e = rest - rest.mean()
            sigma = ar1_covariance(len(x), float((e[1:] * e[:-1]).sum() / (e * e).sum()))
        else:
            variance = design @ _gls(design, rest**2, np.eye(len(x)))[0]
            sigma = np.diag(np.maximum(variance, 1e-6 * max(variance.max(), 1e-300)))
        beta, cov = _gls(design, y, np.linalg.inv(sigma) if mode == "inverted" else sigma)
    elif model == "rls":
        for _ in range(50):
            scale = np.median(np.abs(rest)) / 0.6744897501960817 or 1e-12  # as robust fits do, about 0
            w = np.minimum(1.0, 1.345 / np.maximum(np.abs(rest / scale), 1e-12))
            new, cov = _gls(design, y, np.diag(1 / w))
            rest = y - design @ new
            done, beta = np.abs(new - beta).max() < 1e-10, new
            if done:
                break
    elif model != "ols":
        raise ValueError(f"unknown model {model}")
    return float(beta[0]), float(beta[1]), float(beta[1] / np.sqrt(cov[1, 1])) if cov[1, 1] > 0 else float("nan")
