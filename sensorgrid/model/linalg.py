"""Small dense solves on the driver; M x M with M of a few hundred at most."""

from __future__ import annotations

import logging

import numpy as np

JITTER = 1e-6
_log = logging.getLogger(__name__)


def cholesky(a: np.ndarray, jitter: float = JITTER, tries: int = 3) -> tuple[np.ndarray, float]:
    """Lower factor of a symmetric matrix and what was added to its diagonal; a failed try adds ten times more."""
    a = (a + a.T) / 2.0
    extra = 0.0
    for attempt in range(tries + 1):
        try:
            return np.linalg.cholesky(a + extra * np.eye(len(a))), extra
        except np.linalg.LinAlgError:
            if attempt == tries:
                raise
            extra = jitter if extra == 0.0 else extra * 10.0
            _log.warning("matrix not positive definite, jitter raised to %g", extra)
    raise AssertionError


def lower_inverse(lower: np.ndarray) -> np.ndarray:
    return np.tril(np.linalg.solve(lower, np.eye(len(lower))))


def log_diag(lower: np.ndarray) -> float:
    return float(np.log(np.diag(lower)).sum())


def symmetric(upper: np.ndarray) -> np.ndarray:
    """Full matrix from its upper triangle."""
    return np.triu(upper) + np.triu(upper, 1).T
