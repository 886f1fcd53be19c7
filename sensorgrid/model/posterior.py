"""Sparse posterior from sufficient statistics: first fit, online update, bound.

The first fit is the collapsed variational sparse GP.  The update keeps the old
posterior at the old inducing points and adds a batch (streaming sparse GP, Bui,
Nguyen and Turner, 2017).  Everything here works on M x M matrices.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from sensorgrid.functions.kernels import Kernel, kernel_from_json
from sensorgrid.model.linalg import JITTER, cholesky, log_diag, lower_inverse
from sensorgrid.model.statistics import Statistics


@dataclass(frozen=True)
class Posterior:
    """What prediction needs: two whitening matrices and a weight vector."""

    kernel: Kernel
    noise: float
    z: np.ndarray
    prior_white: np.ndarray  # inverse of the factor of K(Z, Z)
    post_white: np.ndarray  # inverse of the factor of the posterior precision, times prior_white
    weights: np.ndarray
    bound: float
    jitter: float = JITTER  # on the diagonal of covariance matrices; 0 for few, well separated points
    extra_jitter: float = 0.0  # the most that a failed factorisation added to a diagonal, in this fit or an earlier one

    def mean_var(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Latent mean and variance at rows ``x``; no noise is added."""
        k = self.kernel.matrix(self.z, x)
        post = self.post_white @ k
        prior = self.prior_white @ k
        return post.T @ self.weights, self.kernel.diagonal(x) - (prior**2).sum(0) + (post**2).sum(0)

    def at_points(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean, full covariance and prior covariance at the inducing points."""
        k = self.kernel.matrix(self.z, self.z)
        post, prior = self.post_white @ k, self.prior_white @ k
        cov = k + self.jitter * np.eye(len(k)) - prior.T @ prior + post.T @ post
        return post.T @ self.weights, cov, k

    def to_row(self) -> dict:
        """Plain values for a one-row state table."""
        return {
            "kernel": self.kernel.to_json(),
            "noise": float(self.noise),
            "bound": float(self.bound),
            "m": len(self.z),
            "z": self.z.ravel().tolist(),
            "prior_white": self.prior_white.ravel().tolist(),
            "post_white": self.post_white.ravel().tolist(),
            "weights": self.weights.tolist(),
            "jitter": float(self.jitter),
            "extra_jitter": float(self.extra_jitter),
        }

    @staticmethod
    def from_row(row) -> "Posterior":
        m = row["m"]
        return Posterior(
            kernel_from_json(row["kernel"]),
            row["noise"],
            np.array(row["z"]).reshape(m, -1),
            np.array(row["prior_white"]).reshape(m, m),
            np.array(row["post_white"]).reshape(m, m),
            np.array(row["weights"]),
            row["bound"],
            row["jitter"],
            row["extra_jitter"],
        )


STATE_SCHEMA = (
    "kernel string, noise double, bound double, m int, z array<double>, prior_white array<double>, "
    "post_white array<double>, weights array<double>, jitter double, extra_jitter double"
)


def _data_terms(stats: Statistics, noise: float) -> float:
    return -0.5 * (
        stats.n * (math.log(2.0 * math.pi) + math.log(noise)) + stats.yy / noise + stats.kd / noise
    )


def first_fits(
    kernel: Kernel, noises: Sequence[float], z: np.ndarray, stats: Statistics, jitter: float = JITTER
) -> list[Posterior]:
    """Posterior and bound from the statistics of all rows so far, one per noise."""
    eye = np.eye(len(z))
    lower, extra = cholesky(kernel.matrix(z, z) + jitter * eye)
    white = lower_inverse(lower)
    spread, reach = white @ stats.a @ white.T, white @ stats.b
    out = []
    for noise in noises:
        gain = spread / noise
        factor, more = cholesky(eye + gain)
        weights = np.linalg.solve(factor, reach) / noise
        bound = _data_terms(stats, noise) - log_diag(factor) + 0.5 * weights @ weights + 0.5 * np.trace(gain)
        post = np.linalg.solve(factor, white)
        out.append(Posterior(kernel, noise, z, white, post, weights, float(bound), jitter, max(extra, more)))
    return out


def first_fit(kernel: Kernel, noise: float, z: np.ndarray, stats: Statistics) -> Posterior:
    return first_fits(kernel, [noise], z, stats)[0]


def online_updates(
    old: Posterior, kernel: Kernel, noises: Sequence[float], z: np.ndarray, stats: Statistics
) -> list[Posterior]:
    """Posterior after a batch, given only its statistics and the old posterior, one per noise."""
    mean_old, cov_old, prior_old = old.at_points()
    eye_old, eye = np.eye(len(old.z)), np.eye(len(z))
    jitter = old.jitter
    prior_old = prior_old + jitter * eye_old
    cross = kernel.matrix(z, old.z)

    (cov_factor, by_cov_old), (prior_factor, by_prior_old) = cholesky(cov_old), cholesky(prior_old)
    cov_white, prior_old_white = lower_inverse(cov_factor), lower_inverse(prior_factor)
    lower, extra = cholesky(kernel.matrix(z, z) + jitter * eye)
    white = lower_inverse(lower)
    extra = max(extra, by_cov_old, by_prior_old, old.extra_jitter)

    seen = white @ cross
    by_cov, by_prior = cov_white @ seen.T, prior_old_white @ seen.T
    carried = eye * (1.0 + jitter) + by_cov.T @ by_cov - by_prior.T @ by_prior
    spread, reach = white @ stats.a @ white.T, white @ stats.b
    old_weights = cov_white @ mean_old
    old_reach = seen @ (cov_white.T @ old_weights)

    left = kernel.matrix(old.z, old.z) + jitter * eye_old - seen.T @ seen
    trace = np.sum((cov_white @ left) * cov_white) - np.sum((prior_old_white @ left) * prior_old_white)
    fixed = -0.5 * old_weights @ old_weights + log_diag(prior_factor) - log_diag(cov_factor) - 0.5 * trace
    out = []
    for noise in noises:
        gain = spread / noise
        factor, more = cholesky(carried + gain)
        weights = np.linalg.solve(factor, reach / noise + old_reach)
        bound = (
            _data_terms(stats, noise) + fixed + 0.5 * np.trace(gain) + 0.5 * weights @ weights - log_diag(factor)
        )
        post = np.linalg.solve(factor, white)
        out.append(Posterior(kernel, noise, z, white, post, weights, float(bound), jitter, max(extra, more)))
    return out


def online_update(old: Posterior, kernel: Kernel, noise: float, z: np.ndarray, stats: Statistics) -> Posterior:
    return online_updates(old, kernel, [noise], z, stats)[0]


def refreshed_points(z_old: np.ndarray, new_points: np.ndarray, seed: int, keep: float = 0.7) -> np.ndarray:
    """Inducing points of the next model: a random part of the old ones and new rows.

    Their number stays the same as long as enough new rows are given.
    """
    m = len(z_old)
    kept = int(keep * m)
    order = np.random.default_rng(seed).permutation(m)[:kept]
    return np.vstack([z_old[order], new_points[: m - kept]])

