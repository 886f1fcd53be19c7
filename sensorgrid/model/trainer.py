"""Build, update and apply the model on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorgrid.config import Roles
from sensorgrid.functions import scalar
from sensorgrid.functions.kernels import Kernel, get_kernel, kernel_from_json, scaled
from sensorgrid.model.linalg import JITTER
from sensorgrid.model.posterior import STATE_SCHEMA, Posterior, first_fits, online_updates, refreshed_points
from sensorgrid.model.statistics import BLOCK_ROWS, X_COLUMNS, Statistics, sufficient_statistics
from sensorgrid.operators.aggregates import fit_target
from sensorgrid.operators.sampling import DEFAULT_SEED, sampled_rows
from sensorgrid.session import spread_if_small

NORMAL_95 = 1.96
KEEP = 0.7
# Settings tried on the driver; noise and amplitude need no further pass over the data.
NOISES = (1.0, 0.5, 0.25, 0.1, 0.05)
AMPLITUDES = (1.0, 0.5, 0.2, 0.1, 2.0)


@dataclass(frozen=True)
class TargetScale:
    """Fitted transform: standardised log target, hours since the start."""

    mean: float
    sd: float
    start: datetime

    @staticmethod
    def fit(df: DataFrame, roles: Roles = Roles()) -> "TargetScale":
        row = fit_target(df, roles.target, roles.time).withColumn("start", F.col("start").cast("timestamp")).first()
        return TargetScale(row["mean"], row["sd"], row["start"])

    def apply(self, df: DataFrame, roles: Roles = Roles()) -> DataFrame:
        """Add the model inputs ``t, lon, lat`` and the scaled target ``z``."""
        columns = self.inputs(roles)
        columns["z"] = scalar.standardise_log(roles.target, F.lit(self.mean), F.lit(self.sd))
        return df.withColumns(columns)

    def inputs(self, roles: Roles = Roles()) -> dict:
        """Model inputs of a row: hours, longitude, latitude."""
        return {
            "t": scalar.hours_since(F.col(roles.time), F.lit(self.start)),
            "lon": F.col(roles.lon).cast("double"),
            "lat": F.col(roles.lat).cast("double"),
        }

    def invert(self, z):
        """Column or array on the scale of the target."""
        if isinstance(z, np.ndarray):
            return np.exp(z * self.sd + self.mean)
        return scalar.unstandardise_log(z, F.lit(self.mean), F.lit(self.sd))


def draw_points(scaled_rows: DataFrame, m: int, seed: int = DEFAULT_SEED) -> np.ndarray:
    """``m`` random inducing points among the different places and times of the rows."""
    places = scaled_rows.select(*X_COLUMNS).na.drop().distinct()
    return sampled_rows(places, m, X_COLUMNS, seed).toPandas()[X_COLUMNS].to_numpy(float)


@dataclass
class Choice:
    """A parameter setting and its bound."""

    kernel: Kernel
    noise: float
    posterior: Posterior


def rank_first(
    stats: Sequence[Statistics], kernels: Sequence[Kernel], z: np.ndarray,
    noises: Sequence[float] = NOISES, amplitudes: Sequence[float] = AMPLITUDES, jitter: float = JITTER,
) -> list[Choice]:
    """All settings by falling bound, from one set of statistics per kernel.

    Noise enters after the sums and an amplitude only scales them, so both are
    searched without touching the data again.
    """
    out = []
    for kernel, s in zip(kernels, stats):
        for factor in amplitudes:
            k = scaled(kernel, factor)
            out += [Choice(k, p.noise, p) for p in first_fits(k, noises, z, s.scaled(factor), jitter)]
    return sorted(out, key=lambda c: -c.posterior.bound)


@dataclass
class SparseModel:
    """Sparse Gaussian process over hours, longitude and latitude.

    ``points`` gives the inducing points of the first fit; without it they are drawn from the rows.
    An update keeps the part ``keep`` of them and draws the rest from the new rows.
    """

    scale: TargetScale
    kernels: Sequence[Kernel] = field(default_factory=lambda: (get_kernel("basic"),))
    roles: Roles = Roles()
    seed: int = DEFAULT_SEED
    noises: Sequence[float] = NOISES
    amplitudes: Sequence[float] = AMPLITUDES
    points: np.ndarray | None = None
    keep: float = KEEP
    jitter: float = JITTER
    posterior: Posterior | None = None
    updates: int = 0

    def build(self, df: DataFrame, m: int = 200) -> "SparseModel":
        """Fit to the first period; of the candidate settings the best bound wins."""
        rows = self.scale.apply(df, self.roles)
        z = self._first_points(rows, m)
        stats = sufficient_statistics(rows, {0: z}, self.kernels)
        per_kernel = [stats[(0, c)] for c in range(len(self.kernels))]
        self.posterior = rank_first(per_kernel, self.kernels, z, self.noises, self.amplitudes, self.jitter)[0].posterior
        return self

    def evidence(self, df: DataFrame, m: int = 200) -> DataFrame:
        """Bound of every candidate setting: ``candidate, kernel, noise, bound``."""
        rows = self.scale.apply(df, self.roles)
        z = self._first_points(rows, m)
        stats = sufficient_statistics(rows, {0: z}, self.kernels)
        per_kernel = [stats[(0, c)] for c in range(len(self.kernels))]
        ranked = rank_first(per_kernel, self.kernels, z, self.noises, self.amplitudes, self.jitter)
        table = [(i, c.kernel.to_json(), float(c.noise), c.posterior.bound) for i, c in enumerate(ranked)]
        return df.sparkSession.createDataFrame(table, "candidate int, kernel string, noise double, bound double")

    def _first_points(self, rows: DataFrame, m: int) -> np.ndarray:
        return draw_points(rows, m, self.seed) if self.points is None else np.asarray(self.points, float)

    def _ready(self) -> Posterior:
        if self.posterior is None:
            raise ValueError("build() has to run before update() and predict()")
        return self.posterior

    def update(self, df: DataFrame) -> "SparseModel":
        """Add a batch; nothing of earlier batches is read again."""
        old = self._ready()
        rows = self.scale.apply(df, self.roles)
        self.updates += 1
        m = len(old.z)
        fresh = m - int(self.keep * m)
        new = draw_points(rows, fresh, self.seed + self.updates) if fresh else old.z[:0]
        if fresh and len(new) == 0:
            return self
        z = refreshed_points(old.z, new, self.seed + self.updates, self.keep)
        stats = sufficient_statistics(rows, {0: z}, [old.kernel])
        if stats:
            self.posterior = best_update(old, z, stats[(0, 0)], self.noises)
        return self

    def predict(self, df: DataFrame, reference_variance: bool = False) -> DataFrame:
        """Rows with ``pred, var_latent, low, high``."""
        return predict_rows(df, {0: self._ready()}, self.scale, None, self.roles, reference_variance)

    def state(self, spark: SparkSession) -> DataFrame:
        """One-row state table."""
        s = self.scale
        row = {
            **self._ready().to_row(), "mean": float(s.mean), "sd": float(s.sd), "start": s.start, "updates": self.updates,
        }
        return spark.createDataFrame([row], STATE_SCHEMA + ", mean double, sd double, start timestamp, updates int")

    @staticmethod
    def from_state(state: DataFrame, **options) -> "SparseModel":
        row = state.first()
        scale = TargetScale(row["mean"], row["sd"], row["start"])
        return SparseModel(
            scale, kernels=(kernel_from_json(row["kernel"]),), posterior=Posterior.from_row(row),
            updates=row["updates"], **options,
        )


def best_update(old: Posterior, z: np.ndarray, stats: Statistics, noises: Sequence[float]) -> Posterior:
    """Online update with the noise of the best bound; the old noise is among those tried."""
    tried = sorted({old.noise, *noises})
    return max(online_updates(old, old.kernel, tried, z, stats), key=lambda p: p.bound)


def predict_rows(
    df: DataFrame,
    models: Mapping[int, Posterior],
    scale: TargetScale,
    group: str | None = None,
    roles: Roles = Roles(),
    reference_variance: bool = False,
) -> DataFrame:
    """Append predictions, each row by the model of its group.

    Row-parallel: the models (a few M x M matrices) travel with the task.  ``low`` and
    ``high`` bound 95 % of the latent value.  ``reference_variance`` adds ``var``, the
    variance pushed through the target transform.
    """
    names = [f.name for f in df.schema.fields]
    added = ["pred", "var_latent", "low", "high"] + (["var"] if reference_variance else [])
    schema = T.StructType(
        df.schema.fields + [T.StructField(n, T.DoubleType()) for n in added]
    )
    models = dict(models)
    key = F.col(group).cast("bigint") if group else F.lit(0).cast("bigint")
    at = [c.alias(f"_{n}") for n, c in scale.inputs(roles).items()]
    inputs = df.select(*names, key.alias("_grp"), *at)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mean, var = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
            grp = pdf["_grp"].to_numpy()
            x = pdf[[f"_{c}" for c in X_COLUMNS]].to_numpy(float)
            known = ~np.isnan(x).any(axis=1)
            for g in np.unique(grp):
                model = models.get(int(g))
                if model is None:
                    continue
                here = np.flatnonzero((grp == g) & known)
                for first in range(0, len(here), BLOCK_ROWS):
                    part = here[first : first + BLOCK_ROWS]
                    mean[part], var[part] = model.mean_var(x[part])
            sd = np.sqrt(np.maximum(var, 0.0))
            out = pdf[names].copy()
            out["pred"], out["var_latent"] = scale.invert(mean), var
            out["low"], out["high"] = scale.invert(mean - NORMAL_95 * sd), scale.invert(mean + NORMAL_95 * sd)
            if reference_variance:
                out["var"] = scale.invert(var)
            yield out

    return spread_if_small(inputs, F.xxhash64(*inputs.columns)).mapInPandas(run, schema)

