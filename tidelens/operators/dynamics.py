"""Generators: trajectories of dynamical systems, one per row of a frame of initial states and parameters.

A recurrence is sequential in time, so a trajectory is made in one task; ensembles run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

Field = Callable[[np.ndarray, np.ndarray], np.ndarray]


def lorenz(s: np.ndarray, p: np.ndarray) -> np.ndarray:
    """p = sigma, rho, beta; states and parameters are rows of an ensemble."""
    x, y, z = s.T
    return np.stack([p[:, 0] * (y - x), x * (p[:, 1] - z) - y, x * y - p[:, 2] * z], axis=1)


def rossler(s: np.ndarray, p: np.ndarray) -> np.ndarray:
    """p = a, b, c."""
    x, y, z = s.T
    return np.stack([-y - z, x + p[:, 0] * y, p[:, 1] + z * (x - p[:, 2])], axis=1)


def cusp(s: np.ndarray, p: np.ndarray) -> np.ndarray:
    """p = r, h: h + r x - x^3."""
    return p[:, 1:2] + p[:, 0:1] * s - s**3


FIELDS: dict[str, tuple[Field, int]] = {"lorenz": (lorenz, 3), "rossler": (rossler, 3), "cusp": (cusp, 1)}


def euler(field: Field, s: np.ndarray, p: np.ndarray, dt: float) -> np.ndarray:
    return s + dt * field(s, p)


def rk4(field: Field, s: np.ndarray, p: np.ndarray, dt: float) -> np.ndarray:
    a = field(s, p)
    b = field(s + dt / 2 * a, p)
    c = field(s + dt / 2 * b, p)
    d = field(s + dt * c, p)
    return s + dt / 6 * (a + 2 * b + 2 * c + d)


STEPS = {"euler": euler, "rk4": rk4}


def trajectories(starts: DataFrame, system: str | Field, dt: float, steps: int, method: str = "rk4", noise: str | None = None, spinup: int = 0, sampling: int = 1, seed: int = 0, dim: int | None = None, drift_rate: float = 0.0) -> DataFrame:
    """(id, t, x, ...) of ``starts`` (id, state array, params array[, q array]).

    After ``spinup`` steps, every ``sampling``-th of ``steps`` states is kept; the initial one is not. ``noise`` adds
    Euler-Maruyama increments: 'additive' q dW, 'linear' q dW * state; draws depend on (seed, id) alone. For the cusp,
    ``drift_rate`` moves its last parameter in time, through spin-up and record alike.
    """
    field, n = FIELDS[system] if isinstance(system, str) else (system, dim or 1)
    axes = list("xyz")[:n] if n <= 3 else [f"x{k}" for k in range(n)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 256):
                part = pdf.iloc[a : a + 256]
                ids, s, p = part["id"].to_numpy(), np.stack(part["state"]).astype(float), np.stack(part["params"]).astype(float)
                q = np.stack(part["q"]).astype(float) if noise else None
                draws = [np.random.default_rng([seed, int(i)]) for i in ids]
                kept: list[np.ndarray] = []
                for k in range(1, spinup + steps + 1):
                    s0, s = s, STEPS[method](field, s, p, dt)
                    if noise:
                        dw = q * np.sqrt(dt) * np.stack([r.standard_normal(n) for r in draws])
                        s = s + (dw if noise == "additive" else dw * s0)
                    if drift_rate:
                        p = p.copy()
                        p[:, -1] += drift_rate * dt
                    if k > spinup and (k - spinup) % sampling == 0:
                        kept.append(s)
                if kept:
                    out = np.stack(kept)
                    yield pd.DataFrame({"id": np.tile(ids, len(out)), "t": np.repeat(np.arange(1, len(out) + 1), len(ids)), **{c: out[:, :, k].ravel() for k, c in enumerate(axes)}})

    return starts.mapInPandas(run, "id long, t long, " + ", ".join(f"{c} double" for c in axes))


class TrajectoryRows:
    """Table function (system, state, params, dt, steps, method) -> (t, x, y, z): a row for each state after the initial one,
    with nulls for axes that the system lacks; unlike ``trajectories`` it can stand in SQL, beside the row that calls it."""

    def eval(self, system: str, state: list[float], params: list[float], dt: float, steps: int, method: str) -> Iterator[tuple]:
        if state is None or params is None or any(v is None for v in (*state, *params)):
            return
        field, n = FIELDS[system]
        s, p = np.array([state], float), np.array([params], float)
        for t in range(1, steps + 1):
            s = STEPS[method](field, s, p, dt)
            yield (t, *s[0].tolist(), *[None] * (3 - n))


trajectory_rows = udtf(TrajectoryRows, returnType="t bigint, x double, y double, z double")


def register_table_functions(spark: SparkSession) -> None:
    """``trajectory(system, state, params, dt, steps, method)`` for SQL: FROM starts, LATERAL trajectory(...)."""
    spark.udtf.register("trajectory", trajectory_rows)
