"""From counts to the expected mid adjustment of each state.

The kernel of a source has at most (states + 1) x states cells, a bound given by
the settings and independent of the data. Smoothing is a projection over the
dense grid; the fixed point is solved source by source in NumPy, all sources in
parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspread.config import Smoothing, SolverSettings, StateSpace
from larkspread.errors import NoConvergence, TooFewObservations
from larkspread.functions.book import state_table
from larkspread.operators.transitions import state_totals
from larkspread.workers import ship_package


def _grid(counts: DataFrame, space: StateSpace, source: str) -> DataFrame:
    return counts.select(source).distinct().withColumn("state", _states(space))


def _states(space: StateSpace) -> Column:
    """One row a state: a number fixed by the settings, a few hundred at most."""
    return F.explode(F.sequence(F.lit(0), F.lit(space.size - 1)))


def kernel(counts: DataFrame, space: StateSpace, smoothing: Smoothing, source: str = "symbol_id") -> DataFrame:
    """(source, from_state, to_state, q, r) over all pairs of states."""
    a, n = smoothing.alpha, space.size
    start = _grid(counts, space, source).withColumnRenamed("state", "from_state")
    visits = state_totals(counts, source).select(source, F.col("state").alias("from_state"), "visits")
    dense = start.join(visits, [source, "from_state"], "left").withColumn("to_state", _states(space))
    dense = dense.join(counts.select(source, "from_state", "to_state", "n_flat", "n_moved"), [source, "from_state", "to_state"], "left").fillna(0, ["visits", "n_flat", "n_moved"])
    below = F.col("visits") + F.lit(a * (n + 1))
    return dense.select(source, "from_state", "to_state", F.try_divide(F.col("n_flat") + F.lit(a), below).alias("q"), F.try_divide(F.col("n_moved").cast("double"), below).alias("r"))


def state_estimates(counts: DataFrame, space: StateSpace, smoothing: Smoothing, source: str = "symbol_id") -> DataFrame:
    """(source, state, visits, g1, p_up) of every state; p_up is null only without
    directional moves and smoothing."""
    a = smoothing.alpha
    rows = _grid(counts, space, source).join(state_totals(counts, source).drop("p_up"), [source, "state"], "left").fillna(0, ["visits", "delta_sum", "up", "down"])
    return rows.select(
        source, "state", "visits", F.try_divide(F.col("delta_sum").cast("double"), F.col("visits") + F.lit(a)).alias("g1"),
        F.try_divide(F.col("up") + F.lit(a), F.col("up") + F.col("down") + F.lit(2 * a)).alias("p_up"),
    )


def dense_arrays(counts: pd.DataFrame, space: StateSpace, smoothing: Smoothing) -> dict[str, np.ndarray]:
    """q, r, g1, p_up (NaN where undefined) and visits of one source's counts."""
    n, a = space.size, smoothing.alpha
    flat, moved = np.zeros((n, n)), np.zeros((n, n))
    i, j = counts["from_state"].to_numpy(np.int64), counts["to_state"].to_numpy(np.int64)
    np.add.at(flat, (i, j), counts["n_flat"].to_numpy(float))
    np.add.at(moved, (i, j), counts["n_moved"].to_numpy(float))
    sums = {c: np.bincount(i, weights=counts[c].to_numpy(float), minlength=n) for c in ("delta_sum", "up", "down")}
    visits = (flat + moved).sum(axis=1)
    if a == 0 and (visits == 0).any():
        raise TooFewObservations(f"state {int(np.argmin(visits > 0))} was never left and alpha is 0")
    below = visits + a * (n + 1)
    directed = sums["up"] + sums["down"] + 2 * a
    with np.errstate(invalid="ignore"):
        p_up = np.where(directed > 0, (sums["up"] + a) / np.where(directed > 0, directed, 1), np.nan)
    return {"q": (flat + a) / below[:, None], "r": moved / below[:, None], "g1": sums["delta_sum"] / (visits + a), "p_up": p_up, "visits": visits.astype(np.int64)}


def solve(step: np.ndarray, g1: np.ndarray, settings: SolverSettings = SolverSettings()) -> tuple[np.ndarray, int]:
    """Fixed point of ``g = g1 + step g`` by repeated substitution from ``g1``, with
    the number of sweeps."""
    g = g1.copy()
    for sweep in range(1, settings.sweeps + 1):
        new = g1 + step @ g
        if np.abs(new - g).max(initial=0.0) < settings.tolerance:
            return new, sweep
        g = new
    raise NoConvergence(f"the largest change is {np.abs(g1 + step @ g - g).max():.3g} after {settings.sweeps} sweeps")


def drift(q: np.ndarray, r: np.ndarray, g1: np.ndarray, g: np.ndarray) -> tuple[float, np.ndarray]:
    """Residual of the fixed point and each state's one-step drift of mid + adjustment."""
    inside = g1 + q @ g - g
    return float(np.abs(inside).max()), inside + r @ g


def adjustments(
    counts: DataFrame, space: StateSpace, smoothing: Smoothing = Smoothing(), settings: SolverSettings = SolverSettings(), full_chain: bool = False, source: str = "symbol_id"
) -> DataFrame:
    """(source, state, visits, g1, p_up, g_star, drift, sweeps) of every state.

    full_chain solves with price-changing transitions in the kernel too."""
    ship_package(counts.sparkSession)
    kind = counts.schema[source].dataType.simpleString()

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = dense_arrays(pdf, space, smoothing)
        g, sweeps = solve(m["q"] + m["r"] if full_chain else m["q"], m["g1"], settings)
        _, d = drift(m["q"], m["r"], m["g1"], g)
        p_up = pd.Series(m["p_up"]).astype("Float64").mask(np.isnan(m["p_up"]))
        return pd.DataFrame({source: key[0], "state": np.arange(space.size, dtype=np.int32), "visits": m["visits"], "g1": m["g1"], "p_up": p_up, "g_star": g, "drift": d, "sweeps": sweeps})

    return counts.groupBy(source).applyInPandas(one, f"{source} {kind}, state int, visits long, g1 double, p_up double, g_star double, drift double, sweeps int")


def martingale_summary(solved: DataFrame, source: str = "symbol_id") -> DataFrame:
    """Per source: largest drift and its first state, mean absolute drift weighted by visits."""
    worst = F.max_by("state", F.struct(F.abs("drift"), -F.col("state")))
    return solved.groupBy(source).agg(
        F.max(F.abs("drift")).alias("max_drift"), worst.alias("max_drift_state"), F.try_divide(F.sum(F.col("visits") * F.abs("drift")), F.sum("visits")).alias("mean_drift")
    )


def antisymmetry(solved: DataFrame, space: StateSpace, source: str = "symbol_id") -> DataFrame:
    """Per source: largest sum of a state's and its mirror's adjustment."""
    mirror = F.broadcast(state_table(solved.sparkSession, space).select("state", "mirror"))
    here = solved.select(source, "state", "g_star").join(mirror, "state")
    there = solved.select(source, F.col("state").alias("mirror"), F.col("g_star").alias("g_mirror"))
    return here.join(there, [source, "mirror"]).groupBy(source).agg(F.max(F.abs(F.col("g_star") + F.col("g_mirror"))).alias("residual"))


def model_summary(solved: DataFrame, source: str = "symbol_id") -> DataFrame:
    """Per source: ranges of adjustments, visits and up-probabilities."""
    return solved.groupBy(source).agg(
        F.min("g_star").alias("g_min"), F.max("g_star").alias("g_max"), F.avg("g_star").alias("g_mean"), F.min("visits").alias("visits_min"), F.max("visits").alias("visits_max"),
        F.count_if(F.col("visits") == 0).alias("unvisited"), F.count("p_up").alias("p_up_states"), F.min("p_up").alias("p_up_min"), F.max("p_up").alias("p_up_max"),
        F.avg("p_up").alias("p_up_mean"), F.count_if(F.col("p_up") > 0.5).alias("p_up_above_half"),
    )
