"""A solved model as an artifact: saved, loaded with checks, applied to books."""

from __future__ import annotations

import io
import json
import math
import numbers
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspread.config import Smoothing, SolverSettings, StateSpace
from larkspread.errors import BadModel, InvalidBook
from larkspread.functions.book import no_state_reason
from larkspread.operators import estimate, transitions
from larkspread.operators.evaluate import predict as predict_rows
from larkspread.session import materialize, read_bytes, write_bytes

VERSION = 2


@dataclass(frozen=True)
class Estimate:
    """What a model says about one book."""

    mid: int
    weighted_mid: float
    micro_price: float
    adjustment: float
    p_up: float | None
    state: int
    state_visits: int


def _integers(column: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
    """A column (list, array or any buffer of integers) as 64-bit integers, and where
    it has something else."""
    if not isinstance(column, (list, tuple, np.ndarray)) and hasattr(column, "__iter__"):
        try:
            column = np.asarray(memoryview(column))
        except TypeError:
            column = list(column)
    if isinstance(column, np.ndarray) and column.dtype.kind in "iu" and column.dtype != np.uint64:
        return column.astype(np.int64), np.zeros(len(column), bool)
    bad = np.array([isinstance(x, bool) or not isinstance(x, numbers.Integral) or not -(1 << 63) <= x < 1 << 63 for x in column], dtype=bool)
    return np.array([0 if b else int(x) for x, b in zip(column, bad)], dtype=np.int64), bad


@dataclass(frozen=True)
class Model:
    """Adjustment, up-probability and visits of every state, with how they came about."""

    symbol_id: int
    space: StateSpace
    alpha: float
    training_observations: int
    g_star: tuple[float, ...]
    p_up: tuple[float | None, ...]
    visits: tuple[int, ...]

    def __post_init__(self) -> None:
        n = self.space.size
        if not len(self.g_star) == len(self.p_up) == len(self.visits) == n:
            raise BadModel(f"a model of {n} states needs as many values")
        if not all(math.isfinite(g) for g in self.g_star):
            raise BadModel("an adjustment is not finite")
        if not all(p is None or 0 <= p <= 1 for p in self.p_up):
            raise BadModel("an up-probability is outside 0 to 1")

    def predict(self, bid: int, ask: int, bid_qty: int, ask_qty: int) -> Estimate:
        """One book; it must be strictly ordered and have a size."""
        if ask <= bid:
            raise InvalidBook(f"ask {ask} is not above bid {bid}")
        if bid_qty + ask_qty == 0:
            raise InvalidBook("the book is empty")
        s = self.space.encode(ask - bid, bid_qty, ask_qty)
        share = float(bid_qty) / float(bid_qty + ask_qty)
        mid = int((bid + ask) / 2) if abs(bid + ask) < 1 << 52 else (abs(bid + ask) // 2) * (1 if bid + ask >= 0 else -1)
        return Estimate(mid, ask * share + bid * (1.0 - share), mid + self.g_star[s], self.g_star[s], self.p_up[s], s, self.visits[s])

    def predict_batch(self, bid: Iterable[int], ask: Iterable[int], bid_qty: Iterable[int], ask_qty: Iterable[int]) -> dict[str, list]:
        """Columns in, columns out; nothing comes out if a row is bad, and the first
        bad row is named. Only integers are taken."""
        columns = [_integers(c) for c in (bid, ask, bid_qty, ask_qty)]
        if len({len(c) for c, _ in columns}) > 1:
            raise BadModel("the columns differ in length")
        (b, bad_b), (a, bad_a), (bq, bad_bq), (aq, bad_aq) = columns
        largest = max([0, *(int(np.abs(c).max()) for c in (b, a, bq, aq) if len(c))])
        faults = [("only integers are taken", bad_b | bad_a | bad_bq | bad_aq), ("ask is not above bid", a <= b), ("the book is empty", bq + aq == 0)]
        wrong = np.logical_or.reduce([f for _, f in faults])
        if wrong.any():
            row = int(np.argmax(wrong))
            raise InvalidBook(next(why for why, f in faults if f[row]), row)
        if largest >= 1 << 52:  # beyond exact doubles
            out = [self.predict(*map(int, book)) for book in zip(b, a, bq, aq)]
            return {k: [getattr(e, k) for e in out] for k in Estimate.__dataclass_fields__}
        share = bq / (bq + aq)
        row = np.searchsorted(np.asarray(self.space.bounds, dtype=np.int64), a - b, side="left")
        states = row * self.space.buckets + np.minimum(np.floor(share * self.space.buckets).astype(np.int64), self.space.buckets - 1)
        mid = np.trunc((b + a) / 2).astype(np.int64)
        g = np.asarray(self.g_star)[states]
        found = {"mid": mid, "weighted_mid": a * share + b * (1.0 - share), "micro_price": mid + g, "adjustment": g, "p_up": np.asarray(self.p_up, dtype=object)[states], "state": states, "state_visits": np.asarray(self.visits)[states]}
        return {k: v.tolist() for k, v in found.items()}

    def metadata(self) -> dict:
        """How the model came about."""
        return {
            "schema_version": VERSION, "symbol_id": self.symbol_id, "num_imbalance_buckets": self.space.buckets, "spread_bucket_bounds_ticks": list(self.space.bounds),
            "smoothing_alpha": self.alpha, "training_observations": self.training_observations,
        }

    def table(self, spark) -> DataFrame:
        """(symbol_id, state, g_star, p_up, visits): one row a state."""
        rows = [(self.symbol_id, s, g, p, v) for s, (g, p, v) in enumerate(zip(self.g_star, self.p_up, self.visits))]
        return spark.createDataFrame(rows, "symbol_id long, state int, g_star double, p_up double, visits long")

    def transform(self, quotes: DataFrame, on_invalid: str = "null") -> DataFrame:
        """Quotes with the model's columns; a book without a state has nulls, or with
        on_invalid='error' stops the run naming the first."""
        if on_invalid == "error":
            bad = quotes.withColumn("__why", F.when(F.col("ask") <= F.col("bid"), "invalid ordering").otherwise(no_state_reason())).where("__why IS NOT NULL").orderBy("symbol_id", "sequence").limit(1).collect()
            if bad:
                raise InvalidBook(f"{bad[0]['__why']} at sequence {bad[0]['sequence']} of source {bad[0]['symbol_id']}")
        states = F.broadcast(self.table(quotes.sparkSession))  # as many rows as the settings have states
        return predict_rows(quotes, states, self.space, by=("state",))

    def save(self, path: str | Path) -> None:
        """Writes ``states.parquet`` and ``metadata.json`` into a folder of this machine
        or, with a scheme, of any file system that Spark knows."""
        frame = pd.DataFrame({"state": range(self.space.size), "g_star": self.g_star, "p_up": pd.array(self.p_up, dtype="Float64"), "visits": self.visits})
        states = io.BytesIO()
        frame.to_parquet(states, index=False)
        write_bytes(f"{path}/states.parquet", states.getvalue())
        meta = {"schema_version": VERSION, "symbol_id": self.symbol_id, "space": asdict(self.space), "alpha": self.alpha, "training_observations": self.training_observations}
        write_bytes(f"{path}/metadata.json", json.dumps(meta, indent=1).encode())

    @classmethod
    def load(cls, path: str | Path) -> Model:
        """Reads and checks a saved model."""
        try:
            meta = json.loads(read_bytes(f"{path}/metadata.json"))
            frame = pd.read_parquet(io.BytesIO(read_bytes(f"{path}/states.parquet"))).sort_values("state")
        except (OSError, ValueError) as e:
            raise BadModel(f"{path} cannot be read: {e}") from e
        if meta.get("schema_version") != VERSION:
            raise BadModel(f"schema version {meta.get('schema_version')} is not {VERSION}")
        space = StateSpace(meta["space"]["buckets"], tuple(meta["space"]["bounds"]))
        if list(frame["state"]) != list(range(space.size)):
            raise BadModel("the states do not match the state space")
        p_up = tuple(None if pd.isna(p) else float(p) for p in frame["p_up"])
        return cls(meta["symbol_id"], space, meta["alpha"], meta["training_observations"], tuple(map(float, frame["g_star"])), p_up, tuple(map(int, frame["visits"])))


@dataclass(frozen=True)
class Calibration:
    """A model with the diagnostics of its making."""

    model: Model
    sweeps: int
    max_drift: float
    max_drift_state: int
    mean_drift: float
    antisymmetry: float


def calibrate(
    quotes: DataFrame, space: StateSpace = StateSpace(), smoothing: Smoothing = Smoothing(), settings: SolverSettings = SolverSettings(), symmetrize: bool = False, symbol_id: int = 0, pooled: bool = True
) -> Calibration:
    """Counts, smooths and solves the quotes of one source (or of all, pooled).

    What reaches the driver is one row a state. Visits of a symmetrized model are
    the symmetrized ones; its number of observations is the real one.
    """
    counts = transitions.count_transitions(transitions.transitions(quotes, space))
    if pooled:
        one = counts.withColumn("symbol_id", F.lit(symbol_id).cast("bigint"))
        counts = transitions.merge_counts(one)
    counts = materialize(counts, "counts")  # states^2 rows a source, read twice below
    real = counts.agg(F.sum(F.expr("n_flat + n_moved"))).first()[0] or 0
    used = transitions.symmetrize(counts, space) if symmetrize else counts
    solved = estimate.adjustments(used, space, smoothing, settings)
    rows = sorted(solved.where(F.col("symbol_id") == symbol_id).collect(), key=lambda r: r["state"])
    if not rows:
        raise BadModel("there are no transitions to learn from")
    model = Model(symbol_id, space, smoothing.alpha, int(real), tuple(r["g_star"] for r in rows), tuple(r["p_up"] for r in rows), tuple(r["visits"] for r in rows))
    drifts, visits = [abs(r["drift"]) for r in rows], [r["visits"] for r in rows]
    worst = max(range(len(rows)), key=lambda s: (drifts[s], -s))
    anti = max(abs(model.g_star[s] + model.g_star[space.mirror(s)]) for s in range(space.size))
    return Calibration(model, rows[0]["sweeps"], drifts[worst], worst, sum(d * v for d, v in zip(drifts, visits)) / max(1, sum(visits)), anti)


def train_synthetic(
    spark, num_events: int, num_imbalance_buckets: int = 20, spread_bucket_bounds_ticks: Iterable[int] = (), smoothing_alpha: float = 0.5, seed: int = 42, symbol_id: int = 0, feed=None
) -> Model:
    """A model of one synthetic feed."""
    from larkspread.sources.synthetic import SyntheticFeed, synthetic_quotes

    quotes = synthetic_quotes(spark, num_events, seed, feed=feed or SyntheticFeed())
    return calibrate(quotes, StateSpace(num_imbalance_buckets, tuple(spread_bucket_bounds_ticks)), Smoothing(smoothing_alpha), symbol_id=symbol_id).model
