"""Immutable settings: the state space, smoothing, the solver, sources, comparisons."""

from __future__ import annotations

import enum
import math
from dataclasses import dataclass, field

from larkspread.errors import InvalidConfig

#: Fixed values of the formats read: a price at or beyond this size is an empty level;
#: distance from the tick grid that still counts as on it; largest grid index; largest scaled size or time.
EMPTY_LEVEL = 9_999_999_999
GRID_TOLERANCE = 1e-4
GRID_LIMIT = 1e15
SCALED_LIMIT = 1.8e19
#: Nanoseconds in a unit of time.
UNIT_NS = {"s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "ns": 1}


class BookPolicy(enum.Enum):
    """Which books are valid."""

    STRICT = "ask > bid"
    ALLOW_LOCKED = "ask >= bid"
    ALLOW_ALL = "true"


class RowPolicy(enum.Enum):
    """What an invalid row does: stop the read or be counted and skipped."""

    ERROR = "error"
    SKIP = "skip"


@dataclass(frozen=True)
class StateSpace:
    """Imbalance buckets of equal width times spread buckets with upper bounds."""

    buckets: int = 10
    bounds: tuple[int, ...] = (2, 4, 8)

    def __post_init__(self) -> None:
        if self.buckets < 1:
            raise InvalidConfig("at least one imbalance bucket is needed")
        if any(b < 1 for b in self.bounds) or any(a >= b for a, b in zip(self.bounds, self.bounds[1:])):
            raise InvalidConfig("spread bounds must be at least 1 and strictly increase")

    @property
    def size(self) -> int:
        return self.buckets * (len(self.bounds) + 1)

    def mirror(self, state: int) -> int:
        """The state with bid and ask side exchanged."""
        return state // self.buckets * self.buckets + (self.buckets - 1 - state % self.buckets)

    def encode(self, spread: int, bid_qty: int, ask_qty: int) -> int:
        """State of one book; the spread is looked at before the sizes."""
        if spread < 1:
            raise InvalidConfig(f"spread {spread} is out of range")
        if bid_qty + ask_qty == 0:
            raise InvalidConfig("the book is empty")
        row = next((i for i, b in enumerate(self.bounds) if spread <= b), len(self.bounds))
        share = float(bid_qty) / float(bid_qty + ask_qty)
        return row * self.buckets + min(int(math.floor(share * self.buckets)), self.buckets - 1)

    def describe(self, state: int) -> tuple[int, int, float, float, int, int | None]:
        """(imbalance bucket, spread bucket, share from, share to, spread from, spread to)."""
        row, k = divmod(state, self.buckets)
        width = 1.0 / self.buckets
        return k, row, k * width, (k + 1) * width, (self.bounds[row - 1] + 1 if row else 1), (self.bounds[row] if row < len(self.bounds) else None)


def parse_bounds(text: str) -> tuple[int, ...]:
    """Spread bounds of a comma list; an empty text has none."""
    try:
        return tuple(int(p.strip()) for p in text.split(",")) if text.strip() else ()
    except ValueError as e:
        raise InvalidConfig(f"spread bounds {text!r} are no integers") from e


@dataclass(frozen=True)
class Smoothing:
    """Pseudo-count of every transition."""

    alpha: float = 0.5

    def __post_init__(self) -> None:
        if not (math.isfinite(self.alpha) and self.alpha >= 0):
            raise InvalidConfig("alpha must be finite and at least 0")


@dataclass(frozen=True)
class SolverSettings:
    """When the fixed point counts as reached."""

    tolerance: float = 1e-10
    sweeps: int = 10_000


@dataclass(frozen=True)
class CsvLayout:
    """Where a delimited file has its fields and how they are scaled.

    A column is a name (header needed, case ignored) or a position from 0.
    """

    bid_price: str | int
    bid_qty: str | int
    ask_price: str | int
    ask_qty: str | int
    time: str | int | None
    time_unit: str = "ms"
    header: bool = True
    tick_size: float = 0.01
    price_divisor: float = 1.0
    qty_decimals: int = 8
    resolution: int = 2
    on_invalid: RowPolicy = RowPolicy.ERROR
    drop_unchanged: bool = False
    max_events: int | None = None

    def __post_init__(self) -> None:
        for name in ("tick_size", "price_divisor"):
            if not (math.isfinite(getattr(self, name)) and getattr(self, name) > 0):
                raise InvalidConfig(f"{name} must be finite and above 0")
        if self.resolution < 1 or not 0 <= self.qty_decimals <= 12:
            raise InvalidConfig("resolution must be at least 1 and qty_decimals from 0 to 12")
        if self.time_unit not in UNIT_NS:
            raise InvalidConfig(f"unknown unit of time {self.time_unit!r}")


def book_ticker_layout(tick_size: float, **more) -> CsvLayout:
    """The archive layout of best bid and ask updates."""
    return CsvLayout(**({"bid_price": "best_bid_price", "bid_qty": "best_bid_qty", "ask_price": "best_ask_price", "ask_qty": "best_ask_qty", "time": "event_time", "tick_size": tick_size} | more))


def level_file_layout(tick_size: float = 0.01, **more) -> CsvLayout:
    """Headerless level files whose times are in a file of their own."""
    return CsvLayout(**({"ask_price": 0, "ask_qty": 1, "bid_price": 2, "bid_qty": 3, "time": None, "time_unit": "s", "header": False, "price_divisor": 10_000.0, "qty_decimals": 0, "tick_size": tick_size} | more))


def named_layout(tick_size: float, time: str = "timestamp", bid_price: str = "bid_price", bid_qty: str = "bid_qty", ask_price: str = "ask_price", ask_qty: str = "ask_qty", **more) -> CsvLayout:
    """Any file with a header."""
    return CsvLayout(**({"bid_price": bid_price, "bid_qty": bid_qty, "ask_price": ask_price, "ask_qty": ask_qty, "time": time, "tick_size": tick_size} | more))


@dataclass(frozen=True)
class CompareOptions:
    """Block bootstrap of paired losses."""

    resamples: int = 1000
    block: int = 1000
    seed: int = 42

    def __post_init__(self) -> None:
        if self.block < 1 or self.resamples < 0:
            raise InvalidConfig("blocks have at least one row and resamples are not negative")


@dataclass(frozen=True)
class EvaluationPlan:
    """What an evaluation run does."""

    space: StateSpace = field(default_factory=StateSpace)
    smoothing: Smoothing = field(default_factory=Smoothing)
    train_fraction: float = 0.7
    horizons: tuple[int, ...] = (1, 10, 100)
    primary: int = 10
    wall_clock_ms: tuple[int, ...] = ()
    symmetrize: bool = False
    resolution: int = 2
    compare: CompareOptions = field(default_factory=CompareOptions)

    def __post_init__(self) -> None:
        if not 0 < self.train_fraction < 1:
            raise InvalidConfig("the train fraction lies between 0 and 1")
        if not self.horizons or any(h < 1 for h in self.horizons):
            raise InvalidConfig("event horizons are at least 1")
        if self.primary not in self.horizons:
            raise InvalidConfig("the primary horizon must be one of the horizons")
        if any(ms < 1 or ms * 1_000_000 >= 1 << 63 for ms in self.wall_clock_ms):
            raise InvalidConfig("wall-clock horizons are at least 1 ms and fit 64 bits in ns")
