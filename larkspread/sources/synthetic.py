"""A seeded synthetic feed: a random walk of the mid whose sides queue and drain.

Each step draws one event: the price moves a tick, an order arrives, is cancelled
or trades, or nothing happens. A move draws the book anew, so the feed can be cut: it is
made in segments of ``SEGMENT`` steps, each with draws of its own and a fresh book, in
parallel, and a segment's prices start where the sum of all moves before it left off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspread.errors import InvalidConfig
from larkspread.session import materialize
from larkspread.workers import ship_package


@dataclass(frozen=True)
class SyntheticFeed:
    """Law of the feed. Rates are shares of steps; what is left over is no event."""

    mid: int = 10_000
    spread: int = 2
    bid_qty: int = 500
    ask_qty: int = 500
    arrival: float = 0.3
    cancel: float = 0.2
    market: float = 0.2
    move: float = 0.1
    persistence: float = 0.5
    step_ns: int = 100_000

    def __post_init__(self) -> None:
        rates = (self.arrival, self.cancel, self.market, self.move)
        if any(not 0 <= r <= 1 for r in (*rates, self.persistence)) or sum(rates) > 1 + 1e-12:
            raise InvalidConfig("rates and persistence are shares, and rates sum to at most 1")
        if self.spread < 1 or self.bid_qty < 1 or self.ask_qty < 1:
            raise InvalidConfig("spread and sizes start at 1 or more")


#: Steps that one task makes in one go.
SEGMENT = 1 << 16
_QUOTES = "symbol_id long, sequence long, timestamp_ns long, bid long, ask long, bid_qty long, ask_qty long"


def segment(feed: SyntheticFeed, symbol: int, seed: int, number: int, steps: int) -> pd.DataFrame:
    """The quotes of one segment; ``bid`` counts from 0 at its start."""
    rng = np.random.default_rng([seed, symbol, number])
    starts = (feed.bid_qty, feed.ask_qty)
    largest = max(1, max(starts) // 10)
    edges = np.cumsum([feed.move, feed.arrival, feed.cancel, feed.market])
    kinds = np.searchsorted(edges, rng.random(steps), side="right").tolist()
    sides, sizes = rng.integers(2, size=steps).tolist(), rng.integers(1, largest + 1, size=steps).tolist()
    turns, signs = (rng.random(steps) >= feed.persistence).tolist(), np.where(rng.random(steps) < 0.5, 1, -1).tolist()
    fresh = [rng.integers(max(1, s // 2), 2 * s + 1, size=steps).tolist() for s in starts]
    book, last, low = list(starts), 1 if rng.random() < 0.5 else -1, 0
    lows, bids, asks = [0] * steps, [0] * steps, [0] * steps
    for k in range(steps):
        kind = kinds[k]
        if 1 <= kind <= 3:
            side = sides[k]
            book[side] = book[side] + sizes[k] if kind == 1 else max(0, book[side] - sizes[k])
        if kind == 0 or not (book[0] or book[1]):
            if turns[k]:
                last = signs[k]
            low += last
            book = [fresh[0][k], fresh[1][k]]
        lows[k], bids[k], asks[k] = low, book[0], book[1]
    sequence = number * SEGMENT + np.arange(1, steps + 1, dtype=np.int64)
    bid = np.asarray(lows, dtype=np.int64)
    return pd.DataFrame({"symbol_id": symbol, "sequence": sequence, "timestamp_ns": sequence * feed.step_ns, "bid": bid, "ask": bid + feed.spread, "bid_qty": bids, "ask_qty": asks})


def synthetic_quotes(spark: SparkSession, events: int, seed: int = 42, symbols: int = 1, feed: SyntheticFeed = SyntheticFeed()) -> DataFrame:
    """``events`` quotes of each of ``symbols`` feeds; the same seed gives the same quotes."""
    ship_package(spark)
    if events < 1:
        return spark.createDataFrame([], _QUOTES)
    each = -(-events // SEGMENT)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n in batch["id"].tolist():
                yield segment(feed, n // each, seed, n % each, min(SEGMENT, events - n % each * SEGMENT))

    total = symbols * each
    made = materialize(spark.range(0, total, 1, min(total, 4096)).mapInPandas(make, _QUOTES), "segments")
    made = made.withColumn("__segment", F.expr(f"(sequence - 1) div {SEGMENT}"))
    moved = made.groupBy("symbol_id", "__segment").agg(F.max_by("bid", "sequence").alias("__moved"))
    before = Window.partitionBy("symbol_id").orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = moved.select("symbol_id", "__segment", (F.coalesce(F.sum("__moved").over(before), F.lit(0)) + (feed.mid - feed.spread // 2)).alias("__start"))
    met = made.join(starts, ["symbol_id", "__segment"])
    return met.select("symbol_id", "sequence", "timestamp_ns", (F.col("bid") + F.col("__start")).alias("bid"), (F.col("ask") + F.col("__start")).alias("ask"), "bid_qty", "ask_qty")
