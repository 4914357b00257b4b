"""Column expressions over a quote: all stay in generated JVM code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspread.config import BookPolicy, StateSpace

QUOTE_COLUMNS = ("symbol_id", "sequence", "timestamp_ns", "bid", "ask", "bid_qty", "ask_qty")


def valid(policy: BookPolicy) -> Column:
    """Whether the book passes the policy."""
    return F.expr(policy.value)


def spread() -> Column:
    return F.col("ask") - F.col("bid")


def mid() -> Column:
    """Half the sum, cut off towards zero."""
    return F.expr("(bid + ask) div 2")


def exact_mid() -> Column:
    return (F.col("bid").cast("double") + F.col("ask").cast("double")) / 2


def imbalance() -> Column:
    """Share of the size on the bid; null where there is no size."""
    total = F.col("bid_qty") + F.col("ask_qty")
    return F.when(total > 0, F.col("bid_qty").cast("double") / total.cast("double"))


def weighted_mid() -> Column:
    """Ask by the bid's share plus bid by the ask's."""
    i = imbalance()
    return F.col("ask").cast("double") * i + F.col("bid").cast("double") * (F.lit(1.0) - i)


def imbalance_bucket(space: StateSpace) -> Column:
    i = imbalance()  # least() skips nulls, so they are kept out of it
    return F.when(i.isNotNull(), F.least(F.floor(i * F.lit(float(space.buckets))), F.lit(space.buckets - 1)).cast("int"))


def spread_bucket(space: StateSpace) -> Column:
    """Null for a spread below 1."""
    steps = reduce(lambda c, ib: c.when(spread() <= ib[1], ib[0]), enumerate(space.bounds), F.when(spread() < 1, F.lit(None).cast("int")))
    return steps.otherwise(len(space.bounds))


def state(space: StateSpace) -> Column:
    """Null where spread or sizes have no bucket."""
    return spread_bucket(space) * space.buckets + imbalance_bucket(space)


def no_state_reason() -> Column:
    """Why a book has no state: the spread comes first."""
    return F.when(spread() < 1, "spread_out_of_range").when(F.col("bid_qty") + F.col("ask_qty") <= 0, "empty_book")


def mirrored(column: str, space: StateSpace) -> Column:
    n = space.buckets
    return F.expr(f"({column} div {n}) * {n} + ({n - 1} - {column} % {n})").cast("int")


def price(units: str, tick_size: float, resolution: int = 1) -> Column:
    """Units as a price, for display."""
    return F.col(units).cast("double") * F.lit(tick_size) / F.lit(resolution)


def with_state(quotes: DataFrame, space: StateSpace) -> DataFrame:
    """Quotes with ``state`` and ``mid``."""
    return quotes.withColumn("state", state(space)).withColumn("mid", mid())


def state_table(spark: SparkSession, space: StateSpace) -> DataFrame:
    """One row a state: buckets, ranges and mirror. Its size is the setting's."""
    rows = [(s, *space.describe(s), space.mirror(s)) for s in range(space.size)]
    return spark.createDataFrame(rows, "state int, imbalance_bucket int, spread_bucket int, share_from double, share_to double, spread_from long, spread_to long, mirror int")
