"""Transitions between successive states and their counts.

Counts are a sparse table (source, from, to): flat and price-changing
transitions, signed mid changes, up and down moves. They are additive, so
partial counts of tasks, chunks or micro-batches merge by summation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspread.config import StateSpace
from larkspread.errors import OutOfOrder
from larkspread.functions.book import mirrored, with_state
from larkspread.operators.ordering import BLOCK, with_previous

COUNTS = ("n_flat", "n_moved", "delta_sum", "up", "down")


def transitions(quotes: DataFrame, space: StateSpace, source: str = "symbol_id", block: int = BLOCK) -> DataFrame:
    """(source, sequence, from_state, to_state, delta) of each pair of successive
    quotes that both have a state. A quote without one breaks the chain: its
    neighbours are not paired across it."""
    rows = with_state(quotes, space).select(source, "sequence", "state", "mid")
    seen = with_previous(rows, {"from_state": "state", "from_mid": "mid"}, source, "sequence", block)
    return seen.where("from_state IS NOT NULL AND state IS NOT NULL").select(source, "sequence", "from_state", F.col("state").alias("to_state"), F.expr("mid - from_mid").alias("delta"))


def count_transitions(pairs: DataFrame, source: str = "symbol_id") -> DataFrame:
    """Counts by (source, from_state, to_state)."""
    return pairs.groupBy(source, "from_state", "to_state").agg(
        F.count_if(F.col("delta") == 0).alias("n_flat"),
        F.count_if(F.col("delta") != 0).alias("n_moved"),
        F.sum("delta").alias("delta_sum"),
        F.count_if(F.col("delta") > 0).alias("up"),
        F.count_if(F.col("delta") < 0).alias("down"),
    )


def merge_counts(*parts: DataFrame, source: str = "symbol_id") -> DataFrame:
    """Sum of counts of parts of a stream. Chunks must share their border quote."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(source, "from_state", "to_state").agg(*[F.sum(c).alias(c) for c in COUNTS])


def symmetrize(counts: DataFrame, space: StateSpace, source: str = "symbol_id") -> DataFrame:
    """Counts plus their mirror image: sides exchanged, signs of moves turned."""
    names = ("from_state", "to_state", *COUNTS)
    same = F.struct(*[F.col(c).alias(c) for c in names])
    turned = F.struct(
        mirrored("from_state", space).alias("from_state"), mirrored("to_state", space).alias("to_state"), F.col("n_flat").alias("n_flat"), F.col("n_moved").alias("n_moved"),
        (-F.col("delta_sum")).alias("delta_sum"), F.col("down").alias("up"), F.col("up").alias("down"),
    )
    return merge_counts(counts.select(source, F.explode(F.array(same, turned)).alias("__c")).select(source, "__c.*"), source=source)


def state_totals(counts: DataFrame, source: str = "symbol_id") -> DataFrame:
    """(source, state, visits, delta_sum, up, down, p_up) of states left at least once."""
    rows = counts.groupBy(source, F.col("from_state").alias("state")).agg(F.sum(F.expr("n_flat + n_moved")).alias("visits"), *[F.sum(c).alias(c) for c in ("delta_sum", "up", "down")])
    return rows.withColumn("p_up", F.try_divide(F.col("up").cast("double"), (F.col("up") + F.col("down")).cast("double")))


def order_faults(quotes: DataFrame, source: str = "symbol_id", by: str = "sequence", time: str = "timestamp_ns", block: int = BLOCK) -> DataFrame:
    """(source, repeated, decreased): rows whose ``by`` was there before, and steps along
    it at which ``time`` decreases, repeats left out."""
    once = quotes.groupBy(source, by).agg(F.min(time).alias(time), (F.count(F.lit(1)) - 1).alias("__again"))
    seen = with_previous(once, {"time_before": time}, source, by, block)
    return seen.groupBy(source).agg(F.sum("__again").alias("repeated"), F.count_if(F.col(time) < F.col("time_before")).alias("decreased"))


def require_order(quotes: DataFrame, source: str = "symbol_id", by: str = "sequence", time: str = "timestamp_ns", block: int = BLOCK) -> None:
    """Raise ``OutOfOrder`` unless ``by`` is unique and ``time`` does not decrease along it."""
    twice = quotes.groupBy(source, by).count().where("count > 1").orderBy(source, by).limit(1).collect()
    if twice:
        raise OutOfOrder(f"{by} {twice[0][by]} of source {twice[0][source]} does not increase")
    seen = with_previous(quotes.select(source, by, time), {"time_before": time}, source, by, block)
    back = seen.where(f"{time} < time_before").orderBy(source, by).limit(1).collect()
    if back:
        raise OutOfOrder(f"{by} {back[0][by]} of source {back[0][source]}: {time} decreases")
