"""Transition counts of an unbounded feed.

Per source the state is its last sequence, state and mid. Rows of a micro-batch are
taken in order of sequence; a row at or before the last one is out of order and is
either an error or left out. Counts are then aggregated by pair of states.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspread.config import StateSpace
from larkspread.errors import OutOfOrder
from larkspread.functions.book import with_state
from larkspread.operators.transitions import count_transitions
from larkspread.sources.quotes import _PARQUET
from larkspread.workers import ship_package

_OUT = "symbol_id long, sequence long, from_state int, to_state int, delta long"
_STATE = "sequence long, state int, mid long"


def stream_quotes(spark: SparkSession, folder: str, files_at_once: int = 1) -> DataFrame:
    """Quotes of Parquet files as they land in a folder, in the Parquet form."""
    schema = ", ".join(f"{c} long" for c in _PARQUET)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    return rows.select(*[F.col(c).alias(to) for c, (to, _) in _PARQUET.items()])


def stream_transitions(quotes: DataFrame, space: StateSpace, on_late: str = "error") -> DataFrame:
    """Transitions of a streamed feed; the same as those of the whole in a batch."""
    ship_package(quotes.sparkSession)

    def handle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("sequence", kind="stable")
        sequence, mid = rows["sequence"].to_numpy(), rows["mid"].to_numpy()
        at = pd.to_numeric(rows["state"]).to_numpy(dtype=float, na_value=np.nan)
        last, before, before_mid = state.get if state.exists else (None, None, 0)
        late = np.r_[False, sequence[1:] == sequence[:-1]]
        if last is not None:
            late |= sequence <= last
        if late.any():
            if on_late == "error":
                raise OutOfOrder(f"sequence {sequence[late][0]} of source {key[0]} is not after the one before")
            sequence, at, mid = sequence[~late], at[~late], mid[~late]
        if len(sequence):
            was, was_mid = np.r_[np.nan if before is None else before, at[:-1]], np.r_[before_mid, mid[:-1]]
            pair = ~np.isnan(at) & ~np.isnan(was)
            state.update((int(sequence[-1]), None if np.isnan(at[-1]) else int(at[-1]), int(mid[-1])))
            columns = {"symbol_id": key[0], "sequence": sequence[pair], "from_state": was[pair].astype(np.int32), "to_state": at[pair].astype(np.int32), "delta": (mid - was_mid)[pair]}
            yield pd.DataFrame(columns)

    rows = with_state(quotes, space).select("symbol_id", "sequence", "state", "mid")
    return rows.groupBy("symbol_id").applyInPandasWithState(handle, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def count_stream(quotes: DataFrame, space: StateSpace, store: str, checkpoint: str, on_late: str = "error"):
    """Starts a query that adds each micro-batch's counts to Parquet files under
    ``store``, one folder a batch: a batch that is repeated replaces its own folder,
    so nothing counts twice. Read them with ``stored_counts``."""

    def add(batch: DataFrame, number: int) -> None:
        count_transitions(batch).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream_transitions(quotes, space, on_late).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_counts(spark: SparkSession, store: str) -> DataFrame:
    """Merged counts of all batches so far."""
    from larkspread.operators.transitions import merge_counts

    return merge_counts(spark.read.option("basePath", store).parquet(f"{store}/batch=*").drop("batch"))


def record_once(updates: DataFrame, key: str = "symbol", order: str = "update_id") -> DataFrame:
    """A recorded stream without updates at or before the last one of their key."""
    ship_package(updates.sparkSession)
    schema = updates.schema

    def handle(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        last = state.get[0] if state.exists else None
        rows = rows[~rows[order].duplicated()]
        if last is not None:
            rows = rows[rows[order] > last]
        if len(rows):
            state.update((int(rows[order].iloc[-1]),))
        yield rows

    return updates.groupBy(key).applyInPandasWithState(handle, schema, "last long", "append", GroupStateTimeout.NoTimeout)
