"""Irregular readings onto a regular grid, with gaps filled and marked.

Readings are first reduced to grid cells by an aggregation (median bid and ask of a
cell's plausible readings, so that a spike among others does not move it), and
everything after works on cells, of which a source and day have at most day / grid.
Missing cells are filled by iterative singular-spectrum imputation: the series is
embedded in its Hankel trajectory matrix, projected on its leading singular vectors,
averaged along anti-diagonals, and the missing entries are replaced by the result
until they settle. Each round's change is carried on along the last few ones (Anderson
acceleration), which settles in a few dozen rounds what plain replacement takes
hundreds for; a block that has not settled after ``rounds`` says so in ``settled``.
Values far off their neighbourhood are kept in the grid but not fitted.

A source and day is cut into blocks of ``block`` cells that also see ``halo``
cells of either neighbour; blocks are spread over tasks by (source, day, block),
so neither a hot source nor a fine grid makes a large task.

Marks (``fill``): ``reading`` - the cell has one; ``implausible`` - it has
readings but none within the price bounds, the value is imputed; ``ssa`` - no
reading, imputed; ``level`` - no reading, and the known cells before and after lie
more than ``halo`` cells apart (or there are none): the values known before and after
are interpolated. A gap's mark does not depend on where blocks begin.

Defined cases
-------------
* A reading needs both prices, its source and its time; others are no reading.
* Ties and repeats fall into one cell and change no mark.
* A source absent from the instruments table, or with a grid of null or <= 0, has
  no grid: its readings give no cells.
* A source and day without plausible prices has all its cells, with null values.
* Empty input gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from larkspread.session import materialize
from larkspread.workers import arrow_schema, map_arrow

DAY_NS = 86_400_000_000_000
PRICE_LIMIT = 9_999_999_999


@dataclass(frozen=True)
class SpectrumModel:
    """Parameters of the imputation; the defaults are the production ones."""

    window: int = 24
    rank: int = 3
    rounds: int = 1000
    settled: float = 1e-3
    carried: int = 5  # past changes by which a round's change is carried on
    outlying: float = 20.0  # distance from the neighbourhood's median, in usual ones, beyond which a value is not fitted
    block: int = 4096
    halo: int = 192


def _outlying(v: np.ndarray, model: SpectrumModel) -> np.ndarray:
    """Known values far off the median of the nine around them."""
    if len(v) < 9:
        return np.zeros(len(v), bool)
    around = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(v, 4, mode="reflect"), 9), axis=1)
    off = np.abs(v - around)
    usual = off[off > 0]
    return off > model.outlying * np.median(usual) if len(usual) else np.zeros(len(v), bool)


def _reconstructed(z: np.ndarray, window: int, rank: int, share: np.ndarray) -> np.ndarray:
    """The series of the leading singular vectors: scores on each, averaged along
    anti-diagonals, which is a convolution."""
    hankel = np.lib.stride_tricks.sliding_window_view(z, window)
    _, vectors = np.linalg.eigh(hankel.T @ hankel)
    lead = vectors[:, -rank:]
    scores = hankel @ lead
    return sum(np.convolve(scores[:, r], lead[:, r]) for r in range(lead.shape[1])) / share


def impute(x: np.ndarray, missing: np.ndarray, model: SpectrumModel) -> np.ndarray:
    """``x`` with its missing entries filled; NaN where nothing is known."""
    return imputed(x, missing, np.zeros(len(x), bool), model)[0]


def imputed(x: np.ndarray, missing: np.ndarray, held: np.ndarray, model: SpectrumModel) -> tuple[np.ndarray, bool]:
    """``impute`` and whether it settled; missing entries that are ``held`` lie in long
    gaps and keep the interpolated level."""
    known = np.flatnonzero(~missing)
    if not len(known) or len(known) == len(x):
        return x, True
    filled = np.interp(np.arange(len(x)), known, x[known])
    filled[known] = x[known]
    low, high = x[known].min(), x[known].max()
    fitted = known[~_outlying(x[known], model)]
    window = min(model.window, len(x) // 3)
    if window < 2 or low == high or not len(fitted):
        return filled, True
    z = np.interp(np.arange(len(x)), fitted, x[fitted])
    middle = np.median(x[fitted])
    scale = np.abs(x[fitted] - middle).mean() or 1.0
    z = (z - middle) / scale
    open_ = np.ones(len(x), bool)
    open_[fitted] = False
    open_ &= ~held
    n, k = len(z), len(z) - window + 1
    share = np.minimum(np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)), min(window, k)).astype(np.float64)
    now, last, least, settled = z[open_], None, np.inf, not open_.any()
    moves: list[np.ndarray] = []  # how the changes and the results changed from round to round
    results: list[np.ndarray] = []
    for turn in range(0 if settled else model.rounds):
        z[open_] = now
        new = _reconstructed(z, window, model.rank, share)[open_]
        change = new - now
        if np.abs(change).max() < model.settled:
            settled = True
            break
        size = float(np.linalg.norm(change))
        if size > 1.5 * least:
            moves, results, last = [], [], None
        least = min(least, size)
        if last is not None:
            moves, results = [*moves, change - last[0]][-model.carried :], [*results, new - last[1]][-model.carried :]
        last = change, new
        if moves:
            m = np.stack(moves)
            gram = m @ m.T
            gram += (1e-10 * np.trace(gram) + 1e-300) * np.eye(len(gram))
            now = new - np.linalg.solve(gram, m @ change) @ np.stack(results)
        else:
            now = new if turn < 100 else (new + now) / 2
    z[open_] = now
    out = filled.copy()
    free = missing & ~held
    out[free] = np.clip(z[free] * scale + middle, low, high)
    return out, settled


def _cells(quotes: DataFrame, instruments: DataFrame) -> DataFrame:
    """(symbol_id, day, cell, width, bid, ask): one row a cell with a reading. The
    aggregation combines map-side: a cell's readings are a count of each distinct price."""
    grids = instruments.where("grid_ms > 0").groupBy("symbol_id").agg(F.min("grid_ms").alias("__grid_ms"))
    rows = quotes.where("bid_price_ticks IS NOT NULL AND ask_price_ticks IS NOT NULL AND timestamp_ns IS NOT NULL")
    rows = rows.select("symbol_id", "timestamp_ns", "bid_price_ticks", "ask_price_ticks").join(grids, "symbol_id")
    rows = rows.withColumn("width", F.expr("__grid_ms * 1000000"))
    rows = rows.select(
        "symbol_id",
        F.expr(f"(timestamp_ns - pmod(timestamp_ns, {DAY_NS})) div {DAY_NS}").alias("day"),
        F.expr("(timestamp_ns - pmod(timestamp_ns, width)) div width").alias("cell"),
        "width",
        *[F.when((F.col(f"{side}_price_ticks") > 0) & (F.col(f"{side}_price_ticks") < PRICE_LIMIT), F.col(f"{side}_price_ticks")).alias(side) for side in ("bid", "ask")],
    )
    return rows.groupBy("symbol_id", "day", "cell", "width").agg(
        *[F.median(side).alias(side) for side in ("bid", "ask")]
    )


OUT = T.StructType(
    [
        T.StructField("symbol_id", T.LongType()),
        T.StructField("day", T.LongType()),
        T.StructField("cell_start_ns", T.LongType()),
        T.StructField("bid", T.DoubleType()),
        T.StructField("ask", T.DoubleType()),
        T.StructField("fill", T.StringType()),
        T.StructField("settled", T.BooleanType()),
    ]
)


def _block_rows(rows: dict[str, np.ndarray], model: SpectrumModel) -> list[np.ndarray] | None:
    """The grid rows of one block; ``rows`` are its marker (cell < 0 sorts first)
    and its cells with those of the halo, in order of cell."""
    if rows["mark"][0] != 0:
        return None
    lo, hi, width, block = (int(rows[c][0]) for c in ("lo", "hi", "width", "block"))
    own_lo, own_hi = max(lo, block * model.block), min(hi, (block + 1) * model.block - 1)
    seen_lo, seen_hi = max(lo, own_lo - model.halo), min(hi, own_hi + model.halo)
    n = seen_hi - seen_lo + 1
    at = rows["cell"][1:] - seen_lo
    inside = (at >= 0) & (at < n)
    at = at[inside]
    read = np.zeros(n, bool)
    read[at] = True
    own = slice(own_lo - seen_lo, own_hi - seen_lo + 1)
    places = np.arange(seen_lo, seen_hi + 1)
    values, kinds, settled = [], np.where(read, 0, 2), True
    for side in ("bid", "ask"):
        x = np.full(n, np.nan)
        x[at] = rows[side][1:][inside]
        missing = np.isnan(x)
        before, after, b_at, a_at = (rows[f"{c}_{side}"][0] for c in ("before", "after", "before_at", "after_at"))
        level = [(p, v) for p, v in ((b_at, before), (a_at, after)) if not np.isnan(v)]
        known = places[~missing]
        # how far apart the known cells before and after each cell lie
        ends = np.unique(np.r_[[p for p, _ in level], known].astype(np.float64))
        left = np.searchsorted(ends, places, "right") - 1
        inner = (left >= 0) & (left < len(ends) - 1)
        gap = np.full(n, np.inf)
        gap[inner] = ends[left[inner] + 1] - ends[left[inner]]
        edge = (left >= 0) != (left < len(ends) - 1) if len(ends) else np.zeros(n, bool)
        gap[edge] = 0  # before the first or after the last known cell
        held = missing & (gap > model.halo)
        if missing.all():
            if level:
                x = np.interp(places, [p for p, _ in level], [v for _, v in level])
        else:
            outer = [(p, v) for p, v in level if p < seen_lo or p > seen_hi]
            reach = np.array(sorted([*outer, *zip(known, x[~missing])]))
            bridged = np.interp(places, reach[:, 0], reach[:, 1])
            x, done = imputed(x, missing, held, model)
            x[held] = bridged[held]
            settled &= done
        kinds = np.where((kinds == 2) & (held | missing.all()), 3, kinds)
        kinds = np.where(read & missing, 1, kinds)
        values.append(x[own])
    cells = np.arange(own_lo, own_hi + 1)
    return [np.full(len(cells), rows["symbol_id"][0]), np.full(len(cells), rows["day"][0]), cells * width, *values, kinds[own], np.full(len(cells), settled)]


_KINDS = np.array(["reading", "implausible", "ssa", "level"], dtype=object)


def regular_grid(quotes: DataFrame, instruments: DataFrame, model: SpectrumModel = SpectrumModel()) -> DataFrame:
    """One row per source, day and grid cell from the first to the last cell with a
    reading: ``cell_start_ns``, ``bid``, ``ask``, the mark ``fill`` and whether the
    imputation of the cell's block settled."""
    cells = materialize(_cells(quotes, instruments), "cells")
    cells = cells.withColumn("block", F.expr(f"(cell - pmod(cell, {model.block})) div {model.block}"))
    bounds = cells.groupBy("symbol_id", "day", "width").agg(F.min("cell").alias("lo"), F.max("cell").alias("hi"))
    blocks = bounds.withColumn(
        "block", F.explode(F.expr(f"sequence((lo - pmod(lo, {model.block})) div {model.block}, (hi - pmod(hi, {model.block})) div {model.block})"))
    )
    ends = cells.groupBy("symbol_id", "day", "block").agg(
        *[f(s, F.when(F.col(s).isNotNull(), F.col("cell"))).alias(f"{n}_{s}") for s in ("bid", "ask") for n, f in (("first", F.min_by), ("last", F.max_by))],
        *[f(F.when(F.col(s).isNotNull(), F.col("cell"))).alias(f"{n}_at_{s}") for s in ("bid", "ask") for n, f in (("first", F.min), ("last", F.max))],
    )
    order = Window.partitionBy("symbol_id", "day").orderBy("block")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    marks = blocks.join(ends, ["symbol_id", "day", "block"], "left")
    edge = [f"{e}{at}_{s}" for s in ("bid", "ask") for e in ("before", "after") for at in ("", "_at")]
    marks = marks.select(
        "symbol_id", "day", "block", "width", "lo", "hi",
        F.lit(0).alias("mark"), F.lit(None).cast("bigint").alias("cell"), *[F.lit(None).cast("double").alias(s) for s in ("bid", "ask")],
        *[F.last(f"last{at}_{s}", True).over(back).cast("double").alias(f"before{at}_{s}") for s in ("bid", "ask") for at in ("", "_at")],
        *[F.first(f"first{at}_{s}", True).over(ahead).cast("double").alias(f"after{at}_{s}") for s in ("bid", "ask") for at in ("", "_at")],
    )
    rest = F.pmod("cell", F.lit(model.block))
    near = F.array(F.col("block"), F.when(rest < model.halo, F.col("block") - 1), F.when(rest >= model.block - model.halo, F.col("block") + 1))
    rows = cells.withColumn("__near", F.explode(F.filter(near, lambda c: c.isNotNull()))).select(
        "symbol_id", "day", F.col("__near").alias("block"), "width", *[F.lit(None).cast("bigint").alias(c) for c in ("lo", "hi")],
        F.lit(1).alias("mark"), "cell", "bid", "ask", *[F.lit(None).cast("double").alias(c) for c in edge],
    )
    laid = marks.unionByName(rows).repartition("symbol_id", "day", "block").sortWithinPartitions("symbol_id", "day", "block", "mark", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(table: pa.Table) -> pa.RecordBatch:
            arrays = {}
            for c in table.column_names:
                col = table.column(c).combine_chunks()
                arrays[c] = col.fill_null(float("nan") if pa.types.is_floating(col.type) else 0).to_numpy(zero_copy_only=False)
            new = np.zeros(table.num_rows, bool)
            new[:1] = True
            for c in ("symbol_id", "day", "block"):
                new[1:] |= arrays[c][1:] != arrays[c][:-1]
            cut = np.flatnonzero(new)  # a block without a marker is beyond its source's first or last one
            done = [b for i, j in zip(cut, [*cut[1:], table.num_rows]) if (b := _block_rows({c: a[i:j] for c, a in arrays.items()}, model))]
            columns = [np.concatenate(c) for c in zip(*done)] if done else [np.zeros(0)] * 7
            arrays_out = [pa.array(columns[i].astype(np.int64)) for i in range(3)]
            arrays_out += [pa.array(columns[i], mask=np.isnan(columns[i])) for i in (3, 4)] + [pa.array(_KINDS[columns[5].astype(np.int64)], type=pa.string()), pa.array(columns[6].astype(bool))]
            return pa.RecordBatch.from_arrays(arrays_out, schema=arrow_schema(OUT))

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 60_000:
                continue
            whole = pa.Table.from_batches(held)
            cut = int(np.flatnonzero(whole.column("mark").to_numpy() == 0)[-1])
            if cut:
                yield flush(whole.slice(0, cut))
                held = whole.slice(cut).combine_chunks().to_batches()
                rows = sum(b.num_rows for b in held)
        if rows:
            yield flush(pa.Table.from_batches(held))

    return map_arrow(laid, run, OUT)
