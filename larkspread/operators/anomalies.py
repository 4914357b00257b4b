"""Implausible quote readings, flagged against their own source's behaviour.

Each source (symbol) and day is a sequence observed through four channels: bid
and ask price, bid and ask size. A hidden Markov model runs over every channel;
forward-backward gives each row's state probabilities and the likeliest state is
the row's flag. Only the impossible is settled by hard bounds.

States and emissions
--------------------
normal       any reading; it repeats the one before with the source's own repeat rate
spike        a price that leaves the level of the rows around it and comes back to it, a
             size beyond the usual ones: the evidence against normal grows with a power of
             the distance in usual steps (of the usual size of the day)
stuck        a run of rows of the same price and size: the run's first row is new, all
             others repeat with certainty, and the state lasts until the run ends
out_of_range the hard bounds of the channel are broken; nothing else can break them.
             A stuck run may pass through such rows (fifth state: stuck and out of range)

Estimated for each source: the usual step (median price change), the usual sizes of
each day, the rate of repeats of either side, how often prices or sizes leave the
usual for the far range. The model's limits fix where a state becomes the likelier
one at reference rates: a spike at ``price_steps`` usual steps or ``size_factor``
usual sizes, a stuck run at ``stuck_rows`` rows (whatever the repeat rate: the
probability of getting stuck is that of so long a run by chance).

Rows at which only the normal state is possible (no repeat, no far reading, nothing
broken) cut the chain: before and after them the recursions know the state. So they
run over the stretches between such rows only, exactly, many stretches at a time.

Plan
----
1. Rows are laid out by (symbol, block), a block being a range of sequence numbers that
   holds ``block`` rows on average, and sorted. One streaming
   pass over whole blocks counts steps, sizes and repeats into mergeable histograms,
   and puts out each block's first and last ``halo`` rows. Steps from block to block
   come from one row a block.
2. Scales are one row a source and day. They are broadcast only after a count
   shows them below ``BROADCAST_ROWS``; above, they are joined by shuffle.
3. Rows are laid out once more together with the halo rows of the blocks before and
   after, and judged in a second streaming pass. A source with a third of all rows
   spreads over as many blocks as its share, and a task holds one buffer of rows however
   long its partition is.

Defined cases
-------------
* A null in any of the four readings: the row takes part in no run and is never
  stuck; a null reading itself is neither spike nor out of range.
* Repeats (same symbol and sequence): one copy is kept, the least by time and readings.
* Null symbol, sequence or time: no place in any sequence; row-wise bounds only.
  Such a row comes out where it breaks one, each distinct one once, with a null
  ``p_abnormal``; without a broken bound nothing can be said of it and it is left out.
* A source without any price change: step 1. A day without sizes: no size spike.
* The halo counts rows, however far apart their numbers are. Runs need ``stuck_rows``
  of them, spikes four with plausible prices; a border among more nulls than ``halo``
  rows hold may miss a spike right at it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspread.session import materialize
from larkspread.workers import arrow_schema, map_arrow

DAY_NS = 86_400_000_000_000
PRICE_LIMIT = 9_999_999_999
BROADCAST_ROWS = 100_000
_BINS = 64  # histogram bins per factor e of a size
_CHANNELS = ("bid_price_ticks", "ask_price_ticks", "bid_qty", "ask_qty")


@dataclass(frozen=True)
class SpikeModel:
    """Parameters of the model; the defaults are the production ones."""

    stuck_rows: int = 12
    spike_rows: int = 3
    price_steps: float = 20.0
    size_quantile: float = 0.95
    size_factor: float = 8.0
    tail: float = 16.0  # power of the distance by which the evidence for a spike grows
    near: float = 0.25  # share of the limit below which a reading is no spike's
    spike_rate: float = 2e-3  # rate of spikes at which the limits hold as they stand
    rates: tuple[float, float] = (1e-4, 1e-2)  # bounds of a source's estimated rate of spikes
    repeats: tuple[float, float] = (0.01, 0.9)  # bounds of a source's estimated rate of repeats
    leave: float = 0.5  # probability of leaving a spike or a broken stretch at each row
    broken_rate: float = 1e-3
    block: int = 8192
    halo: int = 64


def _blocked(placed: DataFrame, model: SpikeModel) -> DataFrame:
    """Rows with ``__block``: ranges of sequence numbers that hold ``block`` rows of their
    source on average, however far apart its numbers are. The spans are one row a
    source; they are broadcast only after a count shows them below ``BROADCAST_ROWS``."""
    spans = placed.groupBy("symbol_id").agg(F.min("sequence").cast("double").alias("__least"), F.max("sequence").cast("double").alias("__most"), F.count(F.lit(1)).alias("__n"))
    width = F.greatest(F.lit(1.0), F.ceil((F.col("__most") - F.col("__least") + 1) / F.ceil(F.col("__n") / model.block)))
    spans = materialize(spans.select(F.col("symbol_id").alias("__of"), "__least", width.cast("double").alias("__width")), "spans")
    met = F.broadcast(spans) if spans.count() <= BROADCAST_ROWS else spans
    rows = placed.join(met, F.col("symbol_id") == F.col("__of"))
    return rows.withColumn("__block", F.floor((F.col("sequence") - F.col("__least")) / F.col("__width")).cast("bigint")).drop("__of", "__least", "__width")


def _in_order(rows: DataFrame, *before: str) -> DataFrame:
    """Rows laid out by (symbol, block), sorted; of repeats the order is that of all columns."""
    return rows.sortWithinPartitions("symbol_id", "__block", *before, "sequence", "timestamp_ns", *_CHANNELS)


def _whole_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of whole blocks of about ``most`` rows, from rows sorted by block. A block
    is bounded by its sequence range and repeats of it."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        whole = pa.Table.from_batches(held)
        symbol, block = (whole.column(c).to_numpy() for c in ("symbol_id", "__block"))
        edges = np.flatnonzero((symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1]))
        if len(edges):
            cut = int(edges[-1]) + 1
            yield whole.slice(0, cut)
            held = whole.slice(cut).combine_chunks().to_batches()
            rows = sum(x.num_rows for x in held)
    if rows:
        yield pa.Table.from_batches(held)


def _take(table: pa.Table, name: str, null: int = 0) -> np.ndarray:
    return table.column(name).combine_chunks().fill_null(null).to_numpy(zero_copy_only=False)


_STEP, _SIZE, _REPEAT, _EDGE, _ROW, _DAY = 0, 1, 3, 4, 5, 6  # sizes: 1 bid, 2 ask
_WALKED = T.StructType([T.StructField(c, T.LongType()) for c in ("symbol_id", "kind", "a", "b", "c", "d", "e", "f", "g", "h")])


def _walk_table(table: pa.Table, model: SpikeModel) -> pa.RecordBatch:
    """What whole blocks tell of their sources, as rows of ``_WALKED``:

    step cells (a: change, b: rows); size cells (a: day, b: bin, c: rows); repeats (a:
    side, b: repeated, c: successive rows); block edges (a: side, b: block, c: first, d:
    last plausible price); border rows (a: block, b: 1 first, 2 last, 3 both, c: sequence,
    d: time, e to h: readings); days (a: day).
    """
    symbol, block, sequence, ns = (_take(table, c) for c in ("symbol_id", "__block", "sequence", "timestamp_ns"))
    other = np.r_[True, (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])]
    keep = np.flatnonzero(other | np.r_[True, sequence[1:] != sequence[:-1]])
    symbol, block, sequence, ns, other = (x[keep] for x in (symbol, block, sequence, ns, other))
    values = [_take(table, c)[keep] for c in _CHANNELS]
    nulls = [table.column(c).is_null().to_numpy()[keep] for c in _CHANNELS]
    day = ns // DAY_NS
    out: list[list[np.ndarray]] = []

    def put(kind: int, of: np.ndarray, *columns: np.ndarray) -> None:
        out.append([of, np.full(len(of), kind), *columns, *[np.zeros(len(of), np.int64)] * (8 - len(columns))])

    def count(kind: int, *columns: np.ndarray) -> None:
        if len(columns[0]):
            cells, rows = np.unique(np.stack(columns), axis=1, return_counts=True)
            put(kind, *cells, rows)

    for c in (0, 1):
        good = np.flatnonzero(~nulls[c] & (values[c] > 0) & (values[c] < PRICE_LIMIT))
        if not len(good):
            continue
        of, at, price = symbol[good], block[good], values[c][good]
        new = np.r_[True, (of[1:] != of[:-1]) | (at[1:] != at[:-1])]
        step = np.abs(np.diff(price))
        seen = ~new[1:] & (step > 0)
        count(_STEP, of[1:][seen], step[seen])
        starts, ends = np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(good)] - 1
        put(_EDGE, of[starts], np.full(len(starts), c), at[starts], price[starts], price[ends])
    for c in (2, 3):
        good = np.flatnonzero(~nulls[c] & (values[c] > 0))
        bins = np.floor(np.log(values[c][good].astype(np.float64)) * _BINS).astype(np.int64)
        count(_SIZE + c - 2, symbol[good], day[good], bins)
    whole = ~(nulls[0] | nulls[1] | nulls[2] | nulls[3])
    pair = whole[1:] & whole[:-1] & ~other[1:] & (day[1:] == day[:-1])
    for side in (0, 1):
        same = pair & (values[side][1:] == values[side][:-1]) & (values[side + 2][1:] == values[side + 2][:-1])
        of, inverse = np.unique(symbol[1:][pair], return_inverse=True)
        put(_REPEAT, of, np.full(len(of), side), np.bincount(inverse, weights=same[pair]).astype(np.int64), np.bincount(inverse))
    days = np.unique(np.stack([symbol, day]), axis=1)
    put(_DAY, *days)
    starts = np.flatnonzero(other)
    size = np.diff(np.r_[starts, len(other)])
    place = np.arange(len(other)) - np.repeat(starts, size)
    first, last = place < model.halo, place >= np.repeat(size, size) - model.halo
    border = np.flatnonzero(first | last)
    put(_ROW, symbol[border], block[border], (first * 1 + last * 2)[border], sequence[border], ns[border], *(v[border] for v in values))
    columns = [np.concatenate([np.asarray(x[k], dtype=np.int64) for x in out]) for k in range(10)]
    masks = [np.concatenate([m[border] if x[1][:1].tolist() == [_ROW] else np.zeros(len(x[0]), bool) for x in out]) for m in nulls]
    arrays = [pa.array(c) for c in columns[:6]] + [pa.array(c, mask=m) for c, m in zip(columns[6:], masks)]
    return pa.RecordBatch.from_arrays(arrays, schema=arrow_schema(_WALKED))


def walk_sources(blocked: DataFrame, model: SpikeModel, buffer_rows: int = 150_000) -> DataFrame:
    """The written result of the first pass over rows that have a place and a block."""
    rows = blocked.select("symbol_id", "__block", "sequence", "timestamp_ns", *_CHANNELS)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches, buffer_rows):
            yield _walk_table(table, model)

    return materialize(map_arrow(_in_order(rows.repartition("symbol_id", "__block")), walk, _WALKED), "walked")


def scales_of(walked: DataFrame, model: SpikeModel) -> DataFrame:
    """(symbol_id, day, step, spike_price, repeat_bid, repeat_ask, usual_bid_qty,
    usual_ask_qty, spike_bid_qty, spike_ask_qty) of every source and day: the median
    non-zero price change and a high quantile of the day's sizes, the share of changes
    and sizes beyond the limits, the rate of repeats of either side."""
    order = Window.partitionBy("symbol_id", "a").orderBy("b")
    between = walked.where(f"kind = {_EDGE}").select("symbol_id", F.abs(F.col("c") - F.lag("d").over(order)).alias("value"))
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    steps = walked.where(f"kind = {_STEP}").select("symbol_id", none.alias("kind"), none.alias("day"), F.col("a").alias("value"), F.col("b").alias("rows"))
    steps = steps.unionByName(between.where("value > 0").select("symbol_id", none.alias("kind"), none.alias("day"), "value", one.alias("rows")))
    sizes = walked.where(f"kind IN ({_SIZE}, {_SIZE + 1})").select("symbol_id", "kind", F.col("a").alias("day"), F.col("b").alias("value"), F.col("c").alias("rows"))
    cells = steps.unionByName(sizes).groupBy("symbol_id", "kind", "day", "value").agg(F.sum("rows").alias("rows"))
    quantiles = cells.groupBy("symbol_id", "kind", "day").agg(F.sum("rows").alias("n"), F.sort_array(F.collect_list(F.struct("value", "rows"))).alias("bins"))
    target = F.col("n") * F.when(F.col("kind") == 0, F.lit(0.5)).otherwise(F.lit(model.size_quantile))
    walk = F.aggregate(
        "bins",
        F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("at")),
        lambda a, b: F.struct((a["seen"] + b["rows"]).alias("seen"), F.coalesce(a["at"], F.when(a["seen"] + b["rows"] >= target, b["value"])).alias("at")),
    )
    at = quantiles.withColumn("at", walk["at"])
    limit = F.when(F.col("kind") == 0, F.col("at") * model.price_steps).otherwise(F.col("at") + math.log(model.size_factor) * _BINS)
    far = F.aggregate(F.filter("bins", lambda b: b["value"] > limit), F.lit(0).cast("bigint"), lambda a, b: a + b["rows"])
    # a spike of a price is two far changes
    rate = F.least(F.greatest(far / F.col("n") / F.when(F.col("kind") == 0, 2).otherwise(1), F.lit(model.rates[0])), F.lit(model.rates[1]))
    at = at.withColumn("rate", rate)
    of_source = at.where("kind = 0").select("symbol_id", F.col("at").cast("double").alias("step"), F.col("rate").alias("spike_price"))
    pairs = walked.where(f"kind = {_REPEAT}").groupBy("symbol_id").agg(
        *[(F.sum(F.when(F.col("a") == k, F.col("b"))) / F.nullif(F.sum(F.when(F.col("a") == k, F.col("c"))), F.lit(0))).alias(f"repeat_{side}") for k, side in enumerate(("bid", "ask"))]
    )
    of_day = at.where("kind > 0").groupBy("symbol_id", "day").agg(
        *[F.max(F.when(F.col("kind") == k, F.exp((F.col("at") + 1) / F.lit(float(_BINS))))).alias(f"usual_{c}") for k, c in ((1, "bid_qty"), (2, "ask_qty"))],
        *[F.max(F.when(F.col("kind") == k, F.col("rate"))).alias(f"spike_{c}") for k, c in ((1, "bid_qty"), (2, "ask_qty"))],
    )
    days = walked.where(f"kind = {_DAY}").select("symbol_id", F.col("a").alias("day")).distinct()
    return days.join(of_source, "symbol_id", "left").join(pairs, "symbol_id", "left").join(of_day, ["symbol_id", "day"], "left")


def source_scales(df: DataFrame, model: SpikeModel) -> DataFrame:
    """``scales_of`` the rows of ``df`` that have a place."""
    placed = df.where("symbol_id IS NOT NULL AND sequence IS NOT NULL AND timestamp_ns IS NOT NULL")
    return scales_of(walk_sources(_blocked(placed, model), model), model)


def _halo_rows(walked: DataFrame, model: SpikeModel) -> DataFrame:
    """Border rows for the blocks they are a halo of: a block's last rows go to the
    blocks after it, its first rows to those before it, as far as fewer than ``halo``
    rows lie between. Only block numbers and row counts meet in a window."""
    rows = walked.where(f"kind = {_ROW}").select(
        "symbol_id", F.col("a").alias("__from"), F.col("b").alias("side"), F.col("c").alias("sequence"), F.col("d").alias("timestamp_ns"), *[F.col(x).alias(c) for x, c in zip("efgh", _CHANNELS)]
    )
    # the number of rows is exact up to twice the halo, and not needed beyond
    blocks = rows.groupBy("symbol_id", "__from").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("symbol_id").orderBy("__from")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    blocks = blocks.withColumn("upto", upto)
    cell = F.struct(F.col("__from").alias("block"), F.col("upto"), F.col("n"))
    after = F.collect_list(cell).over(order.rowsBetween(1, model.halo))
    before = F.collect_list(cell).over(order.rowsBetween(-model.halo, -1))
    blocks = blocks.select(
        "symbol_id",
        "__from",
        F.transform(F.filter(after, lambda b: b["upto"] - b["n"] - F.col("upto") < model.halo), lambda b: F.struct(b["block"].alias("block"), F.lit(2).alias("side"))).alias("after"),
        F.transform(F.filter(before, lambda b: F.col("upto") - F.col("n") - b["upto"] < model.halo), lambda b: F.struct(b["block"].alias("block"), F.lit(1).alias("side"))).alias("before"),
    )
    targets = blocks.select("symbol_id", "__from", F.explode(F.concat("after", "before")).alias("to"))
    met = rows.join(targets, ["symbol_id", "__from"]).where("(side & to.side) > 0")
    return met.select("symbol_id", "sequence", "timestamp_ns", *_CHANNELS, F.col("to.block").alias("__block"), F.lit(False).alias("__own"))


def _runs(key: np.ndarray) -> np.ndarray:
    """Length of the run of equal keys that each row lies in."""
    if not len(key):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return np.repeat(np.diff(np.r_[starts, len(key)]), np.diff(np.r_[starts, len(key)]))


def _same(seg: np.ndarray, whole: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """Run number: rows of a segment without nulls whose values all stay the same."""
    new = np.r_[True, (seg[1:] != seg[:-1]) | ~whole[1:] | ~whole[:-1]]
    for v in values:
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def _excursions(level: np.ndarray, seg: np.ndarray, step: np.ndarray, model: SpikeModel) -> np.ndarray:
    """How far, in usual steps, each row of a price lies outside a level that holds
    before and after it. ``level`` has only plausible prices; 0 where it does not
    leave and come back within ``spike_rows`` rows."""
    n, far = len(level), np.zeros(len(level))
    if n < 3:
        return far
    near = np.arange(n)
    for length in range(1, model.spike_rows + 1):
        for first in range(-length + 1, 1):  # the row is number -first of an excursion of this length
            before, after = near + first - 1, near + first + length
            ok = (before >= 0) & (after < n)
            b, a = np.clip(before, 0, n - 1), np.clip(after, 0, n - 1)
            ok &= (seg[b] == seg) & (seg[a] == seg)
            out = np.full(n, np.inf)
            for k in range(length):
                at = np.clip(near + first + k, 0, n - 1)
                x = level[at]
                out = np.minimum(out, np.minimum(np.abs(x - level[b]), np.abs(x - level[a])))
            back = np.abs(level[b] - level[a])
            score = np.where(ok & (back < out / 4), out / step, 0.0)
            far = np.maximum(far, score)
    return far


NORMAL, SPIKE, STUCK, BROKEN, STUCK_BROKEN = range(5)


@dataclass(frozen=True)
class Channel:
    """One channel of rows in sequence order: log evidence for a spike (-inf: none is
    possible), whether the row repeats the one before, whether it may be stuck,
    whether it is impossible, and the source's rates of repeats and spikes."""

    evidence: np.ndarray
    repeats: np.ndarray
    run: np.ndarray
    broken: np.ndarray
    repeat_rate: np.ndarray
    spike_rate: np.ndarray


def posteriors(seg: np.ndarray, x: Channel, model: SpikeModel) -> np.ndarray:
    """Forward-backward state probabilities of a channel, shape (rows, 5).

    Rows at which all but the normal state are impossible are certain. Each stretch of
    other rows begins and ends at such a row or at the end of a sequence, so its
    recursions are exact; stretches of like length advance together.
    """
    n = len(seg)
    out = np.zeros((n, 5))
    out[:, NORMAL] = 1.0
    able = x.run >= 2
    open_ = x.broken | able | (x.evidence > -np.inf)
    rows = np.flatnonzero(open_)
    if not len(rows):
        return out
    new = np.r_[True, (np.diff(rows) > 1) | (seg[rows[1:]] != seg[rows[:-1]])]
    starts = np.flatnonzero(new)
    lengths = np.diff(np.r_[starts, len(rows)])
    firsts = rows[starts]
    classes = np.ceil(np.log2(lengths)).astype(np.int64)
    for k in np.unique(classes):
        chosen = np.flatnonzero(classes == k)
        most = max(1, 2_000_000 // (1 << int(k)))
        for c in range(0, len(chosen), most):
            part = chosen[c : c + most]
            _stretches(firsts[part], lengths[part], x, able, model, out)
    return out


def _stretches(first: np.ndarray, length: np.ndarray, x: Channel, able: np.ndarray, model: SpikeModel, out: np.ndarray) -> None:
    """Fills in the probabilities of stretches of like length."""
    steps = int(length.max()) + 1  # the row after is normal for sure
    at = first[:, None] + np.arange(steps)
    inside = np.arange(steps) < length[:, None]
    at = np.where(inside, at, 0).T
    inside = inside.T
    q, spike = x.repeat_rate[first], x.spike_rate[first]
    broke, leave = model.broken_rate, model.leave
    stay = 1 - spike - broke
    stick = (q * stay) ** (model.stuck_rows - 1.5)
    repeats = (x.repeats[at] & inside).astype(np.float64)
    broken, may = x.broken[at] & inside, able[at] & inside
    chance = np.where(repeats > 0, q, 1.0)
    emission = np.zeros((5, steps, len(first)))
    emission[NORMAL] = np.where(broken, 0.0, chance)
    emission[SPIKE] = np.where(broken | ~inside, 0.0, chance * np.exp(np.minimum(x.evidence[at], 300.0)))
    emission[STUCK] = may & ~broken
    emission[BROKEN] = np.where(broken, chance, 0.0)
    emission[STUCK_BROKEN] = may & broken
    forward = np.empty((steps, 5, len(first)))
    n, p, s, b, z = np.ones(len(first)), *np.zeros((4, len(first)))
    for i in range(steps):
        r = repeats[i]
        new = 1 - r
        begin = new * stick * (n + p + s + b + z)
        a = np.stack([
            stay * n + leave * (p + b) + new * (stay * s + leave * z),
            spike * (n + b) + (1 - leave) * p + new * spike * (s + z),
            begin + r * ((1 - broke) * s + leave * z),
            broke * (n + p) + (1 - leave) * b + new * (broke * s + (1 - leave) * z),
            begin * broke + r * (broke * s + (1 - leave) * z),
        ]) * emission[:, i]
        a /= a.sum(axis=0)
        forward[i] = a
        n, p, s, b, z = a
    back = np.ones((5, len(first)))
    for i in range(steps - 1, -1, -1):
        here = forward[i] * back
        mine = inside[i]
        out[at[i, mine]] = (here / here.sum(axis=0)).T[mine]
        n, p, s, b, z = emission[:, i] * back
        r = repeats[i]
        new = 1 - r
        begin = new * stick * (s + broke * z)
        back = np.stack([
            stay * n + spike * p + broke * b + begin,
            leave * n + (1 - leave) * p + broke * b + begin,
            new * (stay * n + spike * p + broke * b) + begin + r * ((1 - broke) * s + broke * z),
            leave * n + spike * p + (1 - leave) * b + begin,
            new * (leave * n + spike * p + (1 - leave) * b) + begin + r * (leave * s + (1 - leave) * z),
        ])
        back /= back.sum(axis=0)


def judge(seg: np.ndarray, values: list[np.ndarray], nulls: list[np.ndarray], scales: dict[str, np.ndarray], model: SpikeModel) -> tuple[np.ndarray, np.ndarray]:
    """Flags (rows, 3: spike, stuck, out of range) and the probability of the
    likeliest abnormal state, for rows in sequence order; ``seg`` numbers sequences."""
    n = len(seg)
    bid, ask, bid_qty, ask_qty = values
    no_bid, no_ask, no_bq, no_aq = nulls
    whole = ~(no_bid | no_ask | no_bq | no_aq)
    crossed = ~no_bid & ~no_ask & (ask <= bid)
    runs = []
    for price, size in ((bid, bid_qty), (ask, ask_qty)):
        number = _same(seg, whole, price, size)
        runs.append((np.where(whole, _runs(number), 0), np.r_[False, (number[1:] == number[:-1]) & whole[1:]] if n else np.zeros(0, bool)))
    rate = lambda name, low, high: np.clip(np.where(np.isnan(scales[name]), low, scales[name]), low, high)
    flags, abnormal = np.zeros((n, 3), bool), np.zeros(n)
    never, no = np.zeros(n, np.int64), np.zeros(n, bool)
    start = model.spike_rate * model.leave
    for c, (v, null) in enumerate(zip(values, nulls)):
        far = np.zeros(n)  # distance in units of the spike limit
        if c < 2:
            broken = (~null & ((v <= 0) | (v >= PRICE_LIMIT))) | crossed
            part = np.flatnonzero(~null & (v > 0) & (v < PRICE_LIMIT))
            step = np.maximum(np.where(np.isnan(scales["step"]), 1.0, scales["step"]), 1.0)
            far[part] = _excursions(v[part].astype(np.float64), seg[part], step[part], model) / model.price_steps
            run, repeats = runs[c]
            spike_rate, repeat_rate = rate("spike_price", *model.rates), rate(("repeat_bid", "repeat_ask")[c], *model.repeats)
        else:
            broken = ~null & (v < 0)
            usual = scales[("usual_bid_qty", "usual_ask_qty")[c - 2]]
            good = np.flatnonzero(~null & (usual > 0))
            far[good] = v[good] / (usual[good] * model.size_factor)
            run, repeats = never, no
            spike_rate, repeat_rate = rate(("spike_bid_qty", "spike_ask_qty")[c - 2], *model.rates), np.full(n, model.repeats[0])
        with np.errstate(divide="ignore"):
            # at the limit and the rate of reference a lone spike is as likely as none
            evidence = np.where(far >= model.near, model.tail * np.log(np.maximum(far, 1e-300)) - np.log(start), -np.inf)
        p = posteriors(seg, Channel(evidence, repeats, run, broken, repeat_rate, spike_rate), model)
        likeliest = p.argmax(axis=1)
        flags[:, 0] |= likeliest == SPIKE
        flags[:, 1] |= (likeliest == STUCK) | (likeliest == STUCK_BROKEN)
        flags[:, 2] |= broken
        abnormal = np.maximum(abnormal, 1 - p[:, NORMAL])
    return flags, abnormal


OUT = T.StructType(
    [T.StructField("symbol_id", T.LongType()), T.StructField("sequence", T.LongType()), T.StructField("timestamp_ns", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in _CHANNELS]
    + [T.StructField(c, T.BooleanType()) for c in ("spike", "stuck", "out_of_range")]
    + [T.StructField("p_abnormal", T.DoubleType())]
)


_SCALES = ("step", "spike_price", "repeat_bid", "repeat_ask", "usual_bid_qty", "usual_ask_qty", "spike_bid_qty", "spike_ask_qty")


def _judge_table(table: pa.Table, model: SpikeModel, flagged_only: bool) -> pa.RecordBatch:
    """Whole blocks, sorted by symbol, block, day and sequence -> their own rows."""
    symbol, block, sequence, ns = (_take(table, c) for c in ("symbol_id", "__block", "sequence", "timestamp_ns"))
    day = ns // DAY_NS
    change = np.r_[True, (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1]) | (day[1:] != day[:-1])]
    once = change | np.r_[True, sequence[1:] != sequence[:-1]]
    keep = np.flatnonzero(once)
    seg = np.cumsum(change)[keep]
    values = [_take(table, c)[keep] for c in _CHANNELS]
    nulls = [table.column(c).is_null().to_numpy()[keep] for c in _CHANNELS]
    scales = {c: table.column(c).cast(pa.float64()).combine_chunks().fill_null(float("nan")).to_numpy()[keep] for c in _SCALES}
    flags, p = judge(seg, values, nulls, scales, model)
    own = _take(table, "__own", False)[keep]
    if flagged_only:
        own = own & flags.any(axis=1)
    at = np.flatnonzero(own)
    rows = keep[at]
    columns = [pa.array(symbol[rows]), pa.array(sequence[rows]), pa.array(ns[rows])]
    columns += [pa.array(v[at], mask=m[at]) for v, m in zip(values, nulls)]
    columns += [pa.array(flags[at, k]) for k in range(3)] + [pa.array(p[at])]
    return pa.RecordBatch.from_arrays(columns, schema=arrow_schema(OUT))


def _out_of_place(rows: DataFrame) -> DataFrame:
    """Rows without a place in a sequence that break a hard bound."""
    bid, ask, bid_qty, ask_qty = _CHANNELS
    broken = " OR ".join([f"{c} <= 0 OR {c} >= {PRICE_LIMIT}" for c in (bid, ask)] + [f"{c} < 0" for c in (bid_qty, ask_qty)] + [f"{ask} <= {bid}"])
    lost = rows.where("symbol_id IS NULL OR sequence IS NULL OR timestamp_ns IS NULL").where(broken).distinct()
    flags = {"spike": F.lit(False), "stuck": F.lit(False), "out_of_range": F.lit(True), "p_abnormal": F.lit(None).cast("double")}
    return lost.select("*", *[c.alias(n) for n, c in flags.items()])


def flag_readings(df: DataFrame, model: SpikeModel = SpikeModel(), flagged_only: bool = False, buffer_rows: int = 150_000) -> DataFrame:
    """Rows of ``df`` (L1 columns; others are dropped), repeats removed, with the
    flags ``spike``, ``stuck``, ``out_of_range`` and ``p_abnormal``."""
    columns = ["symbol_id", "sequence", "timestamp_ns", *_CHANNELS]
    rows = df.select(*[F.col(c).cast("bigint").alias(c) for c in columns])
    placed = rows.where("symbol_id IS NOT NULL AND sequence IS NOT NULL AND timestamp_ns IS NOT NULL")
    blocked = _blocked(placed, model)
    walked = walk_sources(blocked, model, buffer_rows)
    scales = materialize(scales_of(walked, model), "scales")
    small = scales.count() <= BROADCAST_ROWS
    own = blocked.select(*columns, "__block", F.lit(True).alias("__own"))
    spread = own.unionByName(_halo_rows(walked, model)).withColumn("day", F.expr(f"floor(timestamp_ns / {DAY_NS}D)").cast("bigint"))
    on = ["symbol_id", "day"]
    if small:  # after the layout, so that the scales are not shuffled with every row
        laid = spread.repartition("symbol_id", "__block").join(F.broadcast(scales), on, "left")
    else:
        laid = spread.join(scales, on, "left").repartition("symbol_id", "__block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches, buffer_rows):
            yield _judge_table(table, model, flagged_only)

    return map_arrow(_in_order(laid, "day"), run, OUT).unionByName(_out_of_place(rows))
