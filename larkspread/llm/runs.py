"""Runs of identical or near-identical consecutive events, collapsed to one row.

Adjacent agglomeration: each entity's events are a linked list of one-event
runs; a priority queue holds the neighbouring runs that meet the similarity and
gap limits, most similar first, and the best pair is merged until none is left.
Two neighbouring runs are as similar as the two events that face each other, so a
merge changes no other pair's similarity, no pair is queued again, and the order in
which the queue merges never changes the outcome. That is what lets the work split:

1. Events are laid out by (entity, time bucket), one shuffle, sorted inside the
   partitions, and agglomerated bucket by bucket in a streaming Arrow pass. A hot
   entity spreads over its buckets; a bucket too long for the buffer is cut, and
   its parts count as buckets.
2. Only the first and last run of each bucket can continue in another one. Those
   edge runs, at most two a bucket, are agglomerated once more by entity and day;
   there, the last run of a bucket may join the first of the next, no others.

Defined cases
-------------
* A null entity or event time: the event has no place in a sequence and is left out.
* A value that is null or no number is similar to nothing: the event is a run of its own.
* Ties in time are ordered by the order column, then by the tie column.
* Events of two days never share a run. Empty input gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspread.session import materialize
from larkspread.workers import arrow_schema, map_arrow

DAY_NS = 86_400_000_000_000
#: Relative slack for decimal limits met exactly by binary doubles.
_SLACK = 1e-10


def distances(last: np.ndarray, first: np.ndarray, equal: int, tolerance: float) -> np.ndarray:
    """How unlike facing events are: the largest relative difference of the columns
    after the first ``equal``, which must be the same number; inf beyond the limit."""
    d = np.zeros(last.shape[1])
    for c in range(last.shape[0]):
        a, b = last[c], first[c]
        with np.errstate(invalid="ignore"):
            if c < equal:
                d = np.where(a == b, d, np.inf)
            else:
                larger = np.maximum(np.abs(a), np.abs(b))
                rel = np.abs(a - b)
                ok = rel <= larger * tolerance * (1 + _SLACK)
                d = np.where(ok, np.maximum(d, np.where(larger > 0, rel / np.where(larger > 0, larger, 1), 0.0)), np.inf)
    return d


def agglomerate(distance: np.ndarray) -> np.ndarray:
    """Run number of each element of a list whose neighbours i, i+1 are
    ``distance[i]`` apart (inf: beyond a limit)."""
    n = len(distance) + 1
    queue = [(d, i) for i, d in enumerate(distance.tolist()) if d != np.inf]
    heapq.heapify(queue)
    head, tail = list(range(n)), list(range(n))  # of the run that ends, begins at an element
    follows = list(range(1, n + 1))  # the linked list: run that comes after the one beginning here
    while queue:
        _, i = heapq.heappop(queue)
        left, right = head[i], i + 1
        end = tail[right]
        tail[left], head[end] = end, left
        follows[left] = follows[right]
    number = np.zeros(n, dtype=np.int64)
    at, k = 0, 0
    while at < n:
        number[at : follows[at]] = k
        at, k = follows[at], k + 1
    return number


def _collapse(rows: dict[str, np.ndarray], cut: np.ndarray, values: Sequence[str], equal: int, tolerance: float, gap_ns: int | None) -> dict[str, np.ndarray]:
    """Rows (runs in order) merged within the lists that start at ``cut``."""
    n = len(rows["start_ns"])
    lasts = np.stack([rows[f"last_{v}"] for v in values])
    firsts = np.stack([rows[f"first_{v}"] for v in values])
    d = distances(lasts[:, :-1], firsts[:, 1:], equal, tolerance) if n > 1 else np.zeros(0)
    if "edge" in rows and n > 1:  # the last run of a list meets the first of the next, no other two
        d = np.where((rows["edge"][:-1] & 2 > 0) & (rows["edge"][1:] & 1 > 0), d, np.inf)
    if gap_ns is not None and n > 1:
        d = np.where(rows["start_ns"][1:] - rows["end_ns"][:-1] <= gap_ns, d, np.inf)
    starts, ends = np.flatnonzero(cut), np.r_[np.flatnonzero(cut)[1:], n]
    begin = cut.copy()
    for i, j in zip(starts.tolist(), ends.tolist()):
        if j - i > 1:
            number = agglomerate(d[i : j - 1])
            begin[i + 1 : j] = number[1:] != number[:-1]
    first = np.flatnonzero(begin)
    last = np.r_[first[1:], n] - 1
    out = {c: (a[last] if c.startswith(("last_", "end_")) else a[first]) for c, a in rows.items()}
    out["n"] = np.add.reduceat(rows["n"], first) if n else rows["n"]
    list_first, list_last = np.zeros(n, bool), np.zeros(n, bool)
    list_first[starts], list_last[ends - 1] = True, True
    out["edge"] = list_first[first] * 1 + list_last[last] * 2
    return out


def collapse_runs(
    events: DataFrame,
    entity: str,
    time_ns: str,
    order: str,
    same: Sequence[str],
    near: Sequence[str],
    tie: str | None = None,
    tolerance: float = 0.001,
    gap_ns: int | None = None,
    bucket_ns: int = 900_000_000_000,
    at_least: int = 1,
    once: bool = False,
    buffer_rows: int = 100_000,
) -> DataFrame:
    """Runs of ``events``: entity, day, ``start_ns``, ``end_ns``, ``first_<order>``,
    ``last_<order>``, ``n`` events, ``duration_ns`` and the first event's values.

    same: columns equal as numbers; near: columns within ``tolerance`` of the
    larger one. at_least: least number of events of the runs returned. once: the
    events may hold copies (same entity, time and order), of which the one least
    by ``tie`` counts; they share a bucket, so no further shuffle is needed.
    """
    values = [*same, *near]
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    rows = events.select(
        F.col(f"`{entity}`").cast("string").alias("entity"),
        F.col(f"`{time_ns}`").cast("bigint").alias("at_ns"),
        F.col(f"`{order}`").cast("bigint").alias("rank"),
        (F.col(f"`{tie}`").cast("bigint") if tie else F.lit(0).cast("bigint")).alias("tie"),
        *[number(c).alias(f"v{i}") for i, c in enumerate(values)],
    ).where("entity IS NOT NULL AND at_ns IS NOT NULL")
    rows = rows.withColumn("bucket", F.expr(f"(at_ns - pmod(at_ns, {bucket_ns})) div {bucket_ns}"))
    laid = rows.repartition("entity", "bucket").sortWithinPartitions("entity", "bucket", "at_ns", "rank", "tie")
    names = [f"{end}_v{i}" for i in range(len(values)) for end in ("first", "last")]
    runs = T.StructType(
        [T.StructField("entity", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in ("start_ns", "end_ns", "first_rank", "last_rank", "n")]
        + [T.StructField(c, T.DoubleType()) for c in names]
        + [T.StructField("edge", T.LongType())]
    )
    cols = [f"v{i}" for i in range(len(values))]

    def arrays(table: pa.Table) -> dict[str, np.ndarray]:
        out = {}
        for c in table.column_names:
            col = table.column(c).combine_chunks()
            kind = col.type
            null = float("nan") if pa.types.is_floating(kind) else None if pa.types.is_string(kind) else -(1 << 63)
            out[c] = col.dictionary_encode().indices.to_numpy(zero_copy_only=False) if null is None else col.fill_null(null).to_numpy(zero_copy_only=False)
        return out

    def batch_of(table: pa.Table, at: np.ndarray, out: dict[str, np.ndarray], floor: int, edges: bool) -> pa.RecordBatch:
        keep = (out["n"] >= floor) | ((out["edge"] > 0) if edges else False)
        least = -(1 << 63)
        columns = [table.column("entity").combine_chunks().take(pa.array(at[keep])).cast(pa.string())]
        for f in runs.fields[1:]:
            x = out[f.name][keep]
            columns.append(pa.array(x, mask=np.isnan(x) if f.name in names else x == least if f.name.endswith("rank") else None))
        return pa.RecordBatch.from_arrays(columns, schema=arrow_schema(runs))

    def stream(batches: Iterator[pa.RecordBatch], changes, flush, most: int, splits=None) -> Iterator[pa.RecordBatch]:
        """Flushes whole lists, ``most`` rows or more at a time; a list longer than four
        times that is cut where ``splits`` allows, and its parts count as lists."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < most:
                continue
            whole = pa.Table.from_batches(held)
            a = arrays(whole)
            cut = np.flatnonzero(changes(a))[-1]
            if not cut and splits is not None and size >= 4 * most:
                cut = np.flatnonzero(splits(a))[-1]
            if cut:
                yield flush(whole.slice(0, cut))
                held = whole.slice(cut).combine_chunks().to_batches()
                size = sum(b.num_rows for b in held)
        if size:
            yield flush(pa.Table.from_batches(held))

    def changed(*keys: np.ndarray) -> np.ndarray:
        new = np.zeros(len(keys[0]), bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        return new

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(table: pa.Table) -> pa.RecordBatch:
            a = arrays(table)
            day = a["at_ns"] // DAY_NS
            if once:
                keep = np.flatnonzero(changed(a["entity"], a["at_ns"], a["rank"]) | (a["rank"] == -(1 << 63)))
                a = {c: x[keep] for c, x in a.items()}
                day = day[keep]
            else:
                keep = np.arange(table.num_rows)
            cut = changed(a["entity"], a["bucket"], day)
            r = {"at": keep, "start_ns": a["at_ns"], "end_ns": a["at_ns"], "first_rank": a["rank"], "last_rank": a["rank"], "n": np.ones(len(keep), np.int64)}
            r |= {f"{end}_{c}": a[c] for c in cols for end in ("first", "last")}
            out = _collapse(r, cut, cols, len(same), tolerance, gap_ns)
            return batch_of(table, out["at"], out, at_least, True)

        return stream(batches, lambda a: changed(a["entity"], a["bucket"]), flush, buffer_rows, lambda a: changed(a["at_ns"], a["rank"]))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(table: pa.Table) -> pa.RecordBatch:
            a = arrays(table)
            r = {"at": np.arange(table.num_rows)} | {f.name: a[f.name] for f in runs.fields[1:]}
            out = _collapse(r, changed(a["entity"], a["day"]), cols, len(same), tolerance, gap_ns)
            return batch_of(table, out["at"], out, at_least, False)

        return stream(batches, lambda a: changed(a["entity"], a["day"]), flush, buffer_rows)

    first = materialize(map_arrow(laid, within, runs), "runs")
    edges = first.where("edge > 0").withColumn("day", F.expr(f"(start_ns - pmod(start_ns, {DAY_NS})) div {DAY_NS}"))
    edges = edges.repartition("entity", "day").sortWithinPartitions("entity", "day", "start_ns", F.asc_nulls_first("first_rank"))
    merged = first.where("edge = 0").unionByName(map_arrow(edges, across, runs))
    shown: list[Column] = [F.col("entity").alias(entity), F.expr(f"(start_ns - pmod(start_ns, {DAY_NS})) div {DAY_NS}").alias("day"), F.col("start_ns"), F.col("end_ns")]
    shown += [F.col("first_rank").alias(f"first_{order}"), F.col("last_rank").alias(f"last_{order}"), F.col("n"), F.expr("end_ns - start_ns").alias("duration_ns")]
    shown += [F.col(f"first_v{i}").alias(c) for i, c in enumerate(values)]
    return merged.select(*shown)
