"""Out-of-sample evaluation: split, targets at event and clock horizons, losses.

Two readings of a prediction are kept apart. ``score`` uses truncated mids and
counts a zero prediction as up; ``compare`` uses exact mids, lets a zero abstain
and pairs the losses of three predictors. Skipped rows (no state) are only ever
sources, never missing as targets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspread.config import CompareOptions, StateSpace
from larkspread.errors import InvalidConfig, OutOfOrder, TooFewObservations
from larkspread.functions.book import exact_mid, weighted_mid, with_state
from larkspread.operators.ordering import BLOCK, dense_index, last_at_or_before, with_neighbours, with_previous

#: Two-sided 95 % normal quantile of the Wilson interval.
WILSON_Z = 1.96
_MASK = (1 << 64) - 1


def chronological_split(indexed: DataFrame, fraction: float, source: str = "symbol_id") -> DataFrame:
    """``indexed`` with ``train``: the first round(n * fraction) rows of each source,
    halves rounded up, and ``part_idx``, the dense number within the row's side.
    Sources left without rows on a side have null."""
    if not 0 < fraction < 1:
        raise InvalidConfig("the train fraction lies between 0 and 1")
    sizes = indexed.groupBy(source).agg(F.count(F.lit(1)).alias("__n")).withColumn("__cut", F.floor(F.col("__n") * F.lit(fraction) + F.lit(0.5)))
    both = (F.col("__cut") > 0) & (F.col("__cut") < F.col("__n"))
    out = indexed.join(sizes, source).withColumn("train", F.when(both, F.col("idx") < F.col("__cut")))
    return out.withColumn("part_idx", F.when(F.col("train"), F.col("idx")).otherwise(F.col("idx") - F.col("__cut"))).drop("__n", "__cut")


def test_part(split: DataFrame) -> DataFrame:
    """The test rows of a split, with ``idx`` counting from 0 in the test."""
    return split.where("NOT train").drop("train", "idx").withColumnRenamed("part_idx", "idx")


def train_part(split: DataFrame) -> DataFrame:
    """The training rows of a split, as quotes."""
    return split.where("train").drop("train", "idx", "part_idx")


def require_no_leak(split: DataFrame, source: str = "symbol_id", time: str = "timestamp_ns") -> None:
    """Raise unless every training time is at most every test time of its source."""
    edges = split.groupBy(source).agg(F.max(F.when(F.col("train"), F.col(time))).alias("a"), F.min(F.when(~F.col("train"), F.col(time))).alias("b"))
    bad = edges.where("a > b").limit(1).collect()
    if bad:
        raise OutOfOrder(f"source {bad[0][source]}: training reaches past the start of the test")


def predict(quotes: DataFrame, solved: DataFrame, space: StateSpace, by: tuple[str, ...] = ("symbol_id", "state")) -> DataFrame:
    """Quotes with state, weighted mid, adjustment, micro-price, p_up, the state's
    visits and a mark where they are fewer than 30; null without a state.

    The lookup has states x sources rows (by=("state",): one model for all); it is
    joined by key, and whether it is broadcast is left to its size at run time.
    """
    table = solved.select(*by, "g_star", "p_up", F.col("visits").alias("state_visits"))
    rows = with_state(quotes, space).withColumn("weighted_mid", F.when(F.col("state").isNotNull(), weighted_mid()))
    met = rows.join(table, list(by), "left")
    return met.withColumn("micro_price", F.col("mid") + F.col("g_star")).withColumn("low_evidence", F.col("state_visits") < 30)


def event_targets(test: DataFrame, space: StateSpace, horizons: tuple[int, ...], source: str = "symbol_id", block: int = BLOCK) -> DataFrame:
    """Test rows (``idx`` dense in the test) with ``state``, mids and the bid and ask of
    the quote each horizon of events ahead, all horizons in one pass."""
    rows = with_state(test, space).withColumn("exact", exact_mid()).withColumn("weighted", weighted_mid())
    ahead = {f"exact_{h}": ("exact", h) for h in horizons} | {f"mid_{h}": ("mid", h) for h in horizons}
    return with_neighbours(rows.select(source, "idx", "state", "mid", "exact", "weighted"), ahead, source, block)


def clock_targets(test: DataFrame, horizon_ns: int, source: str = "symbol_id", time: str = "timestamp_ns") -> DataFrame:
    """(source, idx, target_idx, target_exact): the last quote at most ``horizon_ns``
    after each row, ties to the latest; null where the data end before."""
    if horizon_ns < 1:
        raise InvalidConfig("a wall-clock horizon is at least 1 ns")
    ends = test.groupBy(source).agg(F.max(time).alias("__end"))
    asked = test.select(source, F.col("idx").alias("probe"), F.expr(f"try_add({time}, {horizon_ns}L)").alias("at"))
    inside = asked.join(ends, source).withColumn("resolved", F.coalesce(F.col("at") <= F.col("__end"), F.lit(False))).drop("__end")
    rows = test.select(source, time, "idx", exact_mid().alias("exact"))
    found = last_at_or_before(rows, inside.where("resolved").drop("resolved"), ["idx", "exact"], source, time)
    done = found.select(source, F.col("probe").alias("idx"), F.col("found_idx").alias("target_idx"), F.col("found_exact").alias("target_exact"))
    open_ = inside.where("NOT resolved").select(source, F.col("probe").alias("idx"), F.lit(None).cast("bigint").alias("target_idx"), F.lit(None).cast("double").alias("target_exact"))
    return done.unionByName(open_)


def _losses(predicted: Column, actual: Column, name: str) -> list[Column]:
    e = predicted - actual
    return [F.avg(F.abs(e)).alias(f"{name}_mae"), F.avg(e * e).alias(f"{name}_mse"), F.avg(e).alias(f"{name}_bias")]


def score(pairs: DataFrame, by: list[str]) -> DataFrame:
    """First reading. ``pairs`` has g_star, weighted, mid, target_mid (truncated) and
    p_up of rows with a state and a target. Predictions and truth are mid changes."""
    moved = (F.col("target_mid") - F.col("mid")).cast("double")
    change = {"naive": F.lit(0.0), "weighted": F.col("weighted") - F.col("mid"), "micro": F.col("g_star")}
    directed = moved != 0
    right = F.when(directed, F.when(F.when(F.col("g_star") >= 0, 1).otherwise(-1) == F.signum(moved), 1.0).otherwise(0.0))
    up = F.when(directed & F.col("p_up").isNotNull(), (moved > 0).cast("double"))
    known = F.when(up.isNotNull(), F.col("p_up"))
    out = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[c for name, p in change.items() for c in _losses(p, moved, name)],
        F.avg(right).alias("direction_accuracy"), F.count(right).alias("n_directional"),
        F.avg((known - up) * (known - up)).alias("brier"), F.avg(up).alias("base_rate"),
    )
    # the mean square of a constant forecast b of outcomes with mean b is b (1 - b)
    out = out.withColumn("brier_baseline", F.col("base_rate") * (1 - F.col("base_rate")))
    return out.withColumn("brier_skill", 1 - F.try_divide("brier", "brier_baseline")).drop("base_rate")


def wilson(correct: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wilson interval of a share; null for n = 0."""
    z2 = WILSON_Z * WILSON_Z
    p = F.try_divide(correct.cast("double"), n.cast("double"))
    centre = F.try_divide(p + F.try_divide(F.lit(z2), 2 * n), 1 + F.try_divide(F.lit(z2), n))
    half = F.try_divide(WILSON_Z * F.sqrt(F.try_divide(p * (1 - p), n.cast("double")) + F.try_divide(F.lit(z2), 4 * n * n)), 1 + F.try_divide(F.lit(z2), n))
    return centre - half, centre + half


def compare(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Second reading. ``pairs`` has exact, weighted, g_star, target (exact mid) and
    optionally ahead (events until the target) of rows with a state and a target."""
    actual, micro = F.col("target"), F.col("exact") + F.col("g_star")
    predicted = {"naive": F.col("exact"), "weighted": F.col("weighted"), "micro": micro}
    moved = actual - F.col("exact")

    def directions(name: str, p: Column) -> list[Column]:
        sure = (moved != 0) & (p != F.col("exact"))
        return [F.count_if(sure).alias(f"{name}_directional"), F.count_if(sure & (F.signum(p - F.col("exact")) == F.signum(moved))).alias(f"{name}_right")]

    out = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[c for name, p in predicted.items() for c in _losses(p, actual, name)],
        *[c for name, p in predicted.items() if name != "naive" for c in directions(name, p)],
        *[
            F.avg(d).alias(f"{kind}_vs_{base}")
            for base in ("naive", "weighted")
            for kind, d in (("mae", F.abs(micro - actual) - F.abs(predicted[base] - actual)), ("mse", (micro - actual) * (micro - actual) - (predicted[base] - actual) * (predicted[base] - actual)))
        ],
        F.count_if(moved != 0).alias("n_price_changing"), F.try_divide(F.count_if(moved > 0).cast("double"), F.count_if(moved != 0).cast("double")).alias("up_share"),
        *([F.avg("ahead").alias("mean_events_ahead")] if "ahead" in pairs.columns else []),
    )
    for name in ("weighted", "micro"):
        low, high = wilson(F.col(f"{name}_right"), F.col(f"{name}_directional"))
        out = out.withColumn(f"{name}_low", low).withColumn(f"{name}_high", high)
    return out


def unevaluated(candidates: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_unresolved, n_skipped). ``candidates`` has target and g_star, either null:
    unresolved rows have no target (the data end before a wall-clock horizon), skipped
    ones have a target but no prediction. The last rows of a source are no candidates of
    an event horizon; leave them out."""
    lost = F.col("target").isNull()
    return candidates.groupBy(*by).agg(F.count_if(lost).alias("n_unresolved"), F.count_if(~lost & F.col("g_star").isNull()).alias("n_skipped"))


def paired_blocks(pairs: DataFrame, by: list[str], block: int, source: str = "symbol_id") -> DataFrame:
    """(by, block, rows, four sums of paired loss differences): consecutive evaluated
    rows, ``block`` at a time, the last block of a source may be short."""
    micro = F.col("exact") + F.col("g_star")
    d = {}
    for base, p in (("naive", F.col("exact")), ("weighted", F.col("weighted"))):
        d[f"mae_vs_{base}"] = F.abs(micro - F.col("target")) - F.abs(p - F.col("target"))
        d[f"mse_vs_{base}"] = (micro - F.col("target")) * (micro - F.col("target")) - (p - F.col("target")) * (p - F.col("target"))
    keyed = pairs.select(*by, "idx", *[c.alias(n) for n, c in d.items()])
    if by != [source]:
        keyed = keyed.withColumn("__key", F.struct(*by))
    ranked = dense_index(keyed.withColumnRenamed("idx", "__order"), "__key" if by != [source] else source, "__order")
    return ranked.withColumn("block", F.expr(f"idx div {block}")).groupBy(*by, "block").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(n).alias(n) for n in d])


def split_mix(seed: int, n: int) -> np.ndarray:
    """First ``n`` outputs of the counter-based generator splitmix64."""
    with np.errstate(over="ignore"):
        # fixed values of the published generator
        z = np.uint64(seed & _MASK) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def bootstrap_interval(sums: np.ndarray, rows: np.ndarray, options: CompareOptions) -> tuple[float, float] | None:
    """2.5 and 97.5 % nearest-rank quantiles of means over resampled blocks.

    Resamples are drawn one after the other from one stream, a bounded number at
    a time. None without resamples or blocks.
    """
    nb, m = len(sums), options.resamples
    if not nb or not m:
        return None
    at_once = max(1, 2_000_000 // nb)
    means = []
    with np.errstate(over="ignore"):
        for first in range(0, m, at_once):
            k = min(at_once, m - first)
            shift = np.uint64(options.seed & _MASK) + np.uint64(first * nb & _MASK) * np.uint64(0x9E3779B97F4A7C15)
            draws = (split_mix(int(shift), k * nb) % np.uint64(nb)).astype(np.int64).reshape(k, nb)
            means.append(sums[draws].sum(axis=1) / rows[draws].sum(axis=1))
    ordered = np.sort(np.concatenate(means))
    rank = lambda p: int(np.floor((m - 1) * p + 0.5))
    return float(ordered[rank(0.025)]), float(ordered[rank(0.975)])


def bootstrap(blocks: DataFrame, by: list[str], options: CompareOptions) -> DataFrame:
    """(by, loss, low, high): intervals of the four paired differences, all from the
    same draws. A group holds one row a block of ``options.block`` evaluated rows."""
    import pandas as pd

    from larkspread.workers import ship_package

    ship_package(blocks.sparkSession)
    names = [f"{kind}_vs_{base}" for base in ("naive", "weighted") for kind in ("mae", "mse")]
    kinds = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in by)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        rows = pdf["rows"].to_numpy(float)
        out = []
        for name in names:
            interval = bootstrap_interval(pdf[name].to_numpy(float), rows, options)
            out.append((*key, name, *(interval or (None, None))))
        return pd.DataFrame(out, columns=[*by, "loss", "low", "high"])

    return blocks.groupBy(*by).applyInPandas(one, f"{kinds}, loss string, low double, high double")


def verdict(low: Column, high: Column) -> Column:
    """The decision rule on a difference's interval."""
    return F.when(low.isNull() | high.isNull(), "cannot_apply").when(high < 0, "better").when(low > 0, "worse").otherwise("indistinct")


def auto_block(longest_ahead: float) -> int:
    """Block length that outlasts the dependence of overlapping horizons."""
    return max(1000, 10 * int(np.ceil(longest_ahead)))


def rescaled(report: DataFrame, factor: float) -> DataFrame:
    """A report's lengths times ``factor``, its squares times its square."""
    square = lambda c: "mse" in c
    length = lambda c: any(k in c for k in ("mae", "bias"))
    return report.select(*[(F.col(c) * (factor * factor)).alias(c) if square(c) else (F.col(c) * factor).alias(c) if length(c) else F.col(c) for c in report.columns])


def quote_statistics(quotes: DataFrame, resolution: int = 2, source: str = "symbol_id", block: int = BLOCK) -> DataFrame:
    """Per source: rows, span, upper median spread in ticks, share of one-tick spreads
    and of successive quotes whose mid differs."""
    rows = quotes.select(source, "sequence", "timestamp_ns", F.expr("ask - bid").alias("spread"), F.expr("bid + ask").alias("double_mid"))
    seen = with_previous(rows, {"before": "double_mid"}, source, "sequence", block)
    whole = seen.groupBy(source).agg(
        F.count(F.lit(1)).alias("quotes"), F.expr("max(timestamp_ns) - min(timestamp_ns)").alias("span_ns"), F.count_if(F.col("spread") == resolution).alias("__one"),
        F.count_if(F.col("double_mid") != F.col("before")).alias("__changed"),
    )
    # the spread at position n div 2 of the sorted spreads, from a histogram of them
    histogram = rows.groupBy(source, "spread").agg(F.count(F.lit(1)).alias("__k"))
    up_to = Window.partitionBy(source).orderBy("spread")
    total = Window.partitionBy(source)
    ranked = histogram.withColumn("__seen", F.sum("__k").over(up_to.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.sum("__k").over(total))
    median = ranked.where("__seen > __n div 2").groupBy(source).agg((F.min("spread") / F.lit(float(resolution))).alias("median_spread"))
    return whole.join(median, source).select(
        source, "quotes", "span_ns", "median_spread", (F.col("__one") / F.col("quotes")).alias("one_tick_share"), F.try_divide(F.col("__changed").cast("double"), F.col("quotes") - 1).alias("mid_change_share")
    )


def require_rows(quotes: DataFrame, least: int = 100) -> None:
    """Raise when there are fewer rows than an evaluation needs."""
    if quotes.limit(least).count() < least:
        raise TooFewObservations(f"at least {least} usable quotes are needed")
