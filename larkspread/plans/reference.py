"""Queries of the quote engine's own operators with their SQL twins.

Quotes come from ``l1_quotes`` (cleaned, many symbols) where prices are only
classified and counted, and from the feed derived of ``events`` where models are
solved and losses averaged. Real numbers are compared in millionths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspread.config import BookPolicy, CompareOptions, RowPolicy, Smoothing, SolverSettings, StateSpace, book_ticker_layout
from larkspread.functions.book import exact_mid, imbalance, imbalance_bucket, mid, no_state_reason, spread, spread_bucket, state, state_table, valid, weighted_mid
from larkspread.operators import estimate as est
from larkspread.operators import evaluate as ev
from larkspread.operators import transitions as tr
from larkspread.operators.ordering import dense_index
from larkspread.session import materialize
from larkspread.sources.delimited import ingest
from larkspread.sources.quotes import event_quotes, table_quotes
from larkspread.tables import table

SPACE, SMOOTHING = StateSpace(10, (2, 4, 8)), Smoothing(0.5)
FULL_CHAIN_SMOOTHING = Smoothing(20.0)
TRAIN, HORIZONS, CLOCK_NS, BLOCK_ROWS = 0.7, (1, 10, 100), 3_600_000_000_000, 100

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registry(queries: dict[str, Query], oracles: dict[str, str]) -> Callable:
    """A decorator that registers a query with its SQL twin."""

    def query(sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return add

    return query


_query = registry(QUERIES, ORACLES)


def micro(c: Column | str) -> Column:
    """A real number in millionths."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e6).cast("bigint")


def in_micro(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[micro(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def _m(sql: str, name: str) -> str:
    return f"CAST(round(({sql}) * 1e6) AS BIGINT) AS {name}"


# --- SQL pieces -----------------------------------------------------------------

_L1 = """q AS (SELECT symbol_id, sequence, min(timestamp_ns) AS timestamp_ns, min(bid_price_ticks) AS bid, min(ask_price_ticks) AS ask, min(bid_qty) AS bid_qty, min(ask_qty) AS ask_qty
 FROM l1_quotes WHERE bid_price_ticks > 0 AND ask_price_ticks > 0 AND bid_price_ticks < 9999999999 AND ask_price_ticks < 9999999999 AND bid_qty >= 0 AND ask_qty >= 0 AND {0} GROUP BY 1, 2)"""
_STRICT = _L1.format("ask_price_ticks > bid_price_ticks")
_EVENTS = """q AS (SELECT CAST(1 AS BIGINT) AS symbol_id, event_id AS sequence, epoch_us(ts) * 1000 AS timestamp_ns, 20000 + 2 * s - (1 + event_id % 5) AS bid,
  20000 + 2 * s + CASE WHEN event_id % 101 = 100 THEN -(1 + event_id % 5) ELSE 1 + event_id % 5 END AS ask,
  CASE WHEN event_id % 97 = 0 THEN 0 ELSE user_id END AS bid_qty, CASE WHEN event_id % 97 = 0 THEN 0 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS ask_qty
 FROM (SELECT *, CAST(sum(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (ORDER BY event_id) AS BIGINT) AS s FROM events))"""
_IMB = "CASE WHEN bid_qty + ask_qty > 0 THEN CAST(bid_qty AS DOUBLE) / CAST(bid_qty + ask_qty AS DOUBLE) END"
_E = f"""e AS (SELECT *, (bid + ask) // 2 AS mid, ask - bid AS spread, {_IMB} AS i FROM q),
 s AS (SELECT *, CAST(CASE WHEN spread < 1 THEN NULL WHEN spread <= 2 THEN 0 WHEN spread <= 4 THEN 1 WHEN spread <= 8 THEN 2 ELSE 3 END AS INTEGER) AS spread_bucket,
  CASE WHEN i IS NOT NULL THEN CAST(least(floor(i * 10.0), 9) AS INTEGER) END AS imbalance_bucket FROM e),
 n AS (SELECT *, spread_bucket * 10 + imbalance_bucket AS state, row_number() OVER (PARTITION BY symbol_id ORDER BY sequence) - 1 AS idx, (bid::DOUBLE + ask::DOUBLE) / 2 AS exact,
  ask::DOUBLE * i + bid::DOUBLE * (1.0 - i) AS weighted FROM s)"""
_X = """x AS (SELECT symbol_id, sequence, idx, lag(state) OVER o AS from_state, state AS to_state, mid - lag(mid) OVER o AS delta FROM {0} WINDOW o AS (PARTITION BY symbol_id ORDER BY sequence)),
 t AS (SELECT * FROM x WHERE from_state IS NOT NULL AND to_state IS NOT NULL)"""
_C = """c AS (SELECT symbol_id, from_state, to_state, count(*) FILTER (delta = 0) AS n_flat, count(*) FILTER (delta <> 0) AS n_moved, CAST(sum(delta) AS BIGINT) AS delta_sum,
  count(*) FILTER (delta > 0) AS up, count(*) FILTER (delta < 0) AS down FROM t GROUP BY 1, 2, 3)"""
_MIRROR = """m AS (SELECT symbol_id, from_state, to_state, CAST(sum(n_flat) AS BIGINT) AS n_flat, CAST(sum(n_moved) AS BIGINT) AS n_moved, CAST(sum(delta_sum) AS BIGINT) AS delta_sum,
  CAST(sum(up) AS BIGINT) AS up, CAST(sum(down) AS BIGINT) AS down FROM (SELECT * FROM c UNION ALL
  SELECT symbol_id, CAST(from_state // 10 * 10 + 9 - from_state % 10 AS INTEGER), CAST(to_state // 10 * 10 + 9 - to_state % 10 AS INTEGER), n_flat, n_moved, -delta_sum, down, up FROM c) GROUP BY 1, 2, 3)"""


def _k(counts: str, alpha: float = 0.5) -> str:
    """Totals v, kernel k and estimates st of the counts named."""
    return f"""v AS (SELECT from_state AS state, sum(n_flat + n_moved) AS visits, sum(delta_sum) AS ds, sum(up) AS up, sum(down) AS down FROM {counts} GROUP BY 1),
 st AS (SELECT CAST(1 AS BIGINT) AS symbol_id, CAST(g.state AS INTEGER) AS state, CAST(coalesce(visits, 0) AS BIGINT) AS visits, coalesce(ds, 0) / (coalesce(visits, 0) + {alpha}) AS g1,
  (coalesce(up, 0) + {alpha}) / (coalesce(up, 0) + coalesce(down, 0) + {2 * alpha}) AS p_up FROM range(40) g(state) LEFT JOIN v ON v.state = g.state),
 k AS (SELECT a.state AS from_state, b.state AS to_state, (coalesce(n_flat, 0) + {alpha}) / (a.visits + {alpha} * 41) AS q, coalesce(n_moved, 0) / (a.visits + {alpha} * 41) AS r
  FROM st a CROSS JOIN st b LEFT JOIN {counts} c ON c.from_state = a.state AND c.to_state = b.state)"""


def _g(step: str = "q", sweeps: int = 250) -> str:
    """The fixed point by substitution: sweeps well past convergence."""
    return f"""g(sweep, state, g) AS (SELECT 0, state, g1 FROM st UNION ALL SELECT sweep + 1, state, g1 + s FROM (SELECT g.sweep, k.from_state AS state, sum({step} * g.g) AS s
  FROM k JOIN g ON g.state = k.to_state WHERE g.sweep < {sweeps} GROUP BY g.sweep, k.from_state) JOIN st USING (state)),
 f AS (SELECT state, g AS g_star FROM g WHERE sweep = {sweeps})"""


def _milli(sql: str, name: str) -> str:
    return f"CAST(round(({sql}) * 1e3) AS BIGINT) AS {name}"


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n ".join(parts) + "\n "


# --- books and states -----------------------------------------------------------


@_query(_with(_STRICT) + "SELECT * FROM q")
def quotes_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Valid quotes, each once."""
    return table_quotes(spark, folder)


@_query(
    "SELECT symbol_id, count(*) FILTER (ask_price_ticks > bid_price_ticks) AS strict, count(*) FILTER (ask_price_ticks >= bid_price_ticks) AS allow_locked, count(*) AS allow_all"
    " FROM l1_quotes WHERE bid_price_ticks IS NOT NULL AND ask_price_ticks IS NOT NULL GROUP BY 1"
)
def book_policies(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that each policy lets pass."""
    rows = table(spark, folder, "l1_quotes").where("bid_price_ticks IS NOT NULL AND ask_price_ticks IS NOT NULL")
    rows = rows.select("symbol_id", F.col("bid_price_ticks").alias("bid"), F.col("ask_price_ticks").alias("ask"))
    return rows.groupBy("symbol_id").agg(*[F.count_if(valid(p)).alias(p.name.lower()) for p in BookPolicy])


@_query(_with(_STRICT, _E) + f"SELECT symbol_id, sequence, spread, mid, {_m('exact', 'exact_mid')}, {_m('i', 'imbalance')}, {_m('weighted', 'weighted_mid')} FROM n")
def quote_projections(spark: SparkSession, folder: str) -> DataFrame:
    """Spread, both mids, imbalance and weighted mid."""
    return table_quotes(spark, folder).select(
        "symbol_id", "sequence", spread().alias("spread"), mid().alias("mid"), micro(exact_mid()).alias("exact_mid"), micro(imbalance()).alias("imbalance"), micro(weighted_mid()).alias("weighted_mid")
    )


@_query(
    _with(_L1.format("TRUE"), _E)
    + "SELECT symbol_id, sequence, imbalance_bucket, spread_bucket, state, CASE WHEN spread < 1 THEN 'spread_out_of_range' WHEN bid_qty + ask_qty <= 0 THEN 'empty_book' END AS reason FROM n"
)
def state_encoding(spark: SparkSession, folder: str) -> DataFrame:
    """Buckets and state of every book, or why it has none."""
    rows = table_quotes(spark, folder, BookPolicy.ALLOW_ALL)
    return rows.select("symbol_id", "sequence", imbalance_bucket(SPACE).alias("imbalance_bucket"), spread_bucket(SPACE).alias("spread_bucket"), state(SPACE).alias("state"), no_state_reason().alias("reason"))


@_query(
    f"""SELECT CAST(s AS INTEGER) AS state, CAST(s % 10 AS INTEGER) AS imbalance_bucket, CAST(s // 10 AS INTEGER) AS spread_bucket, {_m('s % 10 * 0.1', 'share_from')}, {_m('(s % 10 + 1) * 0.1', 'share_to')},
 CASE s // 10 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 9 END AS spread_from, CASE s // 10 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 8 END AS spread_to,
 CAST(s // 10 * 10 + 9 - s % 10 AS INTEGER) AS mirror FROM range(40) r(s)"""
)
def state_dimension(spark: SparkSession, folder: str) -> DataFrame:
    """The states with their ranges and mirrors."""
    return in_micro(state_table(spark, SPACE), ["share_from", "share_to"])


# --- transitions ----------------------------------------------------------------


@_query(_with(_STRICT, _E, _X.format("n")) + "SELECT symbol_id, sequence, from_state, to_state, delta FROM t")
def transitions(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of successive quotes with states."""
    return tr.transitions(table_quotes(spark, folder), SPACE)


@_query(_with(_STRICT, _E, _X.format("n"), _C) + "SELECT * FROM c")
def transition_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by pair of states."""
    return tr.count_transitions(transitions(spark, folder))


@_query(
    _with(_STRICT, _E, _X.format("n"), _C)
    + f"""SELECT symbol_id, from_state AS state, CAST(sum(n_flat + n_moved) AS BIGINT) AS visits, CAST(sum(delta_sum) AS BIGINT) AS delta_sum, CAST(sum(up) AS BIGINT) AS up, CAST(sum(down) AS BIGINT) AS down,
 {_m('CASE WHEN sum(up + down) > 0 THEN sum(up)::DOUBLE / sum(up + down) END', 'p_up')} FROM c GROUP BY 1, 2"""
)
def state_visits(spark: SparkSession, folder: str) -> DataFrame:
    """Visits, moves and raw up-probability of each state left."""
    return in_micro(tr.state_totals(transition_counts(spark, folder)), ["p_up"])


@_query(_with(_STRICT, _E, _X.format("n"), _C, _MIRROR) + "SELECT * FROM m")
def symmetrized_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts with their mirror image added."""
    return tr.symmetrize(transition_counts(spark, folder), SPACE)


@_query(_with(_EVENTS, _E, _X.format("n"), _C) + "SELECT * FROM c")
def merged_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of two chunks that share their border quote, merged."""
    rows = event_quotes(spark, folder)
    parts = [rows.where("sequence <= 400"), rows.where("sequence >= 400")]
    return tr.merge_counts(*[tr.count_transitions(tr.transitions(p, SPACE)) for p in parts])


@_query(_with(_EVENTS, _E, _X.format("n"), _C, _k("c")) + f"SELECT CAST(1 AS BIGINT) AS symbol_id, from_state, to_state, {_m('q', 'q')}, {_m('r', 'r')} FROM k")
def transition_kernel(spark: SparkSession, folder: str) -> DataFrame:
    """Smoothed flat and price-changing kernels over all pairs of states."""
    return in_micro(est.kernel(_event_counts(spark, folder), SPACE, SMOOTHING), ["q", "r"])


@_query(_with(_EVENTS, _E, _X.format("n"), _C, _k("c")) + f"SELECT symbol_id, state, visits, {_m('g1', 'g1')}, {_m('p_up', 'p_up')} FROM st")
def state_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """First-order adjustment and smoothed up-probability of every state."""
    return in_micro(est.state_estimates(_event_counts(spark, folder), SPACE, SMOOTHING), ["g1", "p_up"])


def _event_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the derived feed: at most states^2 rows, read several times."""
    return materialize(tr.count_transitions(tr.transitions(event_quotes(spark, folder), SPACE)), "counts")


# --- the fixed point ------------------------------------------------------------

_SOLVED = _with(_EVENTS, _E, _X.format("n"), _C, _k("c"), _g(), recursive=True)
_DRIFT = "d AS (SELECT k.from_state AS state, sum((k.q + k.r) * f.g_star) AS s FROM k JOIN f ON f.state = k.to_state GROUP BY 1), w AS (SELECT st.*, f.g_star, st.g1 + d.s - f.g_star AS drift FROM st JOIN f USING (state) JOIN d USING (state))"


@_query(_SOLVED + f"SELECT symbol_id, state, visits, {_m('g_star', 'g_star')} FROM st JOIN f USING (state)")
def g_star(spark: SparkSession, folder: str) -> DataFrame:
    """Expected mid adjustment of each state."""
    return in_micro(est.adjustments(_event_counts(spark, folder), SPACE, SMOOTHING).select("symbol_id", "state", "visits", "g_star"), ["g_star"])


@_query(_with(_EVENTS, _E, _X.format("n"), _C, _MIRROR, _k("m"), _g(), recursive=True) + f"SELECT symbol_id, state, visits, {_m('g_star', 'g_star')} FROM st JOIN f USING (state)")
def g_star_symmetrized(spark: SparkSession, folder: str) -> DataFrame:
    """The same from symmetrized counts."""
    counts = materialize(tr.symmetrize(_event_counts(spark, folder), SPACE), "counts")
    return in_micro(est.adjustments(counts, SPACE, SMOOTHING).select("symbol_id", "state", "visits", "g_star"), ["g_star"])


@_query(
    _with(_EVENTS, _E, _X.format("n"), _C, _k("c", 20.0), _g("(q + r)", 8000), recursive=True) + f"SELECT symbol_id, state, {_m('g_star', 'g_star')} FROM st JOIN f USING (state)"
)
def g_star_full_chain(spark: SparkSession, folder: str) -> DataFrame:
    """The fixed point over flat and price-changing transitions, strongly smoothed."""
    solved = est.adjustments(_event_counts(spark, folder), SPACE, FULL_CHAIN_SMOOTHING, SolverSettings(1e-13, 200_000), full_chain=True)
    return in_micro(solved.select("symbol_id", "state", "g_star"), ["g_star"])


@_query(
    _with(_EVENTS, _E, _X.format("n"), _C, _k("c"), _g(), _DRIFT, recursive=True)
    + f"SELECT symbol_id, {_m('max(abs(drift))', 'max_drift')}, arg_max(state, (abs(drift), -state)) AS max_drift_state, {_m('sum(visits * abs(drift)) / sum(visits)', 'mean_drift')} FROM w GROUP BY 1"
)
def martingale_drift(spark: SparkSession, folder: str) -> DataFrame:
    """How far mid plus adjustment is from a martingale."""
    return in_micro(est.martingale_summary(est.adjustments(_event_counts(spark, folder), SPACE, SMOOTHING)), ["max_drift", "mean_drift"])


@_query(_SOLVED + f"SELECT CAST(1 AS BIGINT) AS symbol_id, {_m('max(abs(a.g_star + b.g_star))', 'residual')} FROM f a JOIN f b ON b.state = a.state // 10 * 10 + 9 - a.state % 10")
def antisymmetry_residual(spark: SparkSession, folder: str) -> DataFrame:
    """Largest sum of a state's and its mirror's adjustment."""
    return in_micro(est.antisymmetry(materialize(est.adjustments(_event_counts(spark, folder), SPACE, SMOOTHING), "solved"), SPACE), ["residual"])


@_query(
    _SOLVED
    + f"""SELECT symbol_id, {_m('min(g_star)', 'g_min')}, {_m('max(g_star)', 'g_max')}, {_m('avg(g_star)', 'g_mean')}, min(visits) AS visits_min, max(visits) AS visits_max,
 count(*) FILTER (visits = 0) AS unvisited, count(p_up) AS p_up_states, {_m('min(p_up)', 'p_up_min')}, {_m('max(p_up)', 'p_up_max')}, {_m('avg(p_up)', 'p_up_mean')},
 count(*) FILTER (p_up > 0.5) AS p_up_above_half FROM st JOIN f USING (state) GROUP BY 1"""
)
def model_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges of a model's values."""
    return in_micro(est.model_summary(est.adjustments(_event_counts(spark, folder), SPACE, SMOOTHING)), ["g_min", "g_max", "g_mean", "p_up_min", "p_up_max", "p_up_mean"])


@_query(
    _SOLVED
    + f"""SELECT n.symbol_id, n.sequence, n.state, n.mid, {_m('n.weighted', 'weighted_mid')}, {_m('n.mid + f.g_star', 'micro_price')}, {_m('st.p_up', 'p_up')}, st.visits AS state_visits, st.visits < 30 AS low_evidence
 FROM n LEFT JOIN f ON f.state = n.state LEFT JOIN st ON st.state = n.state"""
)
def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Adjusted fair price of every book."""
    rows = materialize(event_quotes(spark, folder), "quotes")
    solved = est.adjustments(tr.count_transitions(tr.transitions(rows, SPACE)), SPACE, SMOOTHING)
    out = ev.predict(rows, solved, SPACE)
    out = out.withColumn("weighted_mid", F.coalesce("weighted_mid", weighted_mid()))
    return in_micro(out.select("symbol_id", "sequence", "state", "mid", "weighted_mid", "micro_price", "p_up", "state_visits", "low_evidence"), ["weighted_mid", "micro_price", "p_up"])


# --- evaluation -----------------------------------------------------------------

_SPLIT = "z AS (SELECT *, idx < floor(count(*) OVER (PARTITION BY symbol_id) * 0.7::DOUBLE + 0.5) AS train FROM n)"
_TRAINED = (_EVENTS, _E, _SPLIT, "tz AS (SELECT * FROM z WHERE train)", _X.format("tz"), _C, _k("c"), _g())
_TEST = """b AS (SELECT symbol_id, sequence, timestamp_ns, state, mid, exact, weighted, row_number() OVER (PARTITION BY symbol_id ORDER BY sequence) - 1 AS idx FROM z WHERE NOT train)"""
_AHEAD = """h AS (SELECT *, 1 AS horizon, lead(mid, 1) OVER o AS target_mid, lead(exact, 1) OVER o AS target FROM b WINDOW o AS (PARTITION BY symbol_id ORDER BY idx) UNION ALL
 SELECT *, 10, lead(mid, 10) OVER o, lead(exact, 10) OVER o FROM b WINDOW o AS (PARTITION BY symbol_id ORDER BY idx) UNION ALL
 SELECT *, 100, lead(mid, 100) OVER o, lead(exact, 100) OVER o FROM b WINDOW o AS (PARTITION BY symbol_id ORDER BY idx)),
 p AS (SELECT h.*, f.g_star, st.p_up FROM h JOIN f ON f.state = h.state JOIN st ON st.state = h.state WHERE target IS NOT NULL)"""


def _split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(solved model of the training part, test rows with a dense ``idx``)."""
    whole = materialize(ev.chronological_split(dense_index(materialize(event_quotes(spark, folder), "quotes")), TRAIN), "split")
    counts = materialize(tr.count_transitions(tr.transitions(ev.train_part(whole), SPACE)), "counts")
    return est.adjustments(counts, SPACE, SMOOTHING), ev.test_part(whole)


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return horizon_pairs(*_split(spark, folder))


def horizon_pairs(solved: DataFrame, test: DataFrame) -> DataFrame:
    """Evaluated pairs of all event horizons, in one pass over the test rows."""
    rows = ev.event_targets(test, SPACE, HORIZONS)
    rows = rows.select("symbol_id", "idx", "state", "mid", "exact", "weighted", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"mid_{h}").alias("target_mid"), F.col(f"exact_{h}").alias("target")) for h in HORIZONS])).alias("__h"))
    rows = rows.select("*", "__h.*").drop("__h").where("state IS NOT NULL AND target IS NOT NULL")
    return rows.join(solved.select("symbol_id", "state", "g_star", "p_up"), ["symbol_id", "state"])


@_query(_with(_STRICT, _E, _SPLIT) + "SELECT symbol_id, count(*) FILTER (train) AS train_rows, count(*) FILTER (NOT train) AS test_rows, max(timestamp_ns) FILTER (train) <= min(timestamp_ns) FILTER (NOT train) AS no_leak FROM z GROUP BY 1")
def split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of either side of the split and whether it is free of leakage."""
    whole = ev.chronological_split(dense_index(materialize(table_quotes(spark, folder), "quotes")), TRAIN)
    last, first = F.max(F.when(F.col("train"), F.col("timestamp_ns"))), F.min(F.when(~F.col("train"), F.col("timestamp_ns")))
    return whole.groupBy("symbol_id").agg(F.count_if("train").alias("train_rows"), F.count_if(~F.col("train")).alias("test_rows"), (last <= first).alias("no_leak"))


_LOSS = lambda p, a, n: f"{_m(f'avg(abs({p} - {a}))', n + '_mae')}, {_m(f'avg(({p} - {a}) * ({p} - {a}))', n + '_mse')}, {_m(f'avg({p} - {a})', n + '_bias')}"
_SCORED = """u AS (SELECT *, CAST(target_mid - mid AS DOUBLE) AS moved, CASE WHEN target_mid <> mid AND p_up IS NOT NULL THEN CAST(target_mid > mid AS INTEGER)::DOUBLE END AS up FROM p)"""


@_query(
    _with(*_TRAINED, _TEST, _AHEAD, _SCORED, recursive=True)
    + f"""SELECT symbol_id, horizon, n, {", ".join(f"{p}_{k}" for p in ("naive", "weighted", "micro") for k in ("mae", "mse", "bias"))}, direction_accuracy, n_directional, {_m('b', 'brier')},
 {_m('r * (1 - r)', 'brier_baseline')}, {_m('CASE WHEN r * (1 - r) <> 0 THEN 1 - b / (r * (1 - r)) END', 'brier_skill')} FROM
 (SELECT symbol_id, horizon, count(*) AS n, {_LOSS('0.0', 'moved', 'naive')}, {_LOSS('(weighted - mid)', 'moved', 'weighted')}, {_LOSS('g_star', 'moved', 'micro')},
  {_m('avg(CASE WHEN moved <> 0 THEN CASE WHEN (g_star >= 0) = (moved > 0) THEN 1.0 ELSE 0.0 END END)', 'direction_accuracy')}, count(*) FILTER (moved <> 0) AS n_directional,
  avg((p_up - up) * (p_up - up)) AS b, avg(up) AS r FROM u GROUP BY 1, 2)"""
)
def score_by_horizon(spark: SparkSession, folder: str) -> DataFrame:
    """Losses, direction and probability scores with truncated mids."""
    out = ev.score(_pairs(spark, folder), ["symbol_id", "horizon"])
    return in_micro(out, [c for c in out.columns if c not in ("symbol_id", "horizon", "n", "n_directional")])


def _wilson_sql(k: str, n: str, sign: str) -> str:
    p = f"({k}::DOUBLE / {n})"
    return f"CASE WHEN {n} > 0 THEN (({p} + 3.8416 / (2.0 * {n})) {sign} 1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4.0 * {n} * {n}))) / (1 + 3.8416 / {n}) END"


def _compared_sql(rows: str, keys: str, ahead: bool = False) -> str:
    sure = lambda p: f"target <> exact AND {p} <> exact"
    right = lambda p: f"{sure(p)} AND sign({p} - exact) = sign(target - exact)"
    losses = ", ".join(_LOSS(p, "target", n) for p, n in (("exact", "naive"), ("weighted", "weighted"), ("mp", "micro")))
    pairs = ", ".join(
        f"{_m(f'avg(abs(mp - target) - abs({p} - target))', f'mae_vs_{n}')}, {_m(f'avg((mp - target) * (mp - target) - ({p} - target) * ({p} - target))', f'mse_vs_{n}')}" for p, n in (("exact", "naive"), ("weighted", "weighted"))
    )
    inner = f"""SELECT {keys}, count(*) AS n, {losses}, {pairs}, count(*) FILTER ({sure('weighted')}) AS weighted_directional, count(*) FILTER ({right('weighted')}) AS weighted_right,
 count(*) FILTER ({sure('mp')}) AS micro_directional, count(*) FILTER ({right('mp')}) AS micro_right, count(*) FILTER (target <> exact) AS n_price_changing,
 {_m('count(*) FILTER (target > exact)::DOUBLE / nullif(count(*) FILTER (target <> exact), 0)', 'up_share')}{', ' + _m('avg(ahead)', 'mean_events_ahead') if ahead else ''} FROM (SELECT *, exact + g_star AS mp FROM {rows}) GROUP BY {keys}"""
    bounds = ", ".join(_m(_wilson_sql(f"{n}_right", f"{n}_directional", s), f"{n}_{b}") for n in ("weighted", "micro") for s, b in (("-", "low"), ("+", "high")))
    return f"SELECT *, {bounds} FROM ({inner})"


def _compared(pairs: DataFrame, by: list[str]) -> DataFrame:
    out = ev.compare(pairs, by)
    whole = {*by, "n", "n_price_changing", *(f"{n}_{k}" for n in ("weighted", "micro") for k in ("right", "directional"))}
    return in_micro(out, [c for c in out.columns if c not in whole])


@_query(_with(*_TRAINED, _TEST, _AHEAD, recursive=True) + _compared_sql("p", "symbol_id, horizon"))
def compare_by_horizon(spark: SparkSession, folder: str) -> DataFrame:
    """Paired losses of micro-price, plain and weighted mid with exact mids."""
    return _compared(_pairs(spark, folder), ["symbol_id", "horizon"])


_BLOCKS = f"""o AS (SELECT *, exact + g_star AS mp, (row_number() OVER (PARTITION BY symbol_id, horizon ORDER BY idx) - 1) // {BLOCK_ROWS} AS block FROM p)"""


@_query(
    _with(*_TRAINED, _TEST, _AHEAD, _BLOCKS, recursive=True)
    + f"""SELECT symbol_id, horizon, block, count(*) AS "rows", {", ".join(_milli(f"sum(abs(mp - target) - abs({p} - target))", f"mae_vs_{n}") + ", " + _milli(f"sum((mp - target) * (mp - target) - ({p} - target) * ({p} - target))", f"mse_vs_{n}") for p, n in (("exact", "naive"), ("weighted", "weighted")))}
 FROM o GROUP BY 1, 2, 3"""
)
def paired_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of paired differences over consecutive evaluated rows."""
    out = ev.paired_blocks(materialize(_pairs(spark, folder), "pairs"), ["symbol_id", "horizon"], BLOCK_ROWS)
    return out.select(*[F.round(F.col(c) * 1e3).cast("bigint").alias(c) if "_vs_" in c else F.col(c) for c in out.columns])


@_query()
def bootstrap_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Block-bootstrap intervals of the paired differences and the decision."""
    blocks = ev.paired_blocks(materialize(_pairs(spark, folder), "pairs"), ["symbol_id", "horizon"], BLOCK_ROWS)
    out = ev.bootstrap(blocks, ["symbol_id", "horizon"], CompareOptions(block=BLOCK_ROWS))
    return in_micro(out.withColumn("verdict", ev.verdict(F.col("low"), F.col("high"))), ["low", "high"])


_CLOCK = f"""a AS (SELECT *, timestamp_ns + {CLOCK_NS} AS at, max(timestamp_ns) OVER (PARTITION BY symbol_id) AS ends FROM b),
 l AS (SELECT symbol_id, timestamp_ns, max(idx) AS idx, arg_max(exact, idx) AS exact FROM b GROUP BY 1, 2),
 y AS (SELECT a.symbol_id, a.idx, a.state, a.exact, a.weighted, CASE WHEN a.at <= a.ends THEN l.idx END AS target_idx, CASE WHEN a.at <= a.ends THEN l.exact END AS target
  FROM a ASOF JOIN l ON l.symbol_id = a.symbol_id AND l.timestamp_ns <= a.at)"""


@_query(_with(_EVENTS, _E, _SPLIT, _TEST, _CLOCK) + f"SELECT symbol_id, idx, target_idx, {_m('target', 'target_exact')} FROM y")
def wall_clock_targets(spark: SparkSession, folder: str) -> DataFrame:
    """The quote in force an hour after each test quote."""
    whole = ev.chronological_split(dense_index(materialize(event_quotes(spark, folder), "quotes")), TRAIN)
    test = materialize(ev.test_part(whole), "test")
    return in_micro(ev.clock_targets(test, CLOCK_NS), ["target_exact"])


@_query(
    _with(*_TRAINED, _TEST, _CLOCK, "p AS (SELECT y.*, f.g_star, y.target_idx - y.idx AS ahead FROM y JOIN f ON f.state = y.state WHERE target IS NOT NULL)", recursive=True)
    + _compared_sql("p", "symbol_id", ahead=True)
)
def compare_wall_clock(spark: SparkSession, folder: str) -> DataFrame:
    """The paired comparison an hour ahead."""
    from larkspread.functions.book import with_state

    solved, test = _split(spark, folder)
    rows = with_state(test, SPACE).select("symbol_id", "idx", "state", exact_mid().alias("exact"), weighted_mid().alias("weighted"))
    targets = ev.clock_targets(test, CLOCK_NS).where("target_idx IS NOT NULL")
    pairs = rows.join(targets, ["symbol_id", "idx"]).join(solved.select("symbol_id", "state", "g_star"), ["symbol_id", "state"])
    return _compared(pairs.select("symbol_id", "idx", "exact", "weighted", "g_star", F.col("target_exact").alias("target"), (F.col("target_idx") - F.col("idx")).alias("ahead")), ["symbol_id"])


@_query(
    _with(_STRICT, _E, "w AS (SELECT *, bid + ask <> lag(bid + ask) OVER (PARTITION BY symbol_id ORDER BY sequence) AS changed FROM n)")
    + f"""SELECT symbol_id, count(*) AS quotes, max(timestamp_ns) - min(timestamp_ns) AS span_ns, {_m('list_sort(list(spread))[len(list(spread)) // 2 + 1] / 2.0', 'median_spread')},
 {_m('count(*) FILTER (spread = 2)::DOUBLE / count(*)', 'one_tick_share')}, {_m('count(*) FILTER (changed)::DOUBLE / nullif(count(*) - 1, 0)', 'mid_change_share')} FROM w GROUP BY 1"""
)
def quote_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptive figures of each symbol's quotes."""
    out = ev.quote_statistics(materialize(table_quotes(spark, folder), "quotes"))
    return in_micro(out, ["median_spread", "one_tick_share", "mid_change_share"])


# --- delimited feeds ------------------------------------------------------------

_REAL = "CASE WHEN regexp_full_match({0}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') AND isfinite(TRY_CAST({0} AS DOUBLE)) THEN TRY_CAST({0} AS DOUBLE) END"
_TICKS = "({0} / 1.0 / tick_size)"
_FEED = f"""raw AS (SELECT feed_file, line_no, regexp_replace(raw_line, '[\\r\\n]+$', '') AS line FROM ticker_lines),
 cells AS (SELECT feed_file, line_no, list_transform(string_split(line, ','), lambda x: regexp_replace(trim(x), '^"+|"+$', '', 'g')) AS f FROM raw WHERE trim(line, ' ') <> ''),
 head AS (SELECT feed_file, min(line_no) AS first, list_transform(arg_min(f, line_no), lambda x: lower(x)) AS names FROM cells GROUP BY 1),
 txt AS (SELECT feed_file, line_no, tick_size, qty_decimals, {", ".join(f"f[list_position(names, '{c}')] AS {n}" for n, c in (("tt", "event_time"), ("tb", "best_bid_price"), ("ta", "best_ask_price"), ("tbq", "best_bid_qty"), ("taq", "best_ask_qty")))}
  FROM cells JOIN head USING (feed_file) JOIN instruments ON symbol = split_part(feed_file, '-', 2) WHERE line_no > first),
 num AS (SELECT feed_file, line_no, tick_size, qty_decimals, CASE WHEN regexp_full_match(tt, '[+]?[0-9]+') THEN CASE WHEN TRY_CAST(tt AS HUGEINT) * 1000000 < 9223372036854775808 THEN CAST(TRY_CAST(tt AS HUGEINT) * 1000000 AS BIGINT) END
   ELSE CASE WHEN round({_REAL.format('tt')} * 1e6) BETWEEN 0 AND 9.2e18 THEN CAST(round({_REAL.format('tt')} * 1e6) AS BIGINT) END END AS ns,
  {_REAL.format('tb')} AS b, {_REAL.format('ta')} AS a, {_REAL.format('tbq')} AS bq, {_REAL.format('taq')} AS aq FROM txt),
 unit AS (SELECT *, {_TICKS.format('b')} AS bt, {_TICKS.format('a')} AS akt, round(bq * pow(10.0, qty_decimals)) AS bs, round(aq * pow(10.0, qty_decimals)) AS sz FROM num),
 why AS (SELECT *, CASE WHEN ns IS NULL OR b IS NULL OR a IS NULL OR bq IS NULL OR aq IS NULL THEN 'unparsable' WHEN b <= 0 OR a <= 0 OR abs(b) >= 9999999999 OR abs(a) >= 9999999999 THEN 'empty_level'
   WHEN bq < 0 OR aq < 0 THEN 'unparsable' WHEN abs(bt - round(bt)) > 1e-4 OR abs(akt - round(akt)) > 1e-4 OR abs(bt) > 1e15 OR abs(akt) > 1e15 THEN 'off_grid' WHEN bs >= 9.2e18 OR sz >= 9.2e18 THEN 'unparsable'
   WHEN bs = 0 AND sz = 0 THEN 'empty_book' WHEN round(akt) <= round(bt) THEN 'crossed_or_locked' END AS reason FROM unit),
 tim AS (SELECT *, coalesce(reason, CASE WHEN ns < max(CASE WHEN reason IS NULL THEN ns END) OVER (PARTITION BY feed_file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'time_decreased' END) AS fate FROM why),
 ok AS (SELECT feed_file, line_no, ns, CAST(round(bt) * 2 AS BIGINT) AS bid, CAST(round(akt) * 2 AS BIGINT) AS ask, CAST(bs AS BIGINT) AS bid_qty, CAST(sz AS BIGINT) AS ask_qty FROM tim WHERE fate IS NULL),
 par AS (SELECT *, coalesce(bid = lag(bid) OVER o AND ask = lag(ask) OVER o AND bid_qty = lag(bid_qty) OVER o AND ask_qty = lag(ask_qty) OVER o, FALSE) AS same FROM ok WINDOW o AS (PARTITION BY feed_file ORDER BY line_no))"""


def feed(spark: SparkSession, folder: str, **more):
    """The delimited feeds of all files; ``more`` settings of their layout."""
    lines = table(spark, folder, "ticker_lines").select(F.col("feed_file").alias("file"), F.col("line_no").cast("bigint").alias("line_no"), "raw_line")
    known = table(spark, folder, "instruments").select(F.col("symbol").alias("__symbol"), "symbol_id", "tick_size", "qty_decimals")
    lines = lines.join(known, F.element_at(F.split("file", "-"), 2) == F.col("__symbol")).drop("__symbol")
    layout = book_ticker_layout(0.01, on_invalid=RowPolicy.SKIP, drop_unchanged=True, **more)
    return ingest(lines, layout, tick=F.col("tick_size"), decimals=F.col("qty_decimals"))


@_query(
    _with(_FEED)
    + """SELECT feed_file AS file, count(*) AS rows_read, count(*) FILTER (fate IS NULL AND NOT same) AS kept, count(*) FILTER (fate IS NULL AND same) AS unchanged, count(*) FILTER (fate = 'unparsable') AS unparsable,
 count(*) FILTER (fate = 'empty_level') AS empty_level, count(*) FILTER (fate = 'off_grid') AS off_grid, count(*) FILTER (fate = 'empty_book') AS empty_book,
 count(*) FILTER (fate = 'crossed_or_locked') AS crossed_or_locked, count(*) FILTER (fate = 'time_decreased') AS time_decreased FROM tim LEFT JOIN par USING (feed_file, line_no) GROUP BY 1"""
)
def feed_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every delimited feed by what became of them."""
    return feed(spark, folder).audit().drop("stopped")


@_query(_with(_FEED) + "SELECT feed_file AS file, row_number() OVER (PARTITION BY feed_file ORDER BY line_no) - 1 AS sequence, ns AS timestamp_ns, bid, ask, bid_qty, ask_qty FROM par WHERE NOT same")
def feed_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes of the delimited feeds in integer units."""
    return feed(spark, folder).rows.where("status = 'kept'").select("file", "sequence", "timestamp_ns", "bid", "ask", "bid_qty", "ask_qty")


# --- feeds that are made or streamed ----------------------------------------------


@_query("SELECT CAST(s AS BIGINT) AS symbol_id, CAST(20000 AS BIGINT) AS quotes, CAST(0 AS BIGINT) AS broken FROM range(4) r(s)")
def synthetic_feeds(spark: SparkSession, folder: str) -> DataFrame:
    """Four synthetic feeds held against what they promise: an unbroken sequence, even
    steps of time, a constant spread, never both sides empty."""
    from larkspread.sources.synthetic import synthetic_quotes

    rows = synthetic_quotes(spark, 20_000, 42, 4)
    broken = F.expr("ask - bid <> 2 OR bid_qty < 0 OR ask_qty < 0 OR bid_qty + ask_qty = 0 OR timestamp_ns <> sequence * 100000")
    return rows.groupBy("symbol_id").agg(F.count_distinct("sequence").alias("quotes"), F.count_if(broken).alias("broken"))


@_query(_with(_EVENTS, _E, _X.format("n"), _C) + "SELECT * FROM c")
def streamed_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the derived feed, streamed in three micro-batches of files."""
    import uuid

    from larkspread.session import shared_folder
    from larkspread.sources.quotes import write_quotes
    from larkspread.streaming.counts import count_stream, stored_counts, stream_quotes

    place = f"{shared_folder(spark)}/larkspread/stream-{uuid.uuid4().hex}"
    rows = event_quotes(spark, folder)
    last = rows.agg(F.max("sequence")).first()[0] or 0
    for k in range(3):
        part = rows.where((F.col("sequence") > last * k // 3 - (k == 0)) & (F.col("sequence") <= last * (k + 1) // 3))
        write_quotes(part.repartition(1), f"{place}/landing/{k}")
    count_stream(stream_quotes(spark, f"{place}/landing/*"), SPACE, f"{place}/store", f"{place}/state").awaitTermination()
    return stored_counts(spark, f"{place}/store")
