"""Queries of the engine's remaining operators, most of them over all symbols.

Every symbol of ``l1_quotes`` is split, calibrated, compared and bootstrapped by
itself in one plan; files in each layout are written and read back; models are
saved, loaded and applied. Real numbers are compared in millionths.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspread.config import CompareOptions, CsvLayout, EvaluationPlan, RowPolicy, Smoothing, SolverSettings, StateSpace, book_ticker_layout, level_file_layout, named_layout, parse_bounds
from larkspread.errors import QuoteError
from larkspread.functions.book import price
from larkspread.model import Model, calibrate
from larkspread.operators import estimate as est
from larkspread.operators import evaluate as ev
from larkspread.operators import transitions as tr
from larkspread.operators.ordering import dense_index
from larkspread.plans import reference as ref
from larkspread.plans.reference import BLOCK_ROWS, HORIZONS, SMOOTHING, SPACE, TRAIN, in_micro, micro
from larkspread.session import materialize, shared_folder
from larkspread.sources.delimited import ingest, read_level_pair
from larkspread.sources.quotes import event_quotes, read_quotes, table_quotes, write_quotes
from larkspread.workers import arrow_schema, map_arrow

QUERIES: dict[str, ref.Query] = {}
ORACLES: dict[str, str] = {}
_query = ref.registry(QUERIES, ORACLES)
_with, _m = ref._with, ref._m
DAY_NS = 86_400_000_000_000


def _place(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/larkspread/{label}-{uuid.uuid4().hex}"


# --- all symbols: training and comparison ---------------------------------------

_KERNELS = """v AS (SELECT symbol_id, from_state AS state, sum(n_flat + n_moved) AS visits, sum(delta_sum) AS ds, sum(up) AS up, sum(down) AS down FROM c GROUP BY 1, 2),
 st AS (SELECT y.symbol_id, CAST(g.state AS INTEGER) AS state, CAST(coalesce(visits, 0) AS BIGINT) AS visits, coalesce(ds, 0) / (coalesce(visits, 0) + 0.5) AS g1,
  (coalesce(up, 0) + 0.5) / (coalesce(up, 0) + coalesce(down, 0) + 1.0) AS p_up FROM (SELECT DISTINCT symbol_id FROM c) y CROSS JOIN range(40) g(state) LEFT JOIN v ON v.state = g.state AND v.symbol_id = y.symbol_id),
 k AS (SELECT a.symbol_id, a.state AS from_state, b.state AS to_state, (coalesce(n_flat, 0) + 0.5) / (a.visits + 0.5 * 41) AS q
  FROM st a JOIN st b ON b.symbol_id = a.symbol_id LEFT JOIN c ON c.symbol_id = a.symbol_id AND c.from_state = a.state AND c.to_state = b.state),
 g(sweep, symbol_id, state, g) AS (SELECT 0, symbol_id, state, g1 FROM st UNION ALL SELECT sweep + 1, symbol_id, state, g1 + s FROM
  (SELECT g.sweep, k.symbol_id, k.from_state AS state, sum(q * g.g) AS s FROM k JOIN g ON g.state = k.to_state AND g.symbol_id = k.symbol_id WHERE g.sweep < 400 GROUP BY 1, 2, 3) JOIN st USING (symbol_id, state)),
 f AS (SELECT symbol_id, state, g AS g_star FROM g WHERE sweep = 400)"""
_ALL = (ref._STRICT, ref._E, ref._X.format("n"), ref._C)


def _symbol_counts(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(ref.transition_counts(spark, folder), "counts")


@_query(_with(*_ALL, _KERNELS, recursive=True) + f"SELECT symbol_id, state, visits, {_m('p_up', 'p_up')}, {_m('g_star', 'g_star')} FROM st JOIN f USING (symbol_id, state)")
def symbol_models(spark: SparkSession, folder: str) -> DataFrame:
    """A model of every symbol, all solved in parallel."""
    solved = est.adjustments(_symbol_counts(spark, folder), SPACE, SMOOTHING)
    return in_micro(solved.select("symbol_id", "state", "visits", "p_up", "g_star"), ["p_up", "g_star"])


@_query(
    _with(*_ALL, _KERNELS.split(",\n k AS")[0])
    + "SELECT symbol_id, CAST(sum(visits) AS BIGINT) AS observations, count(*) FILTER (visits = 0) AS unvisited, min(state) FILTER (visits = 0) AS first_unvisited FROM st GROUP BY 1"
)
def symbol_training(spark: SparkSession, folder: str) -> DataFrame:
    """Observations of every symbol's model, and its states never left."""
    rows = est.state_estimates(_symbol_counts(spark, folder), SPACE, SMOOTHING)
    return rows.groupBy("symbol_id").agg(
        F.sum("visits").alias("observations"), F.count_if(F.col("visits") == 0).alias("unvisited"), F.min(F.when(F.col("visits") == 0, F.col("state"))).alias("first_unvisited")
    )


_SPLIT_ALL = (ref._STRICT, ref._E, ref._SPLIT, "tz AS (SELECT * FROM z WHERE train)", ref._X.format("tz"), ref._C, _KERNELS, ref._TEST)
_AHEAD_ALL = ref._AHEAD.replace("JOIN f ON f.state = h.state JOIN st ON st.state = h.state", "JOIN f ON f.state = h.state AND f.symbol_id = h.symbol_id JOIN st ON st.state = h.state AND st.symbol_id = h.symbol_id")


def _symbol_pairs(spark: SparkSession, folder: str) -> DataFrame:
    whole = materialize(ev.chronological_split(dense_index(materialize(table_quotes(spark, folder), "quotes")), TRAIN), "split")
    counts = materialize(tr.count_transitions(tr.transitions(ev.train_part(whole), SPACE)), "counts")
    return ref.horizon_pairs(est.adjustments(counts, SPACE, SMOOTHING), ev.test_part(whole))


_TICKS = ref._AHEAD.replace(
    "SELECT h.*, f.g_star, st.p_up FROM h", "SELECT h.* REPLACE (exact / 2.0 AS exact, weighted / 2.0 AS weighted, target / 2.0 AS target), f.g_star / 2.0 AS g_star, st.p_up FROM h"
)


@_query(_with(*ref._TRAINED, ref._TEST, _TICKS, recursive=True) + ref._compared_sql("p", "symbol_id, horizon"))
def compare_in_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """The comparison of the derived feed, rescaled from units to ticks."""
    out = ev.rescaled(ev.compare(ref._pairs(spark, folder), ["symbol_id", "horizon"]), 0.5)
    whole = {"symbol_id", "horizon", "n", "n_price_changing", *(f"{n}_{k}" for n in ("weighted", "micro") for k in ("right", "directional"))}
    return in_micro(out, [c for c in out.columns if c not in whole])


_RATIOS = [(f"{n}_{k}", f"{k}_of_{n}") for n in ("weighted", "micro") for k in ("mae", "mse")]
_RELATIVE = ", ".join(_m(f"ln(avg(({p} - target) ** 2) / avg((exact - target) ** 2))" if k == "mse" else f"ln(avg(abs({p} - target)) / avg(abs(exact - target)))", f"{k}_of_{n}") for n, p in (("weighted", "weighted"), ("micro", "mp")) for k in ("mae", "mse"))
_RIGHT = ", ".join(f"count(*) FILTER (target <> exact AND {p} <> exact) AS {n}_directional, count(*) FILTER (target <> exact AND {p} <> exact AND sign({p} - exact) = sign(target - exact)) AS {n}_right" for n, p in (("weighted", "weighted"), ("micro", "mp")))


@_query(_with(*_SPLIT_ALL, _AHEAD_ALL, recursive=True) + f"SELECT symbol_id, horizon, count(*) AS n, count(*) FILTER (target <> exact) AS n_price_changing, {_RIGHT}, {_RELATIVE} FROM (SELECT *, exact + g_star AS mp FROM p) GROUP BY 1, 2")
def symbol_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Losses of every symbol's own model at every horizon, as logarithms of their shares of
    the plain mid's (spikes in the quotes make them large)."""
    out = ev.compare(_symbol_pairs(spark, folder), ["symbol_id", "horizon"])
    shares = [micro(F.ln(F.try_divide(a, f"naive_{a.split('_')[1]}"))).alias(b) for a, b in _RATIOS]
    return out.select("symbol_id", "horizon", "n", "n_price_changing", *[f"{n}_{k}" for n in ("weighted", "micro") for k in ("directional", "right")], *shares)


# fixed values of the published generator splitmix64, modulo 2^64
_DRAWS = f"""bl AS (SELECT symbol_id, horizon, block, count(*) AS n, sum(abs(mp - target) - abs(exact - target)) AS mae_vs_naive, sum((mp - target) ** 2 - (exact - target) ** 2) AS mse_vs_naive,
  sum(abs(mp - target) - abs(weighted - target)) AS mae_vs_weighted, sum((mp - target) ** 2 - (weighted - target) ** 2) AS mse_vs_weighted FROM o GROUP BY 1, 2, 3),
 nb AS (SELECT symbol_id, horizon, count(*) AS nb FROM bl GROUP BY 1, 2),
 d0 AS (SELECT symbol_id, horizon, nb, r, CAST((42::UHUGEINT + (r * nb + j + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS z FROM nb, range(1000) a(r), range(100000) b(j) WHERE j < nb),
 d1 AS (SELECT *, CAST((xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS z1 FROM d0),
 d2 AS (SELECT *, CAST((xor(z1, z1 >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS z2 FROM d1),
 d3 AS (SELECT symbol_id, horizon, r, CAST(xor(z2, z2 >> 31) % nb::UBIGINT AS BIGINT) AS block FROM d2),
 rs AS (SELECT symbol_id, horizon, r, {", ".join(f"sum({c}) / sum(n) AS {c}" for c in ("mae_vs_naive", "mse_vs_naive", "mae_vs_weighted", "mse_vs_weighted"))} FROM d3 JOIN bl USING (symbol_id, horizon, block) GROUP BY 1, 2, 3),
 us AS (UNPIVOT rs ON mae_vs_naive, mse_vs_naive, mae_vs_weighted, mse_vs_weighted INTO NAME loss VALUE x),
 iv AS (SELECT symbol_id, horizon, loss, list_sort(list(x))[26] AS low, list_sort(list(x))[975] AS high FROM us GROUP BY 1, 2, 3)"""

ref.ORACLES["bootstrap_verdicts"] = (
    _with(*ref._TRAINED, ref._TEST, ref._AHEAD, ref._BLOCKS, _DRAWS, recursive=True)
    + f"SELECT symbol_id, horizon, loss, {_m('low', 'low')}, {_m('high', 'high')}, CASE WHEN high < 0 THEN 'better' WHEN low > 0 THEN 'worse' ELSE 'indistinct' END AS verdict FROM iv"
)


@_query(
    _with(*_SPLIT_ALL, _AHEAD_ALL, ref._BLOCKS, _DRAWS, recursive=True)
    + f"SELECT symbol_id, horizon, loss, {_m('low / (abs(low) + abs(high))', 'low')}, {_m('high / (abs(low) + abs(high))', 'high')}, CASE WHEN high < 0 THEN 'better' WHEN low > 0 THEN 'worse' ELSE 'indistinct' END AS verdict FROM iv"
)
def symbol_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """The decision of every symbol at every horizon, by block bootstrap, with the
    interval's bounds as shares of their sizes."""
    blocks = ev.paired_blocks(materialize(_symbol_pairs(spark, folder), "pairs"), ["symbol_id", "horizon"], BLOCK_ROWS)
    out = ev.bootstrap(blocks, ["symbol_id", "horizon"], CompareOptions(block=BLOCK_ROWS))
    size = F.abs("low") + F.abs("high")
    shares = [micro(F.try_divide(c, size)).alias(c) for c in ("low", "high")]
    return out.withColumn("verdict", ev.verdict(F.col("low"), F.col("high"))).select("symbol_id", "horizon", "loss", *shares, "verdict")


# --- order ----------------------------------------------------------------------


@_query(
    """WITH o AS (SELECT symbol_id, sequence, timestamp_ns, row_number() OVER (PARTITION BY symbol_id, sequence ORDER BY timestamp_ns) AS copy FROM l1_quotes),
 t AS (SELECT *, lag(timestamp_ns) OVER (PARTITION BY symbol_id ORDER BY sequence) AS before FROM o WHERE copy = 1)
 SELECT symbol_id, (SELECT count(*) FROM o WHERE o.symbol_id = t.symbol_id AND copy > 1) AS repeated, count(*) FILTER (timestamp_ns < before) AS decreased FROM t GROUP BY 1"""
)
def order_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated sequence numbers and decreasing times of every symbol."""
    raw = spark.read.parquet(f"{folder}/l1_quotes.parquet")
    return tr.order_faults(raw.select("symbol_id", "sequence", "timestamp_ns"))


# --- files in every layout ------------------------------------------------------


@_query(_with(ref._FEED) + "SELECT * FROM (SELECT feed_file AS file, row_number() OVER (PARTITION BY feed_file ORDER BY line_no) - 1 AS sequence, ns AS timestamp_ns, bid, ask FROM par WHERE NOT same) WHERE sequence < 20")
def feed_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """The first 20 accepted quotes of every feed, where the read stops."""
    kept = ref.feed(spark, folder, max_events=20).rows.where("status = 'kept'")
    return kept.select("file", "sequence", "timestamp_ns", "bid", "ask")


@_query(
    _with(ref._STRICT)
    + f"""SELECT row_number() OVER (ORDER BY timestamp_ns % {DAY_NS}, symbol_id, sequence) - 1 AS sequence, timestamp_ns % {DAY_NS} AS timestamp_ns, bid, ask, bid_qty, ask_qty
 FROM q WHERE (bid_qty > 0 OR ask_qty > 0) AND ask * 100 < 9999999999"""
)
def level_pair_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """All quotes as a level file and its message file by time of day, read back."""
    rows = materialize(table_quotes(spark, folder).withColumn("at", F.expr(f"pmod(timestamp_ns, {DAY_NS})")), "quotes").orderBy("at", "symbol_id", "sequence")
    levels, messages = _place(spark, "levels"), _place(spark, "messages")
    rows.select(F.concat_ws(",", F.expr("ask * 100"), "ask_qty", F.expr("bid * 100"), "bid_qty")).coalesce(1).write.text(levels)
    seconds = F.concat(F.expr("at div 1000000000"), F.lit("."), F.lpad(F.expr("at % 1000000000").cast("string"), 9, "0"))
    rows.select(F.concat_ws(",", seconds, F.lit("1"), F.lit("x"))).coalesce(1).write.text(messages)
    read = read_level_pair(spark, levels, messages, level_file_layout(0.01, resolution=1, on_invalid=RowPolicy.SKIP))
    return read.quotes().drop("symbol_id")


@_query(
    _with(ref._STRICT, "w AS (SELECT *, timestamp_ns < max(CASE WHEN bid_qty > 0 OR ask_qty > 0 THEN timestamp_ns END) OVER (PARTITION BY symbol_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM q WHERE bid_qty > 0 OR ask_qty > 0)")
    + "SELECT CAST(symbol_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY symbol_id ORDER BY sequence) - 1 AS sequence, timestamp_ns, bid, ask, bid_qty, ask_qty FROM w WHERE NOT coalesce(late, FALSE)"
)
def named_feed_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Every symbol as a file with a header of its own names, read in the named layout."""
    rows = dense_index(materialize(table_quotes(spark, folder), "quotes"))
    line = F.concat_ws(",", "bid_qty", F.expr("CAST(bid / 2 AS DECIMAL(20, 1))"), F.expr("CAST(ask / 2 AS DECIMAL(20, 1))"), "ask_qty", F.lit("x"), "timestamp_ns")
    lines = rows.select(F.col("symbol_id").cast("string").alias("file"), (F.col("idx") + 2).alias("line_no"), line.alias("raw_line"))
    heads = rows.select(F.col("symbol_id").cast("string").alias("file")).distinct().select("file", F.lit(1).cast("bigint").alias("line_no"), F.lit("BQ,B,A,AQ,note,When").alias("raw_line"))
    layout = named_layout(0.5, resolution=1, time="when", bid_price="b", bid_qty="bq", ask_price="a", ask_qty="aq", time_unit="ns", qty_decimals=0, on_invalid=RowPolicy.SKIP)
    kept = ingest(lines.unionByName(heads), layout).rows.where("status = 'kept'")
    return kept.select("file", "sequence", "timestamp_ns", "bid", "ask", "bid_qty", "ask_qty")


@_query(_with(ref._STRICT) + "SELECT * FROM q")
def parquet_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes written in the Parquet form and read back through its checks."""
    path = _place(spark, "quotes-out")
    write_quotes(table_quotes(spark, folder), path)
    return read_quotes(spark, path)


# --- models ---------------------------------------------------------------------


def _event_model(spark: SparkSession, folder: str) -> Model:
    return calibrate(materialize(event_quotes(spark, folder), "quotes"), SPACE, SMOOTHING, symbol_id=1).model


@_query(ref._SOLVED + f"SELECT symbol_id, state, visits, {_m('p_up', 'p_up')}, {_m('g_star', 'g_star')}, (SELECT CAST(sum(visits) AS BIGINT) FROM st) AS training_observations FROM st JOIN f USING (state)")
def model_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """A calibrated model, saved in the shared folder and loaded again."""
    path = _place(spark, "model")
    _event_model(spark, folder).save(path)
    model = Model.load(path)
    return in_micro(model.table(spark).withColumn("training_observations", F.lit(model.training_observations).cast("bigint")), ["p_up", "g_star"])


@_query(
    ref._SOLVED
    + f"SELECT n.sequence, n.mid, {_m('n.weighted', 'weighted_mid')}, {_m('n.mid + f.g_star', 'micro_price')}, {_m('st.p_up', 'p_up')}, n.state, st.visits AS state_visits FROM n JOIN f ON f.state = n.state JOIN st ON st.state = n.state"
)
def batch_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Every valid book of the derived feed through the model's batch prediction."""
    model = _event_model(spark, folder)
    books = event_quotes(spark, folder).where("ask > bid AND bid_qty + ask_qty > 0").select("sequence", "bid", "ask", "bid_qty", "ask_qty")
    schema = "sequence long, mid long, weighted_mid double, micro_price double, p_up double, state long, state_visits long"
    target = arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = model.predict_batch(*(batch.column(c).to_numpy() for c in range(1, 5)))
            names = ("mid", "weighted_mid", "micro_price", "p_up", "state", "state_visits")
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[n], type=f.type) for n, f in zip(names, list(target)[1:]))], schema=target)

    out = map_arrow(books, run, schema)
    return in_micro(out.withColumn("state", F.col("state").cast("int")), ["weighted_mid", "micro_price", "p_up"])


@_query(ref._SOLVED + f"SELECT CAST(state AS INTEGER) AS state, CAST(state % 10 AS INTEGER) AS imbalance_bucket, CAST(state // 10 AS INTEGER) AS spread_bucket, {_m('state % 10 * 0.1 + 0.05', 'imbalance')}, {_m('g_star', 'g_star')}, {_m('log10(visits + 1.0)', 'log_visits')} FROM st JOIN f USING (state)")
def visits_density(spark: SparkSession, folder: str) -> DataFrame:
    """What the figures of a model show: bucket middles, adjustments, visits."""
    from larkspread.report import figure_data

    return in_micro(figure_data(spark, _event_model(spark, folder)), ["imbalance", "g_star", "log_visits"])


@_query(_with(ref._STRICT) + f"SELECT symbol_id, sequence, {_m('bid * 0.25 / 2', 'bid')}, {_m('ask * 0.25 / 2', 'ask')} FROM q")
def shown_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Bid and ask as prices of a quarter a tick, two units a tick."""
    return table_quotes(spark, folder).select("symbol_id", "sequence", micro(price("bid", 0.25, 2)).alias("bid"), micro(price("ask", 0.25, 2)).alias("ask"))


# --- what must be refused -------------------------------------------------------

_REFUSED = {
    "states: no bucket": lambda s, f: StateSpace(0, (1,)),
    "states: bounds do not increase": lambda s, f: StateSpace(4, (2, 2)),
    "states: bound below one": lambda s, f: StateSpace(4, (0, 2)),
    "bounds: no integers": lambda s, f: parse_bounds("1,x"),
    "smoothing: negative": lambda s, f: Smoothing(-0.1),
    "smoothing: not finite": lambda s, f: Smoothing(float("nan")),
    "layout: tick of zero": lambda s, f: book_ticker_layout(0.0),
    "layout: unknown unit": lambda s, f: named_layout(0.1, time_unit="h"),
    "layout: no resolution": lambda s, f: CsvLayout(0, 1, 2, 3, None, resolution=0),
    "plan: fraction of one": lambda s, f: EvaluationPlan(train_fraction=1.0),
    "plan: no horizon": lambda s, f: EvaluationPlan(horizons=()),
    "plan: primary is no horizon": lambda s, f: EvaluationPlan(primary=7),
    "plan: clock horizon of zero": lambda s, f: EvaluationPlan(wall_clock_ms=(0,)),
    "compare: empty blocks": lambda s, f: CompareOptions(block=0),
    "model: a probability beyond one": lambda s, f: Model(1, StateSpace(1, ()), 0.5, 1, (0.0,), (1.5,), (1,)),
    "model: an adjustment that is no number": lambda s, f: Model(1, StateSpace(1, ()), 0.5, 1, (float("nan"),), (0.5,), (1,)),
    "model: missing folder": lambda s, f: Model.load(_place(s, "nowhere")),
    "model: crossed book": lambda s, f: Model(1, StateSpace(1, ()), 0.5, 1, (0.0,), (0.5,), (1,)).predict(5, 5, 1, 1),
    "model: empty book": lambda s, f: Model(1, StateSpace(1, ()), 0.5, 1, (0.0,), (0.5,), (1,)).predict(4, 5, 0, 0),
    "rows: too few": lambda s, f: ev.require_rows(table_quotes(s, f).limit(99)),
    "order: repeats": lambda s, f: tr.require_order(s.read.parquet(f"{f}/l1_quotes.parquet").select("symbol_id", "sequence", "timestamp_ns")),
    "file: missing": lambda s, f: read_quotes(s, _place(s, "nowhere")),
    "file: missing column": lambda s, f: read_quotes(s, f"{f}/nation.parquet"),
    "estimate: a state never left and no smoothing": lambda s, f: est.dense_arrays(s.createDataFrame([(0, 1, 1, 0, 0, 0, 0)], "from_state int, to_state int, n_flat long, n_moved long, delta_sum long, up long, down long").toPandas(), StateSpace(2, ()), Smoothing(0.0)),
    "solver: too few sweeps": lambda s, f: est.solve(__import__("numpy").full((2, 2), 0.49), __import__("numpy").ones(2), SolverSettings(1e-12, 3)),
    "leak: training past the test": lambda s, f: ev.require_no_leak(s.createDataFrame([(1, True, 9), (1, False, 8)], "symbol_id long, train boolean, timestamp_ns long")),
}


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', TRUE)" for c in _REFUSED) + ") t(what, refused)")
def refusals(spark: SparkSession, folder: str) -> DataFrame:
    """Settings, models, files and feeds that must raise the engine's own error."""
    out = []
    for what, act in _REFUSED.items():
        try:
            act(spark, folder)
            out.append((what, False))
        except QuoteError:
            out.append((what, True))
    return spark.createDataFrame(out, "what string, refused boolean")
