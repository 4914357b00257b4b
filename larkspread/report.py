"""An evaluation run from quotes to a Markdown report, and the data of its figures."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspread.config import CompareOptions, EvaluationPlan, StateSpace
from larkspread.functions.book import exact_mid, state_table, weighted_mid, with_state
from larkspread.model import Calibration, Model, calibrate
from larkspread.operators import estimate, transitions
from larkspread.operators import evaluate as ev
from larkspread.operators.ordering import dense_index
from larkspread.operators.transitions import require_order
from larkspread.session import materialize


@dataclass(frozen=True)
class Evaluation:
    """Results of a run: one row a horizon."""

    plan: EvaluationPlan
    calibration: Calibration
    train_rows: int
    test_rows: int
    statistics: dict
    comparisons: list[dict]
    intervals: list[dict]
    unevaluated: list[dict]
    block: int = 0
    empty_states: int = 0
    truncated_at: int | None = None


def evaluate(quotes: DataFrame, plan: EvaluationPlan = EvaluationPlan(), max_events: int | None = None) -> Evaluation:
    """Splits one source's quotes (the first ``max_events`` of them, if given) in time,
    trains on the first part, compares on the rest."""
    ev.require_rows(quotes)
    require_order(quotes)
    whole = dense_index(quotes)
    if max_events is not None:  # the checks above see all rows, also those beyond
        whole = whole.where(F.col("idx") < max_events)
    whole = materialize(ev.chronological_split(whole, plan.train_fraction), "split")
    ev.require_no_leak(whole)
    space = StateSpace(plan.space.buckets, tuple(b * plan.resolution for b in plan.space.bounds))
    made = calibrate(ev.train_part(whole), space, plan.smoothing, symmetrize=plan.symmetrize)
    test = ev.test_part(whole)
    table = made.model.table(quotes.sparkSession).select("state", "g_star", "p_up")
    targets = ev.event_targets(test, space, plan.horizons)
    choices = F.array(*[F.struct(F.lit(f"{h} events").alias("horizon"), F.col(f"exact_{h}").alias("target"), F.lit(float(h)).alias("ahead")) for h in plan.horizons])
    pairs = targets.select("symbol_id", "idx", "state", "exact", "weighted", F.explode(choices).alias("__h")).select("*", "__h.*").drop("__h")
    pairs = pairs.where("target IS NOT NULL")
    base = with_state(test, space).select("symbol_id", "idx", "state", exact_mid().alias("exact"), weighted_mid().alias("weighted"))
    for ms in plan.wall_clock_ms:
        at = ev.clock_targets(test, ms * 1_000_000).withColumnRenamed("target_exact", "target")
        clock = base.join(at, ["symbol_id", "idx"]).withColumn("horizon", F.lit(f"{ms} ms")).withColumn("ahead", (F.col("target_idx") - F.col("idx")).cast("double"))
        pairs = pairs.unionByName(clock.drop("target_idx"))
    resolved = pairs.where("target IS NOT NULL")
    longest = resolved.agg(F.max("ahead")).first()[0] if not plan.wall_clock_ms else max([*plan.horizons, *(r[0] for r in resolved.groupBy("horizon").agg(F.avg("ahead")).select("avg(ahead)").collect())])
    options = CompareOptions(plan.compare.resamples, max(plan.compare.block, ev.auto_block(longest or 1)), plan.compare.seed)
    used = materialize(resolved.where("state IS NOT NULL").join(table, "state"), "pairs")
    lost = ev.unevaluated(pairs.join(table, "state", "left"), ["horizon"])
    factor = 1.0 / plan.resolution
    compared = [r.asDict() for r in ev.rescaled(ev.compare(used, ["horizon"]), factor).collect()]
    blocks = ev.paired_blocks(used, ["symbol_id", "horizon"], options.block)
    bounds = ev.bootstrap(blocks, ["symbol_id", "horizon"], options)
    scale = F.when(F.col("loss").startswith("mse"), F.lit(factor * factor)).otherwise(F.lit(factor))
    bounds = bounds.withColumn("low", F.col("low") * scale).withColumn("high", F.col("high") * scale).withColumn("verdict", ev.verdict(F.col("low"), F.col("high")))
    sides = whole.agg(F.count_if("train"), F.count_if(~F.col("train"))).first()
    stats = ev.quote_statistics(whole.drop("train", "idx", "part_idx"), plan.resolution).first()
    return Evaluation(
        plan, made, sides[0], sides[1], stats.asDict() if stats else {}, compared, [r.asDict() for r in bounds.collect()], [r.asDict() for r in lost.collect()],
        options.block, sum(not v for v in made.model.visits), max_events,
    )


def evaluate_sources(quotes: DataFrame, plan: EvaluationPlan = EvaluationPlan()) -> DataFrame:
    """(symbol_id, horizon, n, losses of three predictors in ticks, intervals of the paired
    squared and absolute differences, verdicts) of many sources: each is split, trained
    and compared by itself, all in one plan; nothing reaches the driver."""
    whole = materialize(ev.chronological_split(dense_index(materialize(quotes, "quotes")), plan.train_fraction).where("train IS NOT NULL"), "split")
    ev.require_no_leak(whole)
    space = StateSpace(plan.space.buckets, tuple(b * plan.resolution for b in plan.space.bounds))
    counts = transitions.count_transitions(transitions.transitions(ev.train_part(whole), space))
    if plan.symmetrize:
        counts = transitions.symmetrize(counts, space)
    table = estimate.adjustments(materialize(counts, "counts"), space, plan.smoothing).select("symbol_id", "state", "g_star")
    targets = ev.event_targets(ev.test_part(whole), space, plan.horizons)
    choices = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"exact_{h}").alias("target")) for h in plan.horizons])
    pairs = targets.where("state IS NOT NULL").join(table, ["symbol_id", "state"]).select("symbol_id", "idx", "exact", "weighted", "g_star", F.explode(choices).alias("__h"))
    pairs = materialize(pairs.select("symbol_id", "idx", "exact", "weighted", "g_star", "__h.*").where("target IS NOT NULL"), "pairs")
    by, factor = ["symbol_id", "horizon"], 1.0 / plan.resolution
    block = max(plan.compare.block, ev.auto_block(max(plan.horizons)))
    bounds = ev.bootstrap(ev.paired_blocks(pairs, by, block), by, CompareOptions(plan.compare.resamples, block, plan.compare.seed))
    scale = F.when(F.col("loss").startswith("mse"), F.lit(factor * factor)).otherwise(F.lit(factor))
    bounds = bounds.withColumn("low", F.col("low") * scale).withColumn("high", F.col("high") * scale).withColumn("verdict", ev.verdict(F.col("low"), F.col("high")))
    listed = bounds.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("loss", F.struct("low", "high", "verdict")))).alias("differences"))
    return ev.rescaled(ev.compare(pairs, by), factor).join(listed, by)


def _number(x: float | None) -> str:
    return "n/a" if x is None else f"{x:.6f}"


def markdown(e: Evaluation, title: str = "Evaluation", audit: dict | None = None) -> str:
    """The run as a Markdown text. Errors are in ticks."""
    m, p = e.calibration.model, e.plan
    kind = "symmetrized counts" if p.symmetrize else "counts as observed"
    out = [f"# {title}", "", f"Training rows {e.train_rows}, test rows {e.test_rows}; {m.training_observations} transitions; {m.space.size} states, alpha {m.alpha}.", ""]
    out += [f"Model of {kind}; blocks of {e.block} rows, {p.compare.resamples} resamples, seed {p.compare.seed}.", ""]
    if e.truncated_at is not None:
        out += [f"Only the first {e.truncated_at} events were read; what follows says nothing of the rest.", ""]
    if audit:
        out += ["## Rows", "", *[f"- {k}: {v}" for k, v in audit.items()], ""]
    if e.statistics:
        out += ["## Quotes", "", *[f"- {k}: {v}" for k, v in e.statistics.items() if k != "symbol_id"], ""]
    out += ["## Model", "", f"- sweeps: {e.calibration.sweeps}", f"- largest drift: {_number(e.calibration.max_drift)} (state {e.calibration.max_drift_state})"]
    out += [f"- states never left: {e.empty_states} of {m.space.size}"]
    out += [f"- mean drift: {_number(e.calibration.mean_drift)}", f"- antisymmetry residual: {_number(e.calibration.antisymmetry)}", ""]
    out += ["## Rows not evaluated", "", "| horizon | unresolved | skipped |", "| --- | --- | --- |"]
    out += [f"| {r['horizon']} | {r['n_unresolved']} | {r['n_skipped']} |" for r in sorted(e.unevaluated, key=lambda r: r["horizon"])] + [""]
    for r in sorted(e.comparisons, key=lambda r: r["horizon"]):
        ahead = f" The target lies {r['mean_events_ahead']:.2f} events ahead on average." if r.get("mean_events_ahead") is not None else ""
        out += [f"## {r['horizon']}", "", f"{r['n']} rows, {r['n_price_changing']} with another mid, up share {_number(r['up_share'])}.{ahead}", ""]
        out += ["| predictor | MAE | MSE | bias |", "| --- | --- | --- | --- |"]
        out += [f"| {n} | {_number(r[n + '_mae'])} | {_number(r[n + '_mse'])} | {_number(r[n + '_bias'])} |" for n in ("naive", "weighted", "micro")]
        out += ["", "| direction | scored | right | interval |", "| --- | --- | --- | --- |"]
        out += [f"| {n} | {r[n + '_directional']} | {r[n + '_right']} | {_number(r[n + '_low'])} to {_number(r[n + '_high'])} |" for n in ("weighted", "micro")]
        mine = {i["loss"]: i for i in e.intervals if i["horizon"] == r["horizon"]}
        out += ["", "| difference | mean | interval | verdict |", "| --- | --- | --- | --- |"]
        out += [f"| {k} | {_number(r[k])} | {_number(i['low'])} to {_number(i['high'])} | {i['verdict']} |" for k, i in mine.items()]
        out.append("")
    first = next((i for i in e.intervals if i["horizon"] == f"{p.primary} events" and i["loss"] == "mse_vs_naive"), None)
    out += ["## Decision", "", f"At {p.primary} events the micro-price is {first['verdict'] if first else 'cannot_apply'} against the mid by squared error.", ""]
    return "\n".join(out)


def write_report(text: str, path: str) -> None:
    """Writes a report, making its folders."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)


def figure_data(spark: SparkSession, model: Model) -> DataFrame:
    """One row a state: bucket middle, adjustment and log10(visits + 1), as the line
    and heat-map figures show them."""
    states = state_table(spark, model.space)
    return states.join(model.table(spark), "state").select(
        "state", "imbalance_bucket", "spread_bucket", ((F.col("share_from") + F.col("share_to")) / 2).alias("imbalance"), "g_star", F.log10(F.col("visits") + 1.0).alias("log_visits")
    )


def draw(spark: SparkSession, model: Model, folder: str) -> list[str]:
    """The three figures as PNG files; needs matplotlib."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError as e:
        raise RuntimeError("figures need matplotlib; figure_data gives their numbers without it") from e
    data = figure_data(spark, model).toPandas().sort_values("state")
    Path(folder).mkdir(parents=True, exist_ok=True)
    paths = []
    figure, axes = pyplot.subplots()
    for row, part in data.groupby("spread_bucket"):
        axes.plot(part["imbalance"], part["g_star"], label=f"spread bucket {row}")
    axes.legend()
    figures = [("adjustment_lines", figure)]
    for name, column, colours in (("adjustment_map", "g_star", "RdBu"), ("visits_map", "log_visits", "viridis")):
        figure, axes = pyplot.subplots()
        grid = data.pivot(index="spread_bucket", columns="imbalance_bucket", values=column)
        top = abs(grid.to_numpy()).max() or 1.0
        axes.imshow(grid, cmap=colours, **({"vmin": -top, "vmax": top} if column == "g_star" else {}))
        figures.append((name, figure))
    for name, figure in figures:
        paths.append(str(Path(folder) / f"{name}.png"))
        figure.savefig(paths[-1])
    return paths
