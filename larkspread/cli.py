"""Command line: train, predict, inspect, benchmark, evaluate, evaluate-csv, evaluate-parquet, visualize."""

from __future__ import annotations

import argparse
import json
import sys
import time
from dataclasses import asdict, replace

from larkspread.config import CompareOptions, CsvLayout, EvaluationPlan, RowPolicy, Smoothing, StateSpace, book_ticker_layout, level_file_layout, named_layout, parse_bounds
from larkspread.errors import QuoteError
from larkspread.model import Model, calibrate
from larkspread.report import evaluate, figure_data, markdown, write_report
from larkspread.session import local_session
from larkspread.sources.delimited import read_delimited, read_level_pair
from larkspread.sources.quotes import read_quotes
from larkspread.sources.synthetic import SyntheticFeed, synthetic_quotes


def _space(p: argparse.ArgumentParser) -> None:
    p.add_argument("--buckets", type=int, default=10)
    p.add_argument("--bounds", default="1,2,4")
    p.add_argument("--alpha", type=float, default=0.5)
    p.add_argument("--symmetrize", action="store_true")
    p.add_argument("--seed", type=int, default=42)


def _evaluation(p: argparse.ArgumentParser) -> None:
    _space(p)
    p.add_argument("--resolution", type=int, default=2)
    p.add_argument("--train-fraction", type=float, default=0.7)
    p.add_argument("--horizons", default="1,10,100")
    p.add_argument("--primary", type=int, default=10)
    p.add_argument("--wall-clock-ms", default="")
    p.add_argument("--resamples", type=int, default=1000)
    p.add_argument("--block", type=int, default=1)
    p.add_argument("--report-md")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="larkspread")
    sub = p.add_subparsers(dest="command", required=True)
    train = sub.add_parser("train", help="train on a synthetic feed and save the model")
    _space(train)
    train.add_argument("--events", type=int, default=100_000)
    train.add_argument("--output", required=True)
    one = sub.add_parser("predict", help="apply a model to one book")
    one.add_argument("--model", required=True)
    for side in ("bid", "ask", "bid-qty", "ask-qty"):
        one.add_argument(f"--{side}", type=int, required=True)
    for name in ("inspect", "visualize"):
        q = sub.add_parser(name)
        q.add_argument("--model", required=True)
        if name == "visualize":
            q.add_argument("--output")
    bench = sub.add_parser("benchmark", help="time single and batch predictions")
    bench.add_argument("--model", required=True)
    bench.add_argument("--books", type=int, default=100_000)
    synthetic = sub.add_parser("evaluate", help="evaluate on a synthetic feed")
    _evaluation(synthetic)
    synthetic.add_argument("--events", type=int, default=100_000)
    csv = sub.add_parser("evaluate-csv", help="evaluate on a delimited file")
    _evaluation(csv)
    csv.add_argument("--input", required=True)
    csv.add_argument("--messages")
    csv.add_argument("--format", choices=["book-ticker", "levels", "named"], default="book-ticker")
    csv.add_argument("--tick-size", type=float, required=True)
    csv.add_argument("--skip-invalid-rows", action="store_true")
    csv.add_argument("--drop-unchanged", action="store_true")
    csv.add_argument("--max-events", type=int)
    for c in ("time", "bid-price", "bid-qty", "ask-price", "ask-qty", "time-unit"):
        csv.add_argument(f"--{c}")
    parquet = sub.add_parser("evaluate-parquet", help="evaluate on a Parquet file")
    _evaluation(parquet)
    parquet.add_argument("--input", required=True)
    parquet.add_argument("--max-events", type=int)
    parquet.add_argument("--tick-size", type=float, help="shown in the title only")
    return p


def _plan(a: argparse.Namespace) -> EvaluationPlan:
    numbers = lambda t: tuple(int(x) for x in t.split(",") if x.strip())
    return EvaluationPlan(
        StateSpace(a.buckets, parse_bounds(a.bounds)), Smoothing(a.alpha), a.train_fraction, numbers(a.horizons), a.primary, numbers(a.wall_clock_ms), a.symmetrize, a.resolution,
        CompareOptions(a.resamples, a.block, a.seed),
    )


def _layout(a: argparse.Namespace) -> CsvLayout:
    more = {"on_invalid": RowPolicy.SKIP if a.skip_invalid_rows else RowPolicy.ERROR, "drop_unchanged": a.drop_unchanged, "max_events": a.max_events, "resolution": a.resolution}
    if a.format == "levels":
        return level_file_layout(a.tick_size, **more)
    if a.format == "book-ticker":
        return book_ticker_layout(a.tick_size, **more)
    named = {k: getattr(a, k) for k in ("time", "bid_price", "bid_qty", "ask_price", "ask_qty", "time_unit") if getattr(a, k)}
    return named_layout(a.tick_size, **named, **more)


def _finish(result, a: argparse.Namespace, title: str, audit: dict | None = None) -> None:
    text = markdown(result, title, audit)
    print(text)
    if a.report_md:
        write_report(text, a.report_md)


#: Visits of a state below which its figures are little more than smoothing.
LOW_EVIDENCE = 30


def summary(m: Model) -> dict:
    """What ``inspect`` shows of a model."""
    unvisited = [s for s, v in enumerate(m.visits) if not v]
    ups = [p for p in m.p_up if p is not None]
    anti = max(abs(m.g_star[s] + m.g_star[m.space.mirror(s)]) for s in range(m.space.size))
    return {
        "symbol_id": m.symbol_id, "states": m.space.size, "buckets": m.space.buckets, "bounds": list(m.space.bounds), "alpha": m.alpha, "training_observations": m.training_observations,
        "g_min": min(m.g_star), "g_max": max(m.g_star), "g_mean": sum(m.g_star) / m.space.size, "visits_min": min(m.visits), "visits_max": max(m.visits),
        "p_up_states": len(ups), "p_up_min": min(ups, default=None), "p_up_max": max(ups, default=None), "p_up_mean": sum(ups) / len(ups) if ups else None,
        "p_up_above_half": sum(p > 0.5 for p in ups), "antisymmetry": anti, "unvisited": len(unvisited), "first_unvisited": unvisited[:10],
        "low_evidence": sum(v < LOW_EVIDENCE for v in m.visits),
    }


def run(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command == "predict":
            found = Model.load(a.model).predict(a.bid, a.ask, a.bid_qty, a.ask_qty)
            print(json.dumps(asdict(found), indent=1))
            if found.state_visits < LOW_EVIDENCE:
                print(f"warning: state {found.state} was left only {found.state_visits} times in training", file=sys.stderr)
            return 0
        if a.command == "inspect":
            print(json.dumps(summary(Model.load(a.model)), indent=1))
            return 0
        if a.command == "benchmark":
            m = Model.load(a.model)
            books = [(10_000, 10_000 + 2 * (1 + i % 4), 1 + i % 97, 1 + i % 89) for i in range(a.books)]
            began = time.perf_counter()
            for b in books:
                m.predict(*b)
            single = time.perf_counter() - began
            began = time.perf_counter()
            m.predict_batch(*zip(*books))
            print(json.dumps({"books": a.books, "ns_single": single / a.books * 1e9, "ns_batch": (time.perf_counter() - began) / a.books * 1e9}))
            return 0
        spark = local_session()
        if a.command == "visualize":
            if a.output:
                from larkspread.report import draw

                print("\n".join(draw(spark, Model.load(a.model), a.output)))
            else:
                print(figure_data(spark, Model.load(a.model)).orderBy("state").toPandas().to_string(index=False))
        elif a.command == "train":
            quotes = synthetic_quotes(spark, a.events, a.seed, feed=SyntheticFeed())
            made = calibrate(quotes, StateSpace(a.buckets, parse_bounds(a.bounds)), Smoothing(a.alpha), symmetrize=a.symmetrize)
            made.model.save(a.output)
            print(f"{made.model.training_observations} transitions, {made.sweeps} sweeps, largest drift {made.max_drift:.6f}; saved to {a.output}")
        elif a.command == "evaluate":
            plan = _plan(a)
            _finish(evaluate(synthetic_quotes(spark, a.events, a.seed), plan), a, "Synthetic feed")
        elif a.command == "evaluate-csv":
            plan = _plan(a)
            read = read_level_pair(spark, a.input, a.messages, _layout(a)) if a.messages else read_delimited(spark, a.input, _layout(a))
            audit = read.audit().first()
            _finish(replace(evaluate(read.quotes(), plan), truncated_at=a.max_events), a, a.input, audit.asDict() if audit else None)
        else:
            plan = _plan(a)
            quotes = read_quotes(spark, a.input)
            if a.resolution == 1 and quotes.where("(bid + ask) % 2 <> 0").limit(1).count():
                print("warning: some mids fall between units and are cut off; use resolution 2", file=sys.stderr)
            _finish(evaluate(quotes, plan, a.max_events), a, a.input + (f" (tick {a.tick_size:g})" if a.tick_size else ""))
        return 0
    except QuoteError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(run())
