import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspread.config import CompareOptions, EvaluationPlan, Smoothing, StateSpace
from larkspread.errors import OutOfOrder, TooFewObservations
from larkspread.operators import estimate as est
from larkspread.operators import evaluate as ev
from larkspread.operators import transitions as tr
from larkspread.operators.ordering import dense_index, last_at_or_before, running_max, with_neighbours
from larkspread.sources.quotes import event_quotes


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "horizon int, idx long, symbol_id long, exact double, weighted double, g_star double, target double")


def test_hand_computed_losses(spark):
    rows = [(1, 0, 1, 10001.0, 10001.0, 0.2, 10002.0), (1, 1, 1, 10002.0, 10002.0, 0.225 + 0.025, 10001.0)]
    r = ev.compare(_pairs(spark, rows), ["horizon"]).first()
    assert r.micro_mae == pytest.approx((0.8 + 1.25) / 2) and r.naive_mae == 1 and r.naive_mse == 1
    assert (r.micro_directional, r.micro_right, r.weighted_directional) == (2, 1, 0)
    assert r.weighted_low is None and r.n_price_changing == 2 and r.up_share == 0.5


def test_two_direction_rules_differ_at_zero(spark):
    rows = [(1, 10, 12, 10.0, 0.0, 0.5)]
    df = spark.createDataFrame(rows, "horizon int, mid long, target_mid long, weighted double, g_star double, p_up double")
    r = ev.score(df, ["horizon"]).first()
    assert r.direction_accuracy == 1.0 and r.n_directional == 1 and r.brier == 0.25 and r.brier_skill is None
    zero = ev.compare(_pairs(spark, [(1, 0, 1, 10.0, 10.0, 0.0, 12.0)]), ["horizon"]).first()
    assert zero.micro_directional == 0


def test_brier(spark):
    rows = [(1, 10, 11, 10.0, 0.1, 0.9), (1, 10, 9, 10.0, 0.1, 0.1), (1, 10, 9, 10.0, 0.1, 0.5), (1, 10, 10, 10.0, 0.1, 0.5)]
    df = spark.createDataFrame(rows, "horizon int, mid long, target_mid long, weighted double, g_star double, p_up double")
    assert ev.score(df, ["horizon"]).first().brier == pytest.approx(0.09)


def test_wilson(spark):
    low, high = ev.wilson(F.lit(50), F.lit(100))
    r = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert r.a == pytest.approx(0.4038, abs=1e-4) and r.b == pytest.approx(0.5962, abs=1e-4)


@pytest.mark.parametrize(
    "times,horizon,want",
    [
        ([0, 10, 20, 30, 40], 20, [2, 3, 4, None, None]),
        ([0, 10, 21, 30, 41], 20, [1, 3, 4, None, None]),
        ([0, 5, 5, 5, 20], 5, [3, 3, 3, 3, None]),
        ([0, 100, 200], 50, [0, 1, None]),
    ],
)
def test_clock_targets(spark, quotes, times, horizon, want):
    df = dense_index(quotes([(1, 3, 1, 1, t) for t in times]))
    got = {r.idx: r.target_idx for r in ev.clock_targets(df, horizon).collect()}
    assert [got[i] for i in range(len(times))] == want


def test_clock_overflow_is_unresolved(spark, quotes):
    df = dense_index(quotes([(1, 3, 1, 1, 2**62), (1, 3, 1, 1, 2**63 - 5)]))
    got = {r.idx: r.target_idx for r in ev.clock_targets(df, 2**62).collect()}
    assert got == {0: None, 1: None}


def test_as_of_by_small_buckets_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    times = np.sort(rng.integers(0, 3000, 300))
    rows = [(1, int(t), i) for i, t in enumerate(times)]
    probes = [(1, int(p), k) for k, p in enumerate(rng.integers(0, 3000, 200))]
    a = spark.createDataFrame(rows, "symbol_id long, timestamp_ns long, idx long").withColumn("v", F.col("idx"))
    b = spark.createDataFrame(probes, "symbol_id long, at long, probe long")
    for sizes in ({"bucket_ns": 17}, {"bucket_ns": 1000, "most": 7}):
        got = {r.probe: r.found_v for r in last_at_or_before(a, b, ["v"], **sizes).collect()}
        for _, p, k in probes:
            at = np.searchsorted(times, p, side="right") - 1
            assert got[k] == (None if at < 0 else at)


def test_blocked_order_operators_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    seq = np.sort(rng.choice(5000, 400, replace=False))
    val = rng.integers(0, 1000, 400)
    df = spark.createDataFrame([(1, int(s), int(v)) for s, v in zip(seq, val)], "symbol_id long, sequence long, v long")
    indexed = dense_index(df, block=64)
    got = {r.sequence: r for r in with_neighbours(indexed, {"back": ("v", -3), "ahead": ("v", 5)}, block=8).collect()}
    top = {r.sequence: r.top for r in running_max(df, "v", "top", "symbol_id", "sequence", block=32).collect()}
    for i, s in enumerate(seq.tolist()):
        assert got[s].idx == i
        assert got[s].back == (int(val[i - 3]) if i >= 3 else None) and got[s].ahead == (int(val[i + 5]) if i + 5 < 400 else None)
        assert top[s] == (int(val[:i].max()) if i else None)


def test_split(spark, quotes):
    df = dense_index(quotes([(1, 3, 1, 1)] * 100))
    got = ev.chronological_split(df, 0.7)
    assert got.where("train").count() == 70 and got.where("train").agg(F.max("idx")).first()[0] == 69
    ev.require_no_leak(got)
    assert [r.idx for r in ev.test_part(got).orderBy("idx").collect()] == list(range(30)) and ev.train_part(got).columns == quotes([(1, 3, 1, 1)]).columns
    two = ev.chronological_split(dense_index(quotes([(1, 3, 1, 1)] * 2)), 0.99)
    assert two.where("train IS NULL").count() == 2
    with pytest.raises(OutOfOrder):
        ev.require_no_leak(spark.createDataFrame([(1, 9, True), (1, 5, False)], "symbol_id long, timestamp_ns long, train boolean"))
    with pytest.raises(TooFewObservations):
        ev.require_rows(quotes([(1, 3, 1, 1)] * 99))


def test_split_mix_is_the_published_generator():
    mask = (1 << 64) - 1

    def one_by_one(seed, n):
        out, s = [], seed
        for _ in range(n):
            s = (s + 0x9E3779B97F4A7C15) & mask
            z = s
            z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
            out.append(z ^ (z >> 31))
        return out

    assert ev.split_mix(42, 50).tolist() == one_by_one(42, 50)


def test_bootstrap_is_deterministic_and_degenerate_for_no_difference():
    sums, rows = np.arange(10, dtype=float), np.full(10, 5.0)
    o = CompareOptions(resamples=200, block=5)
    assert ev.bootstrap_interval(sums, rows, o) == ev.bootstrap_interval(sums, rows, o)
    assert ev.bootstrap_interval(np.zeros(10), rows, o) == (0.0, 0.0)
    assert ev.bootstrap_interval(sums, rows, CompareOptions(resamples=0)) is None


def test_verdicts(spark):
    df = spark.createDataFrame([(-2.0, -1.0), (1.0, 2.0), (-1.0, 1.0), (None, None)], "low double, high double")
    assert [r[0] for r in df.select(ev.verdict(F.col("low"), F.col("high"))).collect()] == ["better", "worse", "indistinct", "cannot_apply"]


def test_golden_losses_of_the_derived_feed(spark):
    """Out-of-sample losses at 10 events worked out independently."""
    from larkspread.plans.reference import _pairs

    pairs = _pairs(spark, "/root/testdata/sf0.01").where("horizon = 10").cache()
    r = ev.compare(pairs, ["symbol_id"]).first()
    assert r.n == 2932 and r.n_price_changing == 2361
    assert (round(r.naive_mae, 6), round(r.naive_mse, 6)) == (3.129604, 15.866985)
    assert (round(r.weighted_mae, 6), round(r.weighted_mse, 6)) == (3.468533, 18.707139)
    assert (round(r.micro_mae, 6), round(r.micro_mse, 6), round(r.micro_bias, 6)) == (3.148601, 15.901345, -0.047722)
    assert (r.micro_directional, r.micro_right, r.weighted_directional, r.weighted_right) == (2361, 1141, 2344, 1151)
    blocks = ev.paired_blocks(pairs, ["symbol_id"], 100)
    got = {x.loss: x for x in ev.bootstrap(blocks, ["symbol_id"], CompareOptions(block=100)).collect()}
    assert got["mse_vs_naive"].low == pytest.approx(-0.020346, abs=1e-6) and got["mse_vs_naive"].high == pytest.approx(0.088146, abs=1e-6)
    assert got["mae_vs_naive"].low == pytest.approx(0.013567, abs=1e-6) and got["mae_vs_naive"].high == pytest.approx(0.024090, abs=1e-6)


def test_clock_horizon_on_a_regular_grid_equals_the_event_horizon(spark, quotes):
    df = dense_index(quotes([(100 + i % 7, 104 + i % 7, 1 + i % 5, 3) for i in range(60)]))
    clock = {r.idx: r.target_idx for r in ev.clock_targets(df, 50).collect()}
    assert all(clock[i] == (i + 5 if i + 5 < 60 else None) for i in range(60))


def test_report_end_to_end(spark, tmp_path):
    from larkspread.report import evaluate, figure_data, markdown, write_report
    from larkspread.sources.synthetic import synthetic_quotes

    plan = EvaluationPlan(StateSpace(4, (1,)), Smoothing(0.5), horizons=(1, 5), primary=5, wall_clock_ms=(1,), compare=CompareOptions(100, 10, 1))
    result = evaluate(synthetic_quotes(spark, 2500, 7), plan)
    assert result.train_rows == 1750 and result.test_rows == 750
    assert {c["horizon"] for c in result.comparisons} == {"1 events", "5 events", "1 ms"}
    text = markdown(result)
    write_report(text, str(tmp_path / "a/b.md"))
    assert "## Decision" in (tmp_path / "a/b.md").read_text()
    assert figure_data(spark, result.calibration.model).count() == 8


def test_unresolved_and_skipped_rows_are_counted(spark):
    from larkspread.report import evaluate, markdown
    from larkspread.sources.synthetic import synthetic_quotes

    rows = [(1, 0, 1, 9.0, 9.0, 0.1, 9.0), (1, 1, 1, 9.0, 9.0, None, 9.0), (1, 2, 1, 9.0, 9.0, None, None), (1, 3, 1, 9.0, 9.0, 0.1, None), (2, 0, 1, 9.0, 9.0, 0.1, 9.0)]
    got = {r.horizon: (r.n_unresolved, r.n_skipped) for r in ev.unevaluated(_pairs(spark, rows), ["horizon"]).collect()}
    assert got == {1: (2, 1), 2: (0, 0)}
    quotes = synthetic_quotes(spark, 1000, 7).withColumn("bid", F.when((F.col("sequence") > 800) & (F.col("sequence") % 50 == 0), F.col("ask") - 20).otherwise(F.col("bid")))
    plan = EvaluationPlan(StateSpace(4, (1,)), Smoothing(0.5), horizons=(1, 5), primary=5, wall_clock_ms=(1,), compare=CompareOptions(10, 10, 1))
    result = evaluate(quotes, plan)
    n = {c["horizon"]: c["n"] for c in result.comparisons}
    lost = {c["horizon"]: (c["n_unresolved"], c["n_skipped"]) for c in result.unevaluated}
    assert {h: n[h] + sum(lost[h]) for h in n} == {"1 events": result.test_rows - 1, "5 events": result.test_rows - 5, "1 ms": result.test_rows}
    assert lost["1 ms"][0] > 0 and lost["1 events"][0] == 0
    assert f"| 1 ms | {lost['1 ms'][0]} | {lost['1 ms'][1]} |" in markdown(result)


def test_known_chain_is_recovered(spark):
    """A sampled two-state chain with a known answer."""
    rng = np.random.default_rng(11)
    n, s, rows = 20_000, 0, []
    for _ in range(n):
        u = rng.random()
        if s == 0:
            to, d = (0, 0) if u < 0.5 else (1, 0) if u < 0.8 else (1, 1)
        else:
            to, d = (0, 0) if u < 0.4 else (1, 0) if u < 0.6 else (0, 1) if u < 0.85 else (1, -1)
        rows.append((1, s, to, d))
        s = to
    pairs = spark.createDataFrame(rows, "symbol_id long, from_state int, to_state int, delta long")
    solved = est.adjustments(tr.count_transitions(pairs), StateSpace(2, ()), Smoothing(0.5)).orderBy("state").toPandas()
    q, g1 = np.array([[0.5, 0.3], [0.4, 0.2]]), np.array([0.2, 0.1])
    want, _ = est.solve(q, g1)
    assert np.abs(solved.g_star - want).max() < 0.05


def _feed(spark, symbol, n=400, seed=1):
    import random

    rng, mid, rows = random.Random(seed), 1000, []
    for i in range(n):
        mid += rng.choice([-2, 0, 0, 2])
        rows.append((symbol, i, i * 1000, mid - 1, mid + 1 + 2 * rng.randrange(2), rng.randrange(1, 90), rng.randrange(1, 90)))
    return spark.createDataFrame(rows, "symbol_id long, sequence long, timestamp_ns long, bid long, ask long, bid_qty long, ask_qty long")


def test_many_sources_are_evaluated_as_each_alone(spark):
    from larkspread.config import CompareOptions, EvaluationPlan, StateSpace
    from larkspread.report import evaluate, evaluate_sources

    plan = EvaluationPlan(StateSpace(4, (1, 2)), horizons=(1, 10), primary=10, compare=CompareOptions(200, 1, 7))
    feeds = {s: _feed(spark, s, seed=s) for s in (1, 2, 3)}
    both = {(r.symbol_id, r.horizon): r for r in evaluate_sources(feeds[1].unionByName(feeds[2]).unionByName(feeds[3]), plan).collect()}
    assert len(both) == 6
    alone = evaluate(feeds[2], plan)
    for r in alone.comparisons:
        got = both[2, int(r["horizon"].split()[0])]
        assert got.n == r["n"] and got.micro_mse == pytest.approx(r["micro_mse"]) and got.micro_right == r["micro_right"]
    for i in alone.intervals:
        got = both[2, int(i["horizon"].split()[0])].differences[i["loss"]]
        assert got.low == pytest.approx(i["low"]) and got.verdict == i["verdict"]


def test_order_is_checked_beyond_the_prefix_and_the_report_says_what_was_read(spark, tmp_path, capsys):
    from larkspread.cli import run
    from larkspread.sources.quotes import write_quotes

    good = _feed(spark, 1)
    late = good.withColumn("timestamp_ns", F.when(F.col("sequence") == 390, 0).otherwise(F.col("timestamp_ns")))
    for name, rows in (("good", good), ("late", late)):
        write_quotes(rows, str(tmp_path / name))
    more = ["--max-events", "200", "--resamples", "50", "--horizons", "1,10", "--symmetrize"]
    assert run(["evaluate-parquet", "--input", str(tmp_path / "late"), *more]) == 1 and "decreases" in capsys.readouterr().err
    assert run(["evaluate-parquet", "--input", str(tmp_path / "good"), *more]) == 0
    text = capsys.readouterr().out
    for words in ("first 200 events", "symmetrized counts", "seed 42", "states never left", "events ahead on average", "blocks of 1000 rows"):
        assert words in text, words
    assert run(["evaluate-csv", "--input", str(tmp_path / "nowhere.csv"), "--tick-size", "0.1"]) == 1 and "cannot be read" in capsys.readouterr().err


def test_inspect_and_predict_say_how_much_a_model_knows(spark, tmp_path, capsys):
    import json

    from larkspread.cli import run

    path = str(tmp_path / "model")
    assert run(["train", "--events", "3000", "--output", path]) == 0
    capsys.readouterr()
    assert run(["inspect", "--model", path]) == 0
    shown = json.loads(capsys.readouterr().out)
    assert {"g_mean", "visits_min", "visits_max", "p_up_mean", "antisymmetry", "low_evidence", "first_unvisited"} <= set(shown) and shown["visits_max"] >= shown["visits_min"]
    assert run(["predict", "--model", path, "--bid", "100", "--ask", "190", "--bid-qty", "5", "--ask-qty", "5"]) == 0
    assert "only 0 times" in capsys.readouterr().err
