import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspread.config import Smoothing, SolverSettings, StateSpace
from larkspread.errors import BadModel, InvalidBook, NoConvergence, OutOfOrder, TooFewObservations
from larkspread.model import Model, calibrate
from larkspread.operators import estimate as est
from larkspread.operators import transitions as tr
from larkspread.sources.quotes import event_quotes

SPACE2 = StateSpace(2, ())
SF = "/root/testdata/sf0.01"


def _counts(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "symbol_id long, from_state int, to_state int, n_flat long, n_moved long, delta_sum long, up long, down long")


TOY = [(0, 0, 500, 0, 0, 0, 0), (0, 1, 0, 200, 200, 200, 0), (0, 1, 300, 0, 0, 0, 0)]


def test_counts_chunks_and_chain_breaks(spark, quotes):
    df = quotes([(99, 101, 900, 100), (99, 101, 100, 900), (100, 102, 100, 900), (99, 101, 900, 100)])
    whole = {tuple(r) for r in tr.count_transitions(tr.transitions(df, SPACE2)).collect()}
    assert sum(r[3] + r[4] for r in whole) == 3
    parts = [df.where("sequence <= 1"), df.where("sequence >= 1")]
    assert {tuple(r) for r in tr.merge_counts(*[tr.count_transitions(tr.transitions(p, SPACE2)) for p in parts]).collect()} == whole
    apart = [df.where("sequence <= 1"), df.where("sequence >= 2")]
    assert sum(r[3] + r[4] for r in tr.merge_counts(*[tr.count_transitions(tr.transitions(p, SPACE2)) for p in apart]).collect()) == 2
    broken = quotes([(99, 101, 9, 1), (99, 101, 0, 0), (99, 101, 9, 1), (99, 99, 9, 1), (99, 101, 9, 1), (99, 101, 1, 9)])
    assert tr.transitions(broken, SPACE2).count() == 1


def test_small_blocks_change_nothing(spark):
    rows = event_quotes(spark, "/root/testdata/sf0.001")
    space = StateSpace()
    big = {tuple(r) for r in tr.transitions(rows, space).collect()}
    assert {tuple(r) for r in tr.transitions(rows, space, block=7).collect()} == big


def test_flat_and_moved_are_kept_apart(spark):
    pairs = spark.createDataFrame([(1, 0, 1, 0), (1, 0, 1, 0), (1, 0, 2, 1)], "symbol_id long, from_state int, to_state int, delta long")
    got = {(r.from_state, r.to_state): r for r in tr.count_transitions(pairs).collect()}
    assert got[0, 1].n_flat == 2 and got[0, 2].n_flat == 0 and got[0, 2].n_moved == 1
    totals = tr.state_totals(tr.count_transitions(pairs)).first()
    assert totals.visits == 3 and totals.delta_sum == 1 and totals.p_up == 1.0
    moves = spark.createDataFrame([(1, 0, 0, d) for d in (0, 2, -1, 3)], "symbol_id long, from_state int, to_state int, delta long")
    totals = tr.state_totals(tr.count_transitions(moves)).first()
    assert (totals.up, totals.down, totals.delta_sum) == (2, 1, 4)


def test_order_is_required(spark, quotes):
    tr.require_order(quotes([(1, 2, 1, 1), (1, 2, 1, 1)]))
    with pytest.raises(OutOfOrder):
        tr.require_order(quotes([(1, 2, 1, 1, 5), (1, 2, 1, 1, 4)]))
    with pytest.raises(OutOfOrder):
        tr.require_order(quotes([(1, 2, 1, 1)]).unionByName(quotes([(1, 2, 1, 1)])))


def test_unvisited_state_and_no_smoothing():
    frame = pd.DataFrame([(0, 1, 1, 0, 0, 0, 0)], columns=["from_state", "to_state", "n_flat", "n_moved", "delta_sum", "up", "down"])
    m = est.dense_arrays(frame, StateSpace(3, ()), Smoothing(1.0))
    assert m["g1"][2] == 0 and np.allclose(m["q"][2], 0.25) and m["p_up"][2] == 0.5
    with pytest.raises(TooFewObservations, match="state 1"):
        est.dense_arrays(frame, StateSpace(3, ()), Smoothing(0.0))


def test_toy_chain_has_its_known_solution():
    q, g1 = np.array([[0.5, 0.0], [0.4, 0.2]]), np.array([0.1, 0.1])
    g, sweeps = est.solve(q, g1)
    assert np.allclose(g, [0.2, 0.225]) and sweeps > 1
    r = np.array([[0.3 * 0, 0.5], [0.25, 0.15]])
    _, d = est.drift(q, r, g1, g)
    assert np.allclose(d, [0.1125, 0.25 * 0.2 + 0.15 * 0.225])
    with pytest.raises(NoConvergence):
        est.solve(np.eye(2), g1, SolverSettings(sweeps=10))


def test_frames_agree_with_arrays(spark):
    counts = _counts(spark, [(0, 0, 500, 0, 0, 0, 0), (0, 1, 300, 200, 200, 200, 0), (1, 0, 400, 250, 100, 200, 50), (1, 1, 200, 150, 0, 75, 75)]).groupBy("symbol_id", "from_state", "to_state").agg(*[F.sum(c).alias(c) for c in tr.COUNTS])
    m = est.dense_arrays(counts.toPandas(), SPACE2, Smoothing(0.5))
    k = {(r.from_state, r.to_state): (r.q, r.r) for r in est.kernel(counts, SPACE2, Smoothing(0.5)).collect()}
    for (i, j), (q, r) in k.items():
        assert q == pytest.approx(m["q"][i, j]) and r == pytest.approx(m["r"][i, j])
    for r in est.state_estimates(counts, SPACE2, Smoothing(0.5)).collect():
        assert r.g1 == pytest.approx(m["g1"][r.state]) and r.p_up == pytest.approx(m["p_up"][r.state]) and r.visits == m["visits"][r.state]


def test_symmetrized_counts(spark):
    counts = _counts(spark, [(0, 0, 500, 300, -300, 0, 300), (0, 1, 0, 200, 200, 200, 0), (1, 0, 400, 250, -250, 0, 250), (1, 1, 200, 150, 150, 150, 0)])
    got = {(r.from_state, r.to_state): r for r in tr.symmetrize(counts, SPACE2).collect()}
    assert got[0, 0].n_flat == 700 and got[0, 1].n_flat == 400 and got[0, 1].n_moved == 450 and got[0, 0].n_moved == 450
    solved = est.adjustments(tr.symmetrize(counts, SPACE2), SPACE2)
    assert est.antisymmetry(solved, SPACE2).first().residual < 1e-9
    assert est.antisymmetry(est.adjustments(counts, SPACE2), SPACE2).first().residual > 1e-6


def test_golden_values_of_the_derived_feed(spark):
    """Counts and adjustments worked out independently for the derived feed."""
    rows, space = event_quotes(spark, SF), StateSpace()
    counts = tr.count_transitions(tr.transitions(rows, space)).cache()
    t = counts.agg(F.sum(F.expr("n_flat + n_moved")), F.sum("n_flat"), F.sum("up"), F.sum("down")).first()
    assert tuple(t) == (9598, 5765, 1901, 1932)
    solved = est.adjustments(counts, space).orderBy("state").toPandas()
    assert np.allclose(solved.g_star[:4], [0.242544, -0.047986, -0.050001, -0.158826], atol=1e-6)
    assert solved.g_star.abs().max() == pytest.approx(0.255175, abs=1e-6) and solved.g_star.abs().sum() == pytest.approx(3.096749, abs=1e-6)
    assert solved.drift.abs().max() == pytest.approx(0.0202, abs=1e-4) and solved.sweeps.max() == 40


def test_artifact_round_trip_and_corruption(spark, tmp_path):
    rows = event_quotes(spark, "/root/testdata/sf0.001")
    made = calibrate(rows, symmetrize=True)
    assert made.antisymmetry < 1e-9
    m = made.model
    assert sum(m.visits) == 2 * m.training_observations
    m.save(tmp_path / "m")
    assert Model.load(tmp_path / "m") == m
    meta = json.loads((tmp_path / "m/metadata.json").read_text())
    for version in (1, 999):
        (tmp_path / "m/metadata.json").write_text(json.dumps(meta | {"schema_version": version}))
        with pytest.raises(BadModel):
            Model.load(tmp_path / "m")
    n = m.space.size
    for p in (1.5, -0.01):
        with pytest.raises(BadModel):
            Model(1, m.space, 0.5, 1, (0.0,) * n, (p,) * n, (1,) * n)
    with pytest.raises(BadModel):
        Model(1, m.space, 0.5, 1, (float("nan"),) * n, (0.5,) * n, (1,) * n)
    with pytest.raises(BadModel):
        Model(1, m.space, 0.5, 1, (0.0,) * (n + 1), (0.5,) * n, (1,) * n)


def test_single_batch_and_frame_predictions_agree(spark):
    rows = event_quotes(spark, "/root/testdata/sf0.001")
    m = calibrate(rows).model
    got = {r.sequence: r for r in m.transform(rows).collect()}
    good = [r for r in rows.collect() if r.ask > r.bid and r.bid_qty + r.ask_qty > 0]
    batch = m.predict_batch([r.bid for r in good], [r.ask for r in good], [r.bid_qty for r in good], [r.ask_qty for r in good])
    for k, r in enumerate(good):
        e = m.predict(r.bid, r.ask, r.bid_qty, r.ask_qty)
        assert (batch["state"][k], batch["micro_price"][k]) == (e.state, e.micro_price)
        assert got[r.sequence].state == e.state and got[r.sequence].micro_price == pytest.approx(e.micro_price)
    with pytest.raises(InvalidBook, match="row 1"):
        m.predict_batch([1, 2], [3, 2], [1, 1], [1, 1])
    with pytest.raises(InvalidBook, match="row 0"):
        m.predict_batch([1.0], [3], [1], [1])
    assert m.predict_batch([], [], [], [])["state"] == []
    with pytest.raises(InvalidBook):
        m.transform(rows, on_invalid="error")


def test_synthetic_training_and_metadata(spark):
    from larkspread.functions.book import price
    from larkspread.model import train_synthetic

    m = train_synthetic(spark, 2000, num_imbalance_buckets=5, seed=3, symbol_id=9)
    assert m == train_synthetic(spark, 2000, num_imbalance_buckets=5, seed=3, symbol_id=9)
    assert m.metadata() | {"training_observations": 0} == {"schema_version": 2, "symbol_id": 9, "num_imbalance_buckets": 5, "spread_bucket_bounds_ticks": [], "smoothing_alpha": 0.5, "training_observations": 0}
    assert spark.range(5, 6).select(price("id", 0.1)).first()[0] == pytest.approx(0.5)


def test_materialized_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    from larkspread import session

    assert session.shared_folder(spark) == session.shared_folder(spark)
    monkeypatch.setattr(session, "shared_folder", lambda s: f"file://{tmp_path}")
    df = session.materialize(spark.range(3))
    assert df.count() == 3 and list(tmp_path.glob("larkspread/*"))
    session.drop_materialized(spark)
    assert not list(tmp_path.glob("larkspread"))
