"""The general training-data operators: edge cases and brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspread.functions.instants import instant_ns
from larkspread.operators import anomalies as an
from larkspread.operators.dedup import first_deliveries, superfluous_deliveries
from larkspread.operators.grid import SpectrumModel, impute, regular_grid
from larkspread.operators.parse_lines import COLUMNS, cheapest_edits, parse_batch, parse_lines, quotes_of, rejects_of, split_free

HEADER = ",".join(COLUMNS)


# --- 1: lines ---------------------------------------------------------------------


def _edit_distance(line, fields, limit=4):
    """Fewest insertions and deletions of quotes and commas that make a line legal."""
    seen, edge = {line}, {line}
    for cost in range(limit + 1):
        if any((f := split_free(x)) is not None and len(f) == fields for x in edge):
            return cost
        new = set()
        for x in edge:
            new |= {x[:i] + c + x[i:] for i in range(len(x) + 1) for c in '",'} | {x[:i] + x[i + 1 :] for i in range(len(x)) if x[i] in '",'}
        edge = new - seen
        seen |= new
    return None


@given(st.text('a",', max_size=6), st.integers(1, 3))
@settings(max_examples=150, deadline=None)
def test_cheapest_edits_equal_brute_force(line, fields):
    got = int(cheapest_edits([line], [fields]).sum())
    want = _edit_distance(line, fields, 3)
    assert got == want if want is not None else got > 3


@pytest.mark.parametrize(
    "line,status,reason",
    [
        ("1,2,3,4,5,6,7", "quote", None),
        ('"1"," 2 ",3,+4.0,5e0,6,7\r', "quote", None),
        ("1,2,0,4,0,6,7", "quote", None),
        ("1,2,-0,4,5,6,7", "quote", None),
        ("", "blank", None),
        (None, "blank", None),
        (" \t\r", "blank", None),
        (HEADER.upper() + "\r", "header", None),
        ("1,2,3,4,5,6", "reject", "structure: 1 field(s) missing"),
        ("1,2,3,4,5,6,7,", "reject", "structure: 1 field(s) too many"),
        ('"1,2,3,4,5,6,7', "reject", "structure: quote not closed or not doubled"),
        ('1,2"",3,4,5,6,7', "reject", None),
        ('1,"2"x,3,4,5,6,7', "reject", None),
        ("1;2;3;4;5;6;7", "reject", "structure: 6 field(s) missing"),
        ("1,,3,4,5,6,7", "reject", "best_bid_price: empty"),
        ("1,0,3,4,5,6,7", "reject", "best_bid_price: out of range"),
        ("1,-2,3,4,5,6,7", "reject", "best_bid_price: out of range"),
        ("1,2,3,9999999999,5,6,7", "reject", "best_ask_price: out of range"),
        ("1,2,3,9999999998.9999999999999,5,6,7", "quote", None),
        ("1,1e-400,3,4,5,6,7", "quote", None),
        ("1,1e999999999,3,4,5,6,7", "reject", "best_bid_price: out of range"),
        ("1,2,-1,4,5,6,7", "reject", "best_bid_qty: negative"),
        ("1,2,1e999,4,5,6,7", "reject", "best_bid_qty: not finite"),
        ("1,2,.5,4,5,6,7", "reject", "best_bid_qty: not a decimal number"),
        ("1,2,5.,4,5,6,7", "reject", "best_bid_qty: not a decimal number"),
        ("1,2,NaN,4,5,6,7", "reject", "best_bid_qty: not a decimal number"),
        ("1,2,٣,4,5,6,7", "reject", "best_bid_qty: not a decimal number"),
        ("1,2,3 ,4,5,6,7", "reject", "best_bid_qty: not a decimal number"),
        ("1,2,3,4,5,6,x", "reject", "event_time: not a decimal number"),
        ("x" * 200_000, "reject", "structure: 6 field(s) missing"),
        ("," * 5000, "reject", "structure"),
    ],
)
def test_lines(line, status, reason):
    got = parse_batch([line], [HEADER])[0]
    assert got[0] == status
    if reason or status != "reject":
        assert got[1] == reason


def test_the_cheapest_cost_decides_and_long_lines_have_edits(monkeypatch):
    assert parse_batch(["," * 5000], [HEADER])[0][2] == {"insert_quote": 2}
    assert parse_batch(['x"' * 4500 + ",2,3,4,5,6,7"], [HEADER])[0][2] == {"insert_quote": 4500}  # opened, all but the last doubled
    lines = ['1,"2,3', '"a""b"x,2', "1,2,3,4", '","",', ""]
    both = cheapest_edits([*lines, "," * 4500], [3] * 6)  # in wide numbers
    assert both[:5].tolist() == cheapest_edits(lines, [3] * 5).tolist() and both[5].sum() == 2
    line = '1,"2",3,"4.5",5,6,7'
    want = parse_batch([line], [HEADER])
    monkeypatch.setattr("larkspread.operators.parse_lines.split_free", lambda text: text.split(",") if '"' not in text else None)
    assert parse_batch([line, line + '"'], [HEADER] * 2)[0] == want[0] and want[0][0] == "quote"


SPLITTING = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture
def splitting(spark):
    """A session in which small partitions already count as skewed."""
    before = {k: spark.conf.get(k, None) for k in SPLITTING}
    for k, v in SPLITTING.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _ran(df):
    """Number of rows of ``df`` and the plan that gave them."""
    n = len(df.collect())
    return n, df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_file_is_split(splitting, monkeypatch):
    spark, n = splitting, 40_000
    rows = spark.range(n).select(
        F.col("id").alias("line_id"), F.when(F.col("id") % 20 == 0, F.concat(F.lit("g"), F.col("id") % 7)).otherwise("hot").alias("feed_file"), (F.col("id") + 2).cast("int").alias("line_no"),
        F.concat(F.col("id") + 1_000_000_000, F.lit(",2,3,4,5,6,"), F.hash("id").cast("bigint") + 9_999_999_999).alias("raw_line"),
    )
    heads = spark.createDataFrame([(-1 - i, f, 1, HEADER) for i, f in enumerate(["hot", *(f"g{k}" for k in range(7))])], rows.schema)
    lines = rows.unionByName(heads)
    got, plan = _ran(quotes_of(parse_lines(lines)))
    assert got == n and "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    monkeypatch.setattr("larkspread.operators.parse_lines.BROADCAST_CHARS", 0)
    got, plan = _ran(quotes_of(parse_lines(lines)))
    assert got == n and "skew=true" in plan


def test_note_and_column_order(spark):
    rows = [
        (1, "f", 1, "Note,EVENT_TIME,update_id,best_bid_price,best_bid_qty,best_ask_price,best_ask_qty,transaction_time\r", "x"),
        (2, "f", 2, '"a ""b"", c",7,1,2.5,3,4.5,5,6', "y"),
        (3, "f", 3, 'a"b,7,1,2,3,4,5,6', "z"),
        (4, "f", 3, 'a"b,7,1,2,3,4,5,6', None),
        (5, "g", 2, "1,2,3,4,5,6,7", None),
        (6, "h", 1, "not,a,header", None),
        (7, "h", 2, "1,2,3,4,5,6,7", None),
        (8, None, 2, "1,2,3,4,5,6,7", None),
        (9, "f", None, None, None),
    ]
    df = spark.createDataFrame(rows, "line_id long, feed_file string, line_no int, raw_line string, status string").withColumnRenamed("status", "reasons")
    got = {r.line_id: r for r in parse_lines(df).collect()}
    assert got[2].status == "quote" and got[2].event_time == 7 and got[2].best_bid_price == 2.5 and got[2].reasons == "y"
    assert [got[i].status for i in range(1, 10)] == ["header", "quote", "reject", "reject", "reject", "reject", "reject", "reject", "blank"]
    assert got[5].reason == got[7].reason == got[8].reason == "no_header" and got[3].edits == {"delete_quote": 1}
    clash = df.withColumn("status", F.lit("mine")).withColumn("best_bid_qty", F.lit("mine"))
    assert {r.line_id: r.status for r in parse_lines(clash).collect()} == {k: r.status for k, r in got.items()}
    assert quotes_of(parse_lines(df)).count() == 1 and rejects_of(parse_lines(df)).count() == 6
    assert parse_lines(df.limit(0)).count() == 0


# --- 2: readings ------------------------------------------------------------------

L1 = "symbol_id long, sequence long, timestamp_ns long, bid_price_ticks long, ask_price_ticks long, bid_qty long, ask_qty long, received_at timestamp"


def _walk(n, seed=1, symbol=1):
    rng = random.Random(seed)
    p, rows = 10_000, []
    for i in range(n):
        p += rng.choice([-2, 0, 2])
        rows.append([symbol, i + 1, i * 1_000_000, p, p + 4 + 2 * rng.randrange(2), rng.randrange(50, 150), rng.randrange(50, 150), None])
    return rows


def _flags(spark, rows, **settings):
    df = spark.createDataFrame([tuple(r) for r in rows], L1)
    return {r.sequence: r for r in an.flag_readings(df, an.SpikeModel(**settings)).collect()}


def test_planted_readings_are_flagged(spark):
    rows = _walk(3000)
    want = {"spike": set(), "stuck": set(), "out_of_range": set()}
    for at, length in ((200, 1), (400, 2), (600, 3)):
        for k in range(at, at + length):
            rows[k][3] += 5000
            rows[k][4] += 5000
            want["spike"].add(k + 1)
    rows[800][5] = 20_000
    want["spike"].add(801)
    for k in range(1000, 1012):
        rows[k][3], rows[k][5] = 9_000, 77
    want["stuck"] |= set(range(1001, 1013))
    for k in range(1100, 1111):  # one too few
        rows[k][4], rows[k][6] = 11_000, 77
    rows[1300][3], rows[1301][4], rows[1302][5], rows[1303][4] = -1, 9_999_999_999, -5, rows[1303][3]
    want["out_of_range"] |= {1301, 1302, 1303, 1304}
    for k in range(2000, 3000):  # a level that moves and stays
        rows[k][3] += 4000
        rows[k][4] += 4000
    rows[2500][5] = None
    got = _flags(spark, rows)
    for kind, where in want.items():
        assert {s for s, r in got.items() if r[kind]} == where | ({801} if kind == "spike" else set()), kind
    assert all(r.p_abnormal > 0.5 for r in got.values() if r.spike or r.stuck or r.out_of_range)


def test_block_borders_change_nothing(spark):
    rows = _walk(4000, 2)
    rng = random.Random(9)
    for _ in range(60):
        k = rng.randrange(20, 3900)
        kind = rng.randrange(3)
        for j in range(k, k + rng.randrange(1, 5)):
            if kind == 0:
                rows[j][3] += 9000
                rows[j][4] += 9000
            elif kind == 1:
                rows[j][4] = rows[j][3]
        if kind == 2:
            for j in range(k, k + rng.randrange(10, 15)):
                rows[j][4], rows[j][6] = rows[k][4], rows[k][6]
    whole = _flags(spark, rows)
    cut = _flags(spark, rows, block=256, halo=96)
    for s in whole:
        assert [whole[s][k] for k in ("spike", "stuck", "out_of_range")] == [cut[s][k] for k in ("spike", "stuck", "out_of_range")], s


def test_readings_edge_cases(spark):
    rows = [(1, 1, 0, None, None, None, None, None), (1, 1, 0, None, None, None, None, None), (1, None, 0, 1, 2, 3, 4, None), (None, 1, 5, 1, 2, 3, 4, None), (2, 1, 0, 5, 6, 0, 0, None)]
    got = an.flag_readings(spark.createDataFrame(rows, L1)).collect()
    assert sorted((r.symbol_id, r.sequence) for r in got) == [(1, 1), (2, 1)] and not any(r.spike or r.stuck or r.out_of_range for r in got)
    empty = spark.createDataFrame([], L1)
    assert an.flag_readings(empty).count() == 0
    wide = spark.createDataFrame(rows, L1).withColumn("step", F.lit("x")).withColumn("day", F.lit("x")).withColumn("__own", F.lit(0))
    assert an.flag_readings(wide).count() == 2
    nulls = [[1, i, i, 7, 9, 5, 6, None] for i in range(1, 30)]
    nulls[11][5] = None  # breaks the run of 29 into 11 and 17
    assert {s for s, r in _flags(spark, nulls).items() if r.stuck} == set(range(13, 30))


def _spoiled(n, seed, gap=1):
    """A walk with spikes and runs, its numbers ``gap`` apart, and its repeats."""
    rows, rng = _walk(n, seed), random.Random(seed)
    for k in range(30, n - 40, 45):
        if rng.random() < 0.5:
            for j in range(k, k + rng.randrange(1, 4)):
                rows[j][3] += 9000
                rows[j][4] += 9000
        else:
            for j in range(k, k + rng.randrange(9, 16)):
                rows[j][4], rows[j][6] = rows[k][4], rows[k][6]
        rows[k + 20][rng.randrange(3, 7)] = None
    for r in rows:
        r[1] *= gap
    return rows + [list(r) for r in rows[:50]]


def _kinds(rows):
    return {s: (r.spike, r.stuck, r.out_of_range) for s, r in rows.items()}


def test_flags_depend_on_no_layout(spark):
    rows = _spoiled(1500, 11)
    want = _kinds(_flags(spark, rows))
    assert len({v for v in want.values()}) >= 3
    random.Random(1).shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        df = spark.createDataFrame([tuple(r) for r in rows], L1).repartition(13)
        got = {r.sequence: r for r in an.flag_readings(df, an.SpikeModel(block=100, halo=20), buffer_rows=150).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert _kinds(got) == want


def test_halo_counts_rows_however_sparse_the_numbers(spark):
    dense, sparse = _kinds(_flags(spark, _spoiled(700, 12))), _kinds(_flags(spark, _spoiled(700, 12, gap=5000), halo=20, block=10))
    assert {s * 5000: v for s, v in dense.items()} == sparse


def test_blocks_hold_rows_not_numbers(spark):
    rows = [(1, s, 0, 1, 2, 3, 4, None) for s in range(0, 10**15, 10**12)] + [(2, s, 0, 1, 2, 3, 4, None) for s in range(500)] + [(3, -(2**63), 0, 1, 2, 3, 4, None), (3, 2**63 - 1, 0, 1, 2, 3, 4, None)]
    sizes = {}
    for r in an._blocked(spark.createDataFrame(rows, L1), an.SpikeModel(block=100)).collect():
        sizes[r.symbol_id, r["__block"]] = sizes.get((r.symbol_id, r["__block"]), 0) + 1
    assert [max(n for (s, _), n in sizes.items() if s == k) for k in (1, 2)] == [100, 100]
    assert sum(n for (s, _), n in sizes.items() if s == 3) == 2  # the whole range of numbers


def test_a_day_without_sizes_keeps_its_step(spark):
    rows = _walk(300)
    for r in rows:
        r[3], r[4], r[5], r[6] = r[3] * 50, r[4] * 50, None, None
    assert not any(r.spike for r in _flags(spark, rows).values())


def _judged(rows, monkeypatch=None, p=None):
    if p is not None:
        monkeypatch.setattr(an, "posteriors", lambda seg, x, model: np.tile(p, (len(seg), 1)))
    n = len(rows)
    values = [np.array([r[c] for r in rows]) for c in range(3, 7)]
    scales = {c: np.full(n, v) for c, v in zip(an._SCALES, (2.0, 2e-3, 0.2, 0.2, 150.0, 150.0, 2e-3, 2e-3))}
    return an.judge(np.ones(n, np.int64), values, [np.zeros(n, bool)] * 4, scales, an.SpikeModel())[0]


def test_posteriors_decide(monkeypatch):
    rows = _walk(200)
    rows[50][3] += 3000
    rows[50][4] += 3000
    for k in range(100, 112):
        rows[k][3], rows[k][5] = 9_000, 77
    rows[150][5] = -1
    want = _judged(rows)
    assert want.sum(axis=0).tolist() == [1, 12, 1]
    assert _judged(rows, monkeypatch, np.array([1.0, 0, 0, 0, 0])).sum(axis=0).tolist() == [0, 0, 1]
    assert _judged(rows, monkeypatch, np.array([0.2, 0.6, 0.2, 0, 0]))[:, 0].all()


@given(st.lists(st.tuples(st.booleans(), st.sampled_from([-np.inf, -np.inf, 1.0, 7.0]), st.integers(0, 5)), min_size=1, max_size=7))
@settings(max_examples=80, deadline=None)
def test_forward_backward_equals_all_paths(spec):
    """Against the sum over all paths, one normal row before and after."""
    n, model = len(spec), an.SpikeModel(stuck_rows=3)
    repeats = np.array([i > 0 and r for i, (r, _, _) in enumerate(spec)])
    run = np.array([1 + (repeats[i] or (i + 1 < n and repeats[i + 1])) for i in range(n)])
    broken = np.array([k == 0 for _, _, k in spec])
    evidence = np.array([e for _, e, _ in spec])
    got = an.posteriors(np.ones(n, np.int64), an.Channel(evidence, repeats, run, broken, np.full(n, 0.3), np.full(n, 2e-3)), model)
    q, up, broke, leave = 0.3, 2e-3, model.broken_rate, model.leave
    stay = 1 - up - broke
    stick = (q * stay) ** (model.stuck_rows - 1.5)

    def move(a, b, r):
        normal, begin = [stay, leave, stay, leave, leave][a], stick * (1 if b == 2 else broke)
        if a in (2, 4) and r:
            return {2: [1 - broke, broke], 4: [leave, 1 - leave]}[a][(b == 4)] if b in (2, 4) else 0.0
        if b in (2, 4):
            return 0.0 if r else begin
        return [normal, 1 - leave if a == 1 else up, None, 1 - leave if a in (3, 4) else broke][b]

    def emit(i, b):
        odds = q if repeats[i] else 1.0
        return [odds * (not broken[i]), odds * np.exp(evidence[i]) * (not broken[i]), float(run[i] > 1 and not broken[i]), odds * broken[i], float(run[i] > 1 and broken[i])][b]

    total = np.zeros((n, 5))

    def go(i, a, weight, path):
        if not weight:
            return
        if i == n:
            for j, b in enumerate(path):
                total[j, b] += weight * move(a, 0, False)
            return
        for b in range(5):
            go(i + 1, b, weight * move(a, b, repeats[i]) * emit(i, b), [*path, b])

    go(0, 0, 1.0, [])
    assert np.allclose(got, total / total.sum(axis=1, keepdims=True), atol=1e-9)


def test_usual_step_does_not_depend_on_stored_order(spark):
    rows = _walk(3000) + _walk(5, seed=2, symbol=2) + [[3, 1, 0, None, None, 1, 1, None]]
    rows += [[*r[:1], r[1] * 10_000, *r[2:]] for r in _walk(40, seed=3, symbol=4)]  # a block each
    rows += rows[100:130]
    steps = {}
    for symbol in (1, 2, 4):
        mine = {r[1]: r for r in rows if r[0] == symbol}
        prices = [[mine[q][c] for q in sorted(mine)] for c in (3, 4)]
        changes = sorted(abs(b - a) for p in prices for a, b in zip(p, p[1:]) if a != b)
        steps[symbol] = float(changes[(len(changes) + 1) // 2 - 1])
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame([tuple(r) for r in rows], L1).repartition(60)
    for block in (8192, 16):
        got = an.source_scales(df, an.SpikeModel(block=block)).collect()
        assert {r.symbol_id: r.step for r in got if r.step is not None} == steps


def test_impossible_readings_without_a_place_are_flagged(spark):
    good, bad = (7, 9, 5, 6, None), [(0, 9, 5, 6, None), (7, 9_999_999_999, 5, 6, None), (9, 9, 5, 6, None), (7, 9, -1, 6, None), (None, None, None, -1, None)]
    places = [(None, 1, 5), (1, None, 5), (1, 1, None)]
    rows = [(*p, *g) for p in places for g in (good, *bad, bad[0])] + [(1, 2, 5, *good), (None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, L1)
    for only in (True, False):
        got = an.flag_readings(df, flagged_only=only).collect()
        lost = [r for r in got if None in (r.symbol_id, r.sequence, r.timestamp_ns)]
        assert sorted(map(str, ((r[:7]) for r in lost))) == sorted(str((*p, *b[:4])) for p in places for b in bad)
        assert all(r.out_of_range and not r.spike and not r.stuck for r in lost) and len(got) - len(lost) == (0 if only else 1)


# --- 3: grid ----------------------------------------------------------------------

INSTRUMENTS = "symbol_id long, grid_ms long"


def test_missing_cells_are_exactly_those_without_readings(spark):
    rng = random.Random(3)
    rows, width = [], 1_000_000_000
    for s in (1, 2):
        for _ in range(300):
            rows.append((s, rng.randrange(100), rng.choice([0, an.DAY_NS]) + rng.randrange(600) * width + rng.randrange(width), 1000 + rng.randrange(9), 1010, 1, 1, None))
    rows.append((1, 0, 700 * width, None, 5, 1, 1, None))
    df, inst = spark.createDataFrame(rows, L1), spark.createDataFrame([(1, 1000), (2, 1000), (3, 1000)], INSTRUMENTS)
    want = set()
    for s in (1, 2):
        for day in (0, 1):
            cells = {r[2] // width for r in rows if r[0] == s and r[2] // an.DAY_NS == day and r[3] is not None}
            want |= {(s, c * width) for c in range(min(cells), max(cells) + 1) if c not in cells}
    for model in (SpectrumModel(), SpectrumModel(block=64, halo=16, window=8)):
        got = regular_grid(df, inst, model).collect()
        missing = {(r.symbol_id, r.cell_start_ns) for r in got if r.fill in ("ssa", "level")}
        assert missing == want and len(got) == len({(r.symbol_id, r.cell_start_ns) for r in got})
        assert all(r.bid is not None and 1000 <= r.bid <= 1008 for r in got)


def test_sources_that_end_near_a_block_border_do_not_mix(spark):
    rng, s = random.Random(8), 1_000_000_000
    rows, want = [], set()
    for symbol in range(60):
        cells = sorted(rng.sample(range(64), 40))
        rows += [(symbol, i, c * s, 10, 20, 1, 1, None) for i, c in enumerate(cells)]
        want |= {(symbol, c * s) for c in range(cells[0], cells[-1]) if c not in cells}
    inst = spark.createDataFrame([(k, 1000) for k in range(60)], INSTRUMENTS)
    got = regular_grid(spark.createDataFrame(rows, L1), inst, SpectrumModel(block=64, halo=32, window=4)).where("fill IN ('ssa', 'level')")
    assert {(r.symbol_id, r.cell_start_ns) for r in got.collect()} == want


def test_grid_values_equal_plain_replacement_until_it_settles(spark):
    """The filled values against a plain loop that runs until nothing moves."""
    rng, s = np.random.default_rng(3), 1_000_000_000
    t = np.arange(300)
    x = np.round(1000 + 40 * np.sin(t / 11.0) + 15 * np.cos(t / 5.0) + rng.normal(0, 1, 300))
    gone = np.zeros(300, bool)
    gone[[5, 6, 90, 91, 92, 93, 94, 180, 200, 201, 202]] = True
    rows = [(1, i, i * s, int(v), int(v) + 10, 1, 1, None) for i, v in enumerate(x) if not gone[i]]
    rows += [(1, 1000, 20 * s + 1, 500_000, 600_000, 1, 1, None), (1, 1001, 20 * s + 2, int(x[20]), int(x[20]) + 10, 1, 1, None)]  # a spike among others of its cell
    model = SpectrumModel(window=20)
    got = {r.cell_start_ns // s: r for r in regular_grid(spark.createDataFrame(rows, L1), spark.createDataFrame([(1, 1000)], INSTRUMENTS), model).collect()}
    known = np.flatnonzero(~gone)
    z = np.interp(t, known, x[known])
    middle = np.median(x[known])
    for _ in range(5000):
        h = np.array([z[i : i + 20] - middle for i in range(281)])
        u, d, v = np.linalg.svd(h, full_matrices=False)
        part = (u[:, :3] * d[:3]) @ v[:3]
        back = np.array([np.mean([part[i - j, j] for j in range(20) if 0 <= i - j < 281]) for i in range(300)]) + middle
        moved = np.abs(back[gone] - z[gone]).max()
        z[gone] = back[gone]
        if moved < 1e-4:
            break
    assert all(r.settled for r in got.values()) and got[20].bid == x[20]
    assert np.abs(np.array([got[i].bid for i in np.flatnonzero(gone)]) - z[gone]).max() < 0.5
    assert all(got[i].fill == ("ssa" if gone[i] else "reading") for i in t)


def test_marks_of_gaps_do_not_depend_on_blocks(spark):
    s = 1_000_000_000
    cells = [*range(100), *range(140, 200), *range(215, 300), 420]
    rows = [(1, i, c * s, 1000 + c % 7, 1010 + c % 7, 1, 1, None) for i, c in enumerate(cells)]
    df, inst = spark.createDataFrame(rows, L1), spark.createDataFrame([(1, 1000)], INSTRUMENTS)
    for block in (37, 64, 4096):
        got = {r.cell_start_ns // s: r.fill for r in regular_grid(df, inst, SpectrumModel(block=block, halo=30, window=6)).collect()}
        assert {c for c, f in got.items() if f == "level"} == {*range(100, 140), *range(301 - 1, 420)}
        assert {c for c, f in got.items() if f == "ssa"} == set(range(200, 215))


def test_grid_edge_cases(spark):
    inst = spark.createDataFrame([(1, 1000), (2, 0), (3, None), (None, 1000), (4, 1000), (5, 1)], INSTRUMENTS)
    s = 1_000_000_000
    rows = [(1, 1, -1, 5, 6, 1, 1, None), (1, 1, -1, 5, 6, 1, 1, None), (2, 1, 1, 5, 6, 1, 1, None), (3, 1, 1, 5, 6, 1, 1, None), (9, 1, 1, 5, 6, 1, 1, None), (4, 1, 0, -5, 6, 1, 1, None), (4, 2, 2 * s, -5, 8, 1, 1, None)]
    rows += [(5, 1, 0, 10, 20, 1, 1, None), (5, 2, 20 * s, 20, 30, 1, 1, None)]
    got = regular_grid(spark.createDataFrame(rows, L1), inst).collect()
    one = [r for r in got if r.symbol_id == 1]
    assert [(r.cell_start_ns, r.day, r.fill) for r in one] == [(-s, -1, "reading")]
    four = sorted((r.cell_start_ns, r.fill, r.bid, r.ask) for r in got if r.symbol_id == 4)
    assert [f[1] for f in four] == ["implausible", "level", "implausible"] and [f[2] for f in four] == [None] * 3
    five = sorted((r.cell_start_ns, r.fill, r.bid) for r in got if r.symbol_id == 5)
    assert len(five) == 20_001 and five[10_000][1] == "level" and five[10_000][2] == pytest.approx(15, abs=0.1)
    assert {r.symbol_id for r in got} == {1, 4, 5}
    assert regular_grid(spark.createDataFrame([], L1), inst).count() == 0


def test_imputation_follows_a_wave():
    t = np.arange(400)
    x = 100 + 5 * np.sin(t / 9.0)
    missing = np.zeros(400, bool)
    missing[100:108] = missing[250:262] = True
    seen = np.where(missing, np.nan, x)
    got = impute(seen, missing, SpectrumModel(rounds=200, settled=1e-8))
    line = np.interp(t, t[~missing], x[~missing])
    assert np.abs(got - x)[missing].max() < 0.5 * np.abs(line - x)[missing].max()
    assert (got[~missing] == x[~missing]).all()
    assert np.isnan(impute(np.full(5, np.nan), np.ones(5, bool), SpectrumModel())).all()
    assert (impute(np.array([1.0, np.nan, 1.0]), np.array([False, True, False]), SpectrumModel()) == 1).all()


# --- 5: deliveries ----------------------------------------------------------------

TICKS = "delivery_id long, symbol string, update_id long, event_time string, time_unit string, received_at timestamp, payload string"


def test_units_of_time(spark):
    rows = [("1709539200.055", "s"), ("1709539200055", "ms"), ("1709539200055000", "us"), ("1709539200055000000", "ns"), (" 1709539200055.0 ", "ms"), ("x", "ms"), ("1", "h"), (None, "s"), ("1", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, u string").select(instant_ns("t", "u")).collect()]
    assert got == [1709539200055000000] * 5 + [None] * 4


def test_one_copy_of_each_message(spark):
    rows = [(5, "A", 1, "1.5", "s", None, "b"), (2, "A", 1, "1500", "ms", None, "a"), (9, "A", 1, "1500", "ms", None, "c"), (3, "A", 1, "1501", "ms", None, "d"), (4, "B", 1, "1500", "ms", None, "e"), (6, None, 1, "1500", "ms", None, "f"), (7, None, 1, "1500", "ms", None, "g"), (8, "A", 1, "late", "ms", None, "h"), (10, "A", None, "1", "s", None, "i")]
    df = spark.createDataFrame(rows, TICKS)
    keys = {"symbol": F.col("symbol"), "update_id": F.col("update_id"), "ns": instant_ns("event_time", "time_unit")}
    kept = first_deliveries(df, keys, ("delivery_id",))
    assert kept.columns == df.columns and sorted(r.delivery_id for r in kept.collect()) == [2, 3, 4, 6, 7, 8, 10]
    assert sorted(r[0] for r in superfluous_deliveries(df, keys, ("delivery_id",), "delivery_id").collect()) == [5, 9]
    clash = df.withColumn("__delivery_order", F.lit(1)).withColumn("copies", F.lit(1))
    assert first_deliveries(clash, keys, ("delivery_id",)).count() == 7
    empty = df.limit(0)
    assert first_deliveries(empty, keys, ("delivery_id",)).count() == 0 and superfluous_deliveries(empty, keys, ("delivery_id",), "delivery_id").count() == 0


def test_a_hot_message_is_split(splitting):
    spark, n = splitting, 60_000
    df = spark.range(n).select(F.col("id").alias("delivery_id"), F.when(F.col("id") % 20 == 0, F.col("id") % 50).otherwise(-1).alias("update_id"), F.hash("id").alias("received_at"))
    got, plan = _ran(superfluous_deliveries(df, {"update_id": F.col("update_id")}, ("delivery_id", "received_at"), "delivery_id"))
    assert got == n - 6 and "skew=true" in plan  # six messages
