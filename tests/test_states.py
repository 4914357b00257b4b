import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspread.config import BookPolicy, CsvLayout, EvaluationPlan, Smoothing, StateSpace, parse_bounds
from larkspread.errors import InvalidConfig
from larkspread.functions import book


def test_state_of_a_known_book():
    assert StateSpace(4, (1, 2)).encode(1, 300, 100) == 3


@pytest.mark.parametrize("spread,row", [(1, 0), (2, 1), (3, 2), (4, 2), (5, 3), (10**6, 3)])
def test_spread_rows(spread, row):
    assert StateSpace(1, (1, 2, 4)).encode(spread, 1, 1) == row


@pytest.mark.parametrize("spread", [0, -3])
def test_spread_out_of_range(spread):
    with pytest.raises(InvalidConfig):
        StateSpace(4, (1,)).encode(spread, 1, 1)


@given(st.integers(1, 40), st.lists(st.integers(1, 50), max_size=5, unique=True), st.integers(1, 100), st.integers(0, 10**12), st.integers(1, 10**12))
def test_states_stay_in_range_and_mirror_is_its_own_inverse(n, bounds, spread, b, a):
    space = StateSpace(n, tuple(sorted(bounds)))
    s = space.encode(spread, b, a)
    assert 0 <= s < space.size
    assert space.mirror(space.mirror(s)) == s
    k, row, low, high, lo, hi = space.describe(s)
    assert lo <= spread and (hi is None or spread <= hi) and row * n + k == s


@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(-3, 12), st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=40))
@settings(max_examples=5, deadline=None)
def test_columns_agree_with_the_scalar_form(spark, books):
    space = StateSpace(4, (1, 2, 4))
    rows = [(b, b + s, bq, aq) for b, s, bq, aq in books]
    df = spark.createDataFrame(rows, "bid long, ask long, bid_qty long, ask_qty long")
    got = df.select("bid", "ask", "bid_qty", "ask_qty", book.state(space).alias("s"), book.no_state_reason().alias("why"), book.mid().alias("m")).collect()
    for r in got:
        spread = r.ask - r.bid
        if spread < 1:
            assert r.s is None and r.why == "spread_out_of_range"
        elif r.bid_qty + r.ask_qty == 0:
            assert r.s is None and r.why == "empty_book"
        else:
            assert r.s == space.encode(spread, r.bid_qty, r.ask_qty) and r.why is None
        assert r.m == int((r.bid + r.ask) / 2)


def test_imbalance_edges_and_mids(spark):
    df = spark.createDataFrame([(10000, 10001, 0, 5), (10000, 10001, 5, 0), (10000, 10001, 0, 0)], "bid long, ask long, bid_qty long, ask_qty long")
    got = df.select(book.imbalance().alias("i"), book.mid().alias("m"), book.exact_mid().alias("e"), book.imbalance_bucket(StateSpace(10)).alias("k")).collect()
    assert [r.i for r in got] == [0.0, 1.0, None]
    assert [r.k for r in got] == [0, 9, None]
    assert got[0].m == 10000 and got[0].e == 10000.5


def test_policies(spark):
    df = spark.createDataFrame([(1, 2), (2, 2), (3, 2)], "bid long, ask long")
    assert [df.where(book.valid(p)).count() for p in BookPolicy] == [1, 2, 3]


def test_settings_are_checked():
    for bad in (lambda: StateSpace(0), lambda: StateSpace(2, (0,)), lambda: StateSpace(2, (2, 2)), lambda: Smoothing(-1), lambda: Smoothing(float("nan"))):
        with pytest.raises(InvalidConfig):
            bad()
    with pytest.raises(InvalidConfig):
        CsvLayout("a", "b", "c", "d", "t", tick_size=0)
    with pytest.raises(InvalidConfig):
        EvaluationPlan(horizons=(1, 2), primary=3)
    assert parse_bounds("") == () and parse_bounds("1, 2,4") == (1, 2, 4)
    with pytest.raises(InvalidConfig):
        parse_bounds("1,x")
