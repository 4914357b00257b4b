import pytest
from pyspark.sql import functions as F

from larkspread.config import BookPolicy, RowPolicy, StateSpace, book_ticker_layout, level_file_layout, named_layout
from larkspread.errors import BadRow, BadSchema, InvalidBook, InvalidConfig
from larkspread.operators.transitions import count_transitions, transitions
from larkspread.sources.delimited import message_times, read_delimited, read_level_pair
from larkspread.sources.quotes import event_quotes, read_quotes, write_quotes
from larkspread.sources.synthetic import SyntheticFeed, synthetic_quotes
from larkspread.streaming.counts import count_stream, record_once, stored_counts, stream_quotes

HEAD = "update_id,best_bid_price,best_bid_qty,best_ask_price,best_ask_qty,transaction_time,event_time\n"
SEVEN = HEAD + (
    "1,100.0,2.5,100.1,1.0,1,1700000000125\n"
    "2,100.2,1.0,100.1,1.0,1,1700000000126\n"
    "3,0,1.0,100.1,1.0,1,1700000000127\n"
    "\n"
    "4,100.05,1.0,100.1,1.0,1,1700000000128\n"
    "5,100.0,x,100.1,1.0,1,1700000000129\n"
    "6,100.0,2.5,100.1,1.0,1,1700000000120\n"
    "7,100.0,2.5,100.1,1.5,1,1700000000130\n"
)


def _file(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_skipped_rows_are_counted_by_reason(spark, tmp_path):
    read = read_delimited(spark, _file(tmp_path, "a.csv", SEVEN), book_ticker_layout(0.1, on_invalid=RowPolicy.SKIP))
    a = read.audit().first()
    assert (a.rows_read, a.kept) == (7, 2)
    assert (a.crossed_or_locked, a.empty_level, a.off_grid, a.unparsable, a.time_decreased) == (1, 1, 1, 1, 1)
    rows = read.quotes().orderBy("sequence").collect()
    assert (rows[0].bid, rows[0].ask, rows[0].bid_qty, rows[0].timestamp_ns) == (2000, 2002, 250_000_000, 1_700_000_000_125_000_000)
    assert [r.sequence for r in rows] == [0, 1]


def test_first_bad_line_is_named(spark, tmp_path):
    with pytest.raises(BadRow, match="line 3: crossed_or_locked"):
        read_delimited(spark, _file(tmp_path, "a.csv", SEVEN), book_ticker_layout(0.1))


def test_unchanged_books_and_the_limit(spark, tmp_path):
    rows = [f"{i},100.0,{q},100.1,1.0,1,{1700000000000 + i}\n" for i, q in enumerate([1.0, 1.0, 2.0, 2.0, 3.0, 4.0])]
    path = _file(tmp_path, "a.csv", HEAD + "".join(rows) + "bad\n")
    a = read_delimited(spark, path, book_ticker_layout(0.1, drop_unchanged=True, on_invalid=RowPolicy.SKIP)).audit().first()
    assert (a.kept, a.unchanged, a.unparsable) == (4, 2, 1)
    cut = read_delimited(spark, path, book_ticker_layout(0.1, drop_unchanged=True, max_events=2))
    a = cut.audit().first()
    assert (a.rows_read, a.kept, a.unchanged, a.stopped) == (5, 2, 2, 1)
    assert cut.quotes().count() == 2


def test_sequential_steps_equal_brute_force(spark, tmp_path):
    import random

    rng = random.Random(4)
    lines, t = [], 1000
    for i in range(400):
        t += rng.choice([-3, 0, 1, 2])
        lines.append(f"{i},{rng.choice(['100.0', '100.1', 'x'])},{rng.choice([1, 1, 2])},100.2,1,1,{t}\n")
    high, last, want = None, None, []
    for line in lines:
        _, bid, bq, _, _, _, at = line.split(",")
        at = int(at)
        if bid == "x":
            want.append("unparsable")
        elif high is not None and at < high:
            want.append("time_decreased")
        else:
            high = at
            want.append("unchanged" if (bid, bq) == last else "kept")
            last = (bid, bq)
    read = read_delimited(spark, _file(tmp_path, "a.csv", HEAD + "".join(lines)), book_ticker_layout(0.1, drop_unchanged=True, on_invalid=RowPolicy.SKIP))
    assert [r.status for r in read.rows.orderBy("line_no").collect()] == want


def test_level_pair(spark, tmp_path):
    levels = _file(tmp_path, "l.csv", "5859400,200,5853300,18,1,1\n9999999999,0,5853300,18,1,1\n5859500,100,5853300,18,1,1\n")
    times = _file(tmp_path, "m.csv", "34200.017459617,5,0,1,2238200,-1\n34200.1,1,1,1,1,1\n34200.2,1,1,1,1,1\n")
    rows = read_level_pair(spark, levels, times, level_file_layout(0.01, on_invalid=RowPolicy.SKIP)).quotes().orderBy("sequence").collect()
    assert [(r.ask, r.bid) for r in rows] == [(117188, 117066), (117190, 117066)]
    assert rows[0].timestamp_ns == 34_200_017_459_617 and rows[1].timestamp_ns == 34_200_200_000_000
    with pytest.raises(BadSchema, match="3 level rows but 2"):
        read_level_pair(spark, levels, _file(tmp_path, "s.csv", "1,1\n2,1\n"), level_file_layout(0.01, on_invalid=RowPolicy.SKIP))
    with pytest.raises(BadRow, match="line 2"):
        message_times(spark, _file(tmp_path, "x.csv", "1.5,1\nnone,2\n"))


def test_named_layout_in_seconds_and_missing_columns(spark, tmp_path):
    path = _file(tmp_path, "g.csv", "TIMESTAMP,bid_price,bid_qty,ask_price,ask_qty\n1.5,10.00,1,10.01,1\n")
    assert read_delimited(spark, path, named_layout(0.01, time_unit="s")).quotes().first().timestamp_ns == 1_500_000_000
    with pytest.raises(BadSchema, match="clock"):
        read_delimited(spark, path, named_layout(0.01, time="clock"))


def test_parquet_round_trip_and_checks(spark, tmp_path):
    good = spark.createDataFrame([(1, i, i, 10, 12, 1, 1) for i in range(5)], "symbol_id long, sequence long, timestamp_ns long, bid long, ask long, bid_qty long, ask_qty long")
    write_quotes(good, str(tmp_path / "q"))
    assert sorted(map(tuple, read_quotes(spark, str(tmp_path / "q")).collect())) == sorted(map(tuple, good.collect()))
    bad = good.withColumn("ask", F.when(F.col("sequence") == 2, 9).otherwise(F.col("ask")).cast("long"))
    write_quotes(bad, str(tmp_path / "b"))
    with pytest.raises(InvalidBook, match="row 2"):
        read_quotes(spark, str(tmp_path / "b"))
    assert read_quotes(spark, str(tmp_path / "b"), BookPolicy.ALLOW_ALL).count() == 5
    spark.read.parquet(str(tmp_path / "q")).withColumn("bid_qty", F.col("bid_qty").cast("double")).write.parquet(str(tmp_path / "t"))
    with pytest.raises(BadSchema, match="bid_qty"):
        read_quotes(spark, str(tmp_path / "t"))
    spark.read.parquet(str(tmp_path / "q")).drop("sequence").write.parquet(str(tmp_path / "m"))
    with pytest.raises(BadSchema, match="sequence"):
        read_quotes(spark, str(tmp_path / "m"))


def test_unsigned_parquet_is_read(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    kinds = {"timestamp_ns": pa.uint64(), "sequence": pa.uint64(), "symbol_id": pa.uint32(), "bid_price_ticks": pa.int64(), "bid_qty": pa.uint64(), "ask_price_ticks": pa.int64(), "ask_qty": pa.uint64(), "more": pa.string()}
    values = {"timestamp_ns": [1], "sequence": [1], "symbol_id": [7], "bid_price_ticks": [10], "bid_qty": [3], "ask_price_ticks": [12], "ask_qty": [4], "more": ["x"]}
    pq.write_table(pa.table({c: pa.array(values[c], type=k) for c, k in kinds.items()}), tmp_path / "u.parquet")
    assert tuple(read_quotes(spark, str(tmp_path / "u.parquet")).first()) == (7, 1, 1, 10, 12, 3, 4)
    values["bid_qty"] = [2**63 + 1]
    pq.write_table(pa.table({c: pa.array(values[c], type=k) for c, k in kinds.items()}), tmp_path / "v.parquet")
    with pytest.raises(InvalidBook):
        read_quotes(spark, str(tmp_path / "v.parquet"))


def test_synthetic_feed_keeps_its_promises(spark):
    a = synthetic_quotes(spark, 3000, 5, symbols=2)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, synthetic_quotes(spark, 3000, 5, symbols=2).collect()))
    assert a.where("ask - bid <> 2 OR bid_qty + ask_qty = 0 OR bid_qty < 0 OR ask_qty < 0").count() == 0
    assert a.where("timestamp_ns <> sequence * 100000").count() == 0 and a.count() == 6000
    assert sorted(map(tuple, a.collect())) != sorted(map(tuple, synthetic_quotes(spark, 3000, 6, symbols=2).collect()))
    with pytest.raises(InvalidConfig):
        SyntheticFeed(arrival=0.9, move=0.2)


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    rows = event_quotes(spark, "/root/testdata/sf0.001")
    for k, (low, high) in enumerate([(0, 333), (333, 700), (700, 10_000)]):
        write_quotes(rows.where(f"sequence >= {low} AND sequence < {high}").coalesce(1), str(tmp_path / f"part{k}"))
    landing = tmp_path / "landing"
    landing.mkdir()
    for k in range(3):
        file = next((tmp_path / f"part{k}").glob("*.parquet"))
        file.rename(landing / f"{k}.parquet")
        count_stream(stream_quotes(spark, str(landing)), StateSpace(), str(tmp_path / "store"), str(tmp_path / "state")).awaitTermination()  # a restart each time
    got = sorted(map(tuple, stored_counts(spark, str(tmp_path / "store")).collect()))
    assert got == sorted(map(tuple, count_transitions(transitions(rows, StateSpace())).collect()))


def test_recorder_drops_what_is_not_newer(spark, tmp_path):
    spark.createDataFrame([("A", 1), ("A", 2), ("A", 2), ("B", 1)], "symbol string, update_id long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = record_once(spark.readStream.schema("symbol string, update_id long").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("recorded").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("recorded").collect())) == [("A", 1), ("A", 2), ("B", 1)]


def test_command_line(tmp_path, spark, capsys):
    from larkspread.cli import run

    assert run(["train", "--events", "1500", "--buckets", "4", "--bounds", "", "--output", str(tmp_path / "m")]) == 0
    assert run(["predict", "--model", str(tmp_path / "m"), "--bid", "100", "--ask", "102", "--bid-qty", "5", "--ask-qty", "7"]) == 0
    assert '"mid": 101' in capsys.readouterr().out
    assert run(["predict", "--model", str(tmp_path / "m"), "--bid", "102", "--ask", "102", "--bid-qty", "5", "--ask-qty", "7"]) == 1
    assert run(["inspect", "--model", str(tmp_path / "m")]) == 0
    assert run(["benchmark", "--model", str(tmp_path / "m"), "--books", "100"]) == 0
    rows = "".join(f"{i},{100 + i % 5 / 10:.1f},{1 + 37 * i % 90},{100.1 + i % 5 / 10:.1f},{1 + 53 * i % 90},1,{1700000000000 + 10 * i}\n" for i in range(600))
    path = _file(tmp_path, "big.csv", HEAD + rows)
    assert run(["evaluate-csv", "--input", path, "--tick-size", "0.1", "--horizons", "1,5", "--primary", "5", "--resamples", "50", "--wall-clock-ms", "50", "--report-md", str(tmp_path / "r/x.md")]) == 0
    text = (tmp_path / "r/x.md").read_text()
    assert "Training rows 420, test rows 180" in text and "50 ms" in text
    write_quotes(read_delimited(spark, path, book_ticker_layout(0.1)).quotes(), str(tmp_path / "pq"))
    assert run(["evaluate-parquet", "--input", str(tmp_path / "pq"), "--horizons", "1,5", "--primary", "5", "--resamples", "50", "--wall-clock-ms", "50", "--report-md", str(tmp_path / "r/y.md")]) == 0
    strip = lambda t: t[t.index("## Model") :]
    assert strip((tmp_path / "r/y.md").read_text()) == strip(text)
