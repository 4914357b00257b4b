import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from larkspread.session import local_session

    session = local_session(cores=4, shuffle_partitions=4, name="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


QUOTES = "symbol_id long, sequence long, timestamp_ns long, bid long, ask long, bid_qty long, ask_qty long"


@pytest.fixture
def quotes(spark):
    """Quotes from (bid, ask, bid_qty, ask_qty[, ns]) tuples of one source."""

    def make(books, symbol=1):
        rows = [(symbol, i, b[4] if len(b) > 4 else i * 10, *b[:4]) for i, b in enumerate(books)]
        return spark.createDataFrame(rows, QUOTES)

    return make
