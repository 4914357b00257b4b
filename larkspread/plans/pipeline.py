"""Queries of the general training-data operators (problems 1, 2, 3 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspread.functions.instants import instant_ns
from larkspread.operators.anomalies import flag_readings
from larkspread.operators.dedup import first_deliveries, superfluous_deliveries
from larkspread.operators.grid import regular_grid
from larkspread.operators.parse_lines import parse_lines, quotes_of, rejects_of
from larkspread.tables import table


def message_keys() -> dict:
    """Identity of a book-ticker message: symbol, update id and the instant."""
    return {"symbol": F.col("symbol"), "update_id": F.col("update_id"), "event_ns": instant_ns("event_time", "time_unit")}


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Superfluous deliveries."""
    return superfluous_deliveries(table(spark, folder, "book_ticker"), message_keys(), ("delivery_id", "received_at"), "delivery_id")


def p5_messages(spark: SparkSession, folder: str) -> DataFrame:
    """One copy of each message, the one received first."""
    rows = first_deliveries(table(spark, folder, "book_ticker"), message_keys(), ("delivery_id", "received_at"))
    return rows.withColumn("event_ns", instant_ns("event_time", "time_unit")).drop("received_at")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that do not parse."""
    return rejects_of(parse_lines(table(spark, folder, "ticker_lines"))).select("line_id")


def p1_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that parse, as typed quotes."""
    return quotes_of(parse_lines(table(spark, folder, "ticker_lines"))).drop("raw_line")


def p1_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Number of rejected lines by reason."""
    return rejects_of(parse_lines(table(spark, folder, "ticker_lines"))).groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with implausible readings."""
    return flag_readings(table(spark, folder, "l1_quotes"), flagged_only=True).select("symbol_id", "sequence")


def p2_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Number of flagged rows by symbol and kind of flag."""
    rows = flag_readings(table(spark, folder, "l1_quotes"))
    return rows.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(k).alias(k) for k in ("spike", "stuck", "out_of_range")])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Grid cells without a reading."""
    return p3_grid(spark, folder).where("fill IN ('ssa', 'level')").select("symbol_id", "cell_start_ns")


def p3_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The regular series of every symbol and day."""
    return regular_grid(table(spark, folder, "l1_quotes"), table(spark, folder, "instruments"))


_NS = """CAST(trunc(CASE time_unit WHEN 's' THEN CAST(event_time AS DECIMAL(38,9)) * 1000000000
 WHEN 'ms' THEN CAST(event_time AS DECIMAL(38,9)) * 1000000 WHEN 'us' THEN CAST(event_time AS DECIMAL(38,9)) * 1000
 WHEN 'ns' THEN CAST(event_time AS DECIMAL(38,9)) END) AS BIGINT)"""

_COLUMNS = ("update_id", "best_bid_price", "best_bid_qty", "best_ask_price", "best_ask_qty", "transaction_time", "event_time")
_NUMBER = "^[+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?$"
_QUOTING = '("([^"]|"")*"|[^",]*)'
_PARSED = f"""WITH raw AS (SELECT *, CASE WHEN right(raw_line, 1) = chr(13) THEN left(raw_line, length(raw_line) - 1) ELSE raw_line END AS line FROM ticker_lines),
 heads AS (SELECT feed_file, list_transform(string_split(line, ','), lambda x: lower(trim(x))) AS names FROM raw WHERE line_no = 1),
 cut AS (SELECT line_id, feed_file, line_no, line, names, regexp_full_match(line, '{_QUOTING}(,{_QUOTING})*') AS legal,
  list_transform(regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^",]*)', 1),
   lambda v: trim(CASE WHEN left(v, 1) = '"' THEN replace(substr(v, 2, length(v) - 2), '""', '"') ELSE v END, ' ')) AS f
  FROM raw JOIN heads USING (feed_file)
  WHERE regexp_matches(line, '[^[:space:]]') AND NOT list_has_all(list_transform(string_split(line, ','), lambda x: lower(trim(x))), ['update_id', 'event_time'])),
 named AS (SELECT line_id, feed_file, line_no, coalesce(legal, FALSE) AND len(f) = len(names) AS shaped, {", ".join(f"f[list_position(names, '{c}')] AS {c}" for c in _COLUMNS)} FROM cut),
 judged AS (SELECT *, shaped AND {" AND ".join(f"regexp_matches(coalesce({c}, ''), '{_NUMBER}')" for c in _COLUMNS)} AS numeric FROM named),
 done AS (SELECT *, numeric AND {" AND ".join(f"TRY_CAST({c} AS DOUBLE) > 0 AND TRY_CAST({c} AS DOUBLE) < 9999999999" for c in ("best_bid_price", "best_ask_price"))}
  AND {" AND ".join(f"isfinite(TRY_CAST({c} AS DOUBLE)) AND TRY_CAST({c} AS DOUBLE) >= 0" for c in ("best_bid_qty", "best_ask_qty"))} AS good FROM judged)"""

def _excursion_sql() -> str:
    """The row lies in an excursion of one to three rows that comes back."""
    at = lambda k: f"x{k}" if k >= 0 else f"m{-k}"
    tests = []
    for length in range(1, 4):
        for k in range(length):
            before, after = at(-k - 1), at(length - k)
            out = "least(" + ", ".join(f"abs({at(j)} - {b})" for j in range(-k, length - k) for b in (before, after)) + ")"
            tests.append(f"({out} >= 20 * step AND abs({before} - {after}) * 4 < {out})")
    return " OR ".join(tests)


_P2 = f"""WITH q AS (SELECT DISTINCT symbol_id, sequence, timestamp_ns // 86400000000000 AS day, bid_price_ticks AS b, ask_price_ticks AS a, bid_qty AS bq, ask_qty AS aq FROM l1_quotes),
 bad AS (SELECT symbol_id, sequence FROM q WHERE b <= 0 OR a <= 0 OR b >= 9999999999 OR a >= 9999999999 OR a <= b OR bq < 0 OR aq < 0),
 w AS (SELECT *, b IS NOT NULL AND a IS NOT NULL AND bq IS NOT NULL AND aq IS NOT NULL AS whole FROM q),
 s AS (SELECT *, whole AND lag(whole) OVER o AND b = lag(b) OVER o AND bq = lag(bq) OVER o AS sb, whole AND lag(whole) OVER o AND a = lag(a) OVER o AND aq = lag(aq) OVER o AS sa
  FROM w WINDOW o AS (PARTITION BY symbol_id, day ORDER BY sequence)),
 r AS (SELECT *, sum(CASE WHEN sb THEN 0 ELSE 1 END) OVER o AS rb, sum(CASE WHEN sa THEN 0 ELSE 1 END) OVER o AS ra FROM s WINDOW o AS (PARTITION BY symbol_id, day ORDER BY sequence)),
 stuck AS (SELECT symbol_id, sequence FROM (SELECT symbol_id, sequence, whole, count(*) OVER (PARTITION BY symbol_id, day, rb) AS nb, count(*) OVER (PARTITION BY symbol_id, day, ra) AS na FROM r)
  WHERE whole AND (nb >= 12 OR na >= 12)),
 p AS (SELECT symbol_id, day, sequence, 1 AS side, b AS x FROM q WHERE b > 0 AND b < 9999999999 UNION ALL SELECT symbol_id, day, sequence, 2, a FROM q WHERE a > 0 AND a < 9999999999),
 d AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY symbol_id, day, side ORDER BY sequence)) AS d FROM p),
 st AS (SELECT symbol_id, median(d) AS step FROM d WHERE d > 0 GROUP BY symbol_id),
 l AS (SELECT p.*, step, x AS x0, {", ".join(f"lag(x, {k}) OVER o AS m{k}, lead(x, {k}) OVER o AS x{k}" for k in (1, 2, 3))} FROM p JOIN st USING (symbol_id)
  WINDOW o AS (PARTITION BY symbol_id, day, side ORDER BY sequence)),
 spike AS (SELECT symbol_id, sequence FROM l WHERE {_excursion_sql()}),
 z AS (SELECT symbol_id, day, quantile_disc(bq, 0.95) FILTER (bq > 0) AS ub, quantile_disc(aq, 0.95) FILTER (aq > 0) AS ua FROM q GROUP BY symbol_id, day),
 big AS (SELECT symbol_id, sequence FROM q JOIN z USING (symbol_id, day) WHERE bq >= 8 * ub OR aq >= 8 * ua)
 SELECT * FROM bad UNION SELECT * FROM stuck UNION SELECT * FROM spike UNION SELECT * FROM big"""

# the same rows by kind: an impossible channel is no spike
_P2_KINDS = _P2.split(" SELECT * FROM bad UNION")[0].replace("spike AS (SELECT symbol_id, sequence FROM l WHERE", "spike AS (SELECT symbol_id, sequence FROM l JOIN (SELECT symbol_id, sequence, a <= b AS crossed FROM q) USING (symbol_id, sequence) WHERE crossed IS NOT TRUE AND") + """
 SELECT symbol_id, count(*) AS rows, count(*) FILTER (spike.sequence IS NOT NULL) AS spike, count(*) FILTER (stuck.sequence IS NOT NULL) AS stuck, count(*) FILTER (bad.sequence IS NOT NULL) AS out_of_range
 FROM q LEFT JOIN (SELECT DISTINCT * FROM (SELECT * FROM spike UNION ALL SELECT * FROM big)) spike USING (symbol_id, sequence) LEFT JOIN stuck USING (symbol_id, sequence) LEFT JOIN bad USING (symbol_id, sequence) GROUP BY 1"""

QUERIES = {"p1_found": p1_found, "p1_quotes": p1_quotes, "p1_reasons": p1_reasons, "p2_found": p2_found, "p2_flags": p2_flags, "p3_found": p3_found, "p3_grid": p3_grid, "p5_found": p5_found, "p5_messages": p5_messages}

ORACLES = {
    "p1_found": _PARSED + " SELECT line_id FROM done WHERE NOT coalesce(good, FALSE)",
    "p1_quotes": _PARSED
    + f""" SELECT line_id, feed_file, line_no, {", ".join(f"CAST(CAST({c} AS DECIMAL(38,6)) AS BIGINT) AS {c}" if c in ("update_id", "transaction_time", "event_time") else f"CAST({c} AS DOUBLE) AS {c}" for c in _COLUMNS)} FROM done WHERE good""",
    "p2_found": _P2,
    "p2_flags": _P2_KINDS,
    "p3_found": """WITH c AS (SELECT DISTINCT symbol_id, timestamp_ns // 86400000000000 AS day, timestamp_ns // (grid_ms * 1000000) AS cell, grid_ms * 1000000 AS w
  FROM l1_quotes JOIN instruments USING (symbol_id) WHERE bid_price_ticks IS NOT NULL AND ask_price_ticks IS NOT NULL),
 g AS (SELECT symbol_id, day, w, unnest(range(min(cell), max(cell) + 1)) AS cell FROM c GROUP BY symbol_id, day, w)
 SELECT symbol_id, cell * w AS cell_start_ns FROM g ANTI JOIN c USING (symbol_id, day, cell)""",
    "p5_found": f"""SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY symbol, update_id, {_NS} ORDER BY delivery_id) AS n
 FROM book_ticker) WHERE n > 1""",
    "p5_messages": f"""SELECT * EXCLUDE (n, received_at) FROM (SELECT *, {_NS} AS event_ns, row_number() OVER (PARTITION BY symbol, update_id, {_NS} ORDER BY delivery_id) AS n
 FROM book_ticker) WHERE n = 1""",
}
