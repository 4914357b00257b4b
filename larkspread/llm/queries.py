"""Queries of the language-model operators (problems 4, 6, 7 and 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspread.functions.instants import instant_ns
from larkspread.llm.encode import decode_column, encode_column
from larkspread.llm.leaks import find_leaks, strip_leaks
from larkspread.llm.pii import pii_mentions, redact
from larkspread.llm.runs import DAY_NS, collapse_runs
from larkspread.tables import table


def _runs(spark: SparkSession, folder: str, at_least: int) -> DataFrame:
    rows = table(spark, folder, "book_ticker").withColumn("event_ns", instant_ns("event_time", "time_unit"))
    return collapse_runs(
        rows, "symbol", "event_ns", "update_id", ("best_bid_price", "best_ask_price"), ("best_bid_qty", "best_ask_qty"), tie="delivery_id", gap_ns=DAY_NS, at_least=at_least, once=True
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of two or more messages."""
    rows = _runs(spark, folder, 2)
    return rows.select("symbol", F.expr("(start_ns - pmod(start_ns, 1000000)) div 1000000").alias("start_ms"), "first_update_id", "last_update_id")


def p4_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All runs, single messages included, with count and duration."""
    return _runs(spark, folder, 1)


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of each text by the public byte-level vocabulary."""
    return encode_column(table(spark, folder, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as its ids decode to it; null texts come back empty."""
    return decode_column(encode_column(table(spark, folder, "documents"), "doc_id", "text"), "doc_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with the evaluation items found in them."""
    found = find_leaks(table(spark, folder, "documents"), table(spark, folder, "heldout_items"))
    return found.where("passage = 0 AND piece = 0").select("doc_id", "item_id")


def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of the texts before and after leaked spans are cut out."""
    documents = table(spark, folder, "documents")
    clean = strip_leaks(documents, find_leaks(documents, table(spark, folder, "heldout_items")))
    before = documents.select("doc_id", F.length("text").alias("chars"))
    return clean.select("doc_id", F.length("text").alias("chars_left")).join(before, "doc_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct mentions of personal information per text."""
    found = pii_mentions(table(spark, folder, "documents"), table(spark, folder, "known_names"))
    return found.select("doc_id", "pii_kind", "pii_value").distinct()


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The texts with typed placeholders."""
    documents = table(spark, folder, "documents")
    return redact(documents, pii_mentions(documents, table(spark, folder, "known_names")))


_RUNS = """WITH m AS (SELECT symbol, update_id, trunc(CASE time_unit WHEN 's' THEN CAST(event_time AS DECIMAL(38,9)) * 1000000000
   WHEN 'ms' THEN CAST(event_time AS DECIMAL(38,9)) * 1000000 WHEN 'us' THEN CAST(event_time AS DECIMAL(38,9)) * 1000
   WHEN 'ns' THEN CAST(event_time AS DECIMAL(38,9)) END)::BIGINT AS ns, CAST(best_bid_price AS DOUBLE) AS b, CAST(best_ask_price AS DOUBLE) AS a,
   CAST(best_bid_qty AS DOUBLE) AS bq, CAST(best_ask_qty AS DOUBLE) AS aq, delivery_id FROM book_ticker),
 u AS (SELECT *, ns // 86400000000000 AS day FROM m QUALIFY row_number() OVER (PARTITION BY symbol, update_id, ns ORDER BY delivery_id) = 1),
 c AS (SELECT *, coalesce(b = lag(b) OVER o AND a = lag(a) OVER o AND abs(bq - lag(bq) OVER o) <= greatest(bq, lag(bq) OVER o) * 0.001 * (1 + 1e-10)
   AND abs(aq - lag(aq) OVER o) <= greatest(aq, lag(aq) OVER o) * 0.001 * (1 + 1e-10), FALSE) AS same
  FROM u WINDOW o AS (PARTITION BY symbol, day ORDER BY ns, update_id)),
 g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, day ORDER BY ns, update_id) AS run FROM c)"""

QUERIES = {"p4_found": p4_found, "p4_runs": p4_runs, "p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p7_found": p7_found, "p7_clean": p7_clean, "p8_found": p8_found, "p8_redacted": p8_redacted}

ORACLES = {
    "p6_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p4_found": _RUNS
    + """ SELECT symbol, min(ns) // 1000000 AS start_ms, arg_min(update_id, (ns, update_id)) AS first_update_id, arg_max(update_id, (ns, update_id)) AS last_update_id
 FROM g GROUP BY symbol, day, run HAVING count(*) > 1""",
    "p4_runs": _RUNS
    + """ SELECT symbol, day, min(ns) AS start_ns, max(ns) AS end_ns, arg_min(update_id, (ns, update_id)) AS first_update_id, arg_max(update_id, (ns, update_id)) AS last_update_id,
 count(*) AS n, max(ns) - min(ns) AS duration_ns, arg_min(b, (ns, update_id)) AS best_bid_price, arg_min(a, (ns, update_id)) AS best_ask_price,
 arg_min(bq, (ns, update_id)) AS best_bid_qty, arg_min(aq, (ns, update_id)) AS best_ask_qty FROM g GROUP BY symbol, day, run""",
}
