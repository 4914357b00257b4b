"""The quote table: Parquet in and out with strict checks, and the test tables as quotes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspread.config import EMPTY_LEVEL, BookPolicy
from larkspread.errors import BadSchema, InvalidBook
from larkspread.functions.book import QUOTE_COLUMNS, valid

#: Column of the Parquet form -> (column here, physical types Spark reads it as)
_PARQUET = {
    "timestamp_ns": ("timestamp_ns", ("decimal(20,0)", "bigint")),
    "sequence": ("sequence", ("decimal(20,0)", "bigint")),
    "symbol_id": ("symbol_id", ("bigint", "int")),
    "bid_price_ticks": ("bid", ("bigint",)),
    "bid_qty": ("bid_qty", ("decimal(20,0)", "bigint")),
    "ask_price_ticks": ("ask", ("bigint",)),
    "ask_qty": ("ask_qty", ("decimal(20,0)", "bigint")),
}
QUOTES = T.StructType([T.StructField(c, T.LongType(), False) for c in QUOTE_COLUMNS])


def _checked(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    for name, (_, allowed) in _PARQUET.items():
        if name not in kinds:
            raise BadSchema(f"column {name} is missing")
        if kinds[name] not in allowed:
            raise BadSchema(f"column {name} is {kinds[name]}, not one of {', '.join(allowed)}")
    return df.select(*[F.col(n).try_cast("bigint").alias(to) for n, (to, _) in _PARQUET.items()])


def read_quotes(spark: SparkSession, path: str, policy: BookPolicy = BookPolicy.STRICT) -> DataFrame:
    """Quotes of a Parquet file; extra columns and column order do not matter.

    Raises for a missing or mistyped column, for nulls and values beyond 64 signed
    bits, and for the first book (by sequence) that breaks the policy.
    """
    try:
        raw = spark.read.parquet(path)
    except AnalysisException as e:
        raise BadSchema(f"{path} cannot be read: {e.getCondition() or 'no such file'}") from e
    rows = _checked(raw)
    bad = F.when(F.expr(" OR ".join(f"{c} IS NULL" for c in QUOTE_COLUMNS)), "null or out of range").when(~valid(policy), "invalid ordering")
    first = rows.withColumn("__why", bad).where("__why IS NOT NULL").orderBy(F.asc_nulls_first("sequence")).limit(1).collect()
    if first:
        at = rows.where(F.col("sequence") < first[0]["sequence"]).count() if first[0]["sequence"] is not None else None
        raise InvalidBook(f"{first[0]['__why']} at sequence {first[0]['sequence']}", at)
    return rows.select(*QUOTE_COLUMNS)


def write_quotes(quotes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Quotes in the Parquet form, 64-bit signed; books are not checked again."""
    quotes.select(*[F.col(to).alias(n) for n, (to, _) in _PARQUET.items()]).write.mode(mode).parquet(path)


def table_quotes(spark: SparkSession, folder: str, policy: BookPolicy = BookPolicy.STRICT) -> DataFrame:
    """The test table of quotes, cleaned: repeats of (symbol, sequence) once, no nulls,
    prices within bounds, no negative size, books valid by the policy."""
    raw = spark.read.parquet(f"{folder}/l1_quotes.parquet")
    inside = "bid > 0 AND ask > 0 AND " + " AND ".join(f"{c} < {EMPTY_LEVEL}" for c in ("bid", "ask")) + " AND bid_qty >= 0 AND ask_qty >= 0"
    rows = _checked(raw).where(inside).where(valid(policy))
    return rows.groupBy("symbol_id", "sequence").agg(*[F.min(c).alias(c) for c in QUOTE_COLUMNS if c not in ("symbol_id", "sequence")])


def event_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """A deterministic single-source feed derived from the ``events`` table, with
    locked and empty books among its rows."""
    rows = spark.read.parquet(f"{folder}/events.parquet")
    from pyspark.sql.window import Window

    # a running sum over one source: block sums, then a window inside each block
    step = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    cut = rows.select("*", step.alias("step"), F.expr("event_id div 65536").alias("__b"))
    sums = cut.groupBy("__b").agg(F.sum("step").alias("__s")).withColumn("__all", F.lit(0))
    before = sums.withColumn("__before", F.coalesce(F.sum("__s").over(Window.partitionBy("__all").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__b", "__before")
    inside = Window.partitionBy("__b").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    walked = cut.withColumn("__in", F.sum("step").over(inside)).join(before, "__b").withColumn("mid_step", F.col("__before") + F.col("__in"))
    return walked.select(
        F.lit(1).cast("bigint").alias("symbol_id"),
        F.col("event_id").cast("bigint").alias("sequence"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timestamp_ns"),
        F.expr("20000 + 2 * mid_step - (1 + event_id % 5)").cast("bigint").alias("bid"),
        F.expr("20000 + 2 * mid_step + IF(event_id % 101 = 100, -(1 + event_id % 5), 1 + event_id % 5)").cast("bigint").alias("ask"),
        F.expr("IF(event_id % 97 = 0, 0, user_id)").cast("bigint").alias("bid_qty"),
        F.expr("IF(event_id % 97 = 0, 0, CAST(get_json_object(props, '$.k') AS BIGINT))").cast("bigint").alias("ask_qty"),
    )
