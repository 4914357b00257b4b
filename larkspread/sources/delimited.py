"""Delimited quote files: scan, scaling to integer units, and an audit of every row.

A row passes a ladder of checks; the first that fails names its reason. Checks on
the row alone are expressions. The ones that look back (time must not decrease
against accepted rows, unchanged books, the limit of events) are running maxima,
neighbours and dense numbers taken block by block, so a file of any size is read
in parallel.

Rows come out with ``status``: ``kept``, ``unchanged``, ``beyond`` the limit, or a
reason. Fields are split at commas alone; blanks and then quotes round a field go.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspread.config import EMPTY_LEVEL, GRID_LIMIT, GRID_TOLERANCE, SCALED_LIMIT, UNIT_NS, CsvLayout, RowPolicy
from larkspread.errors import BadRow, BadSchema
from larkspread.operators.ordering import BLOCK, dense_index, running_max, with_previous
from larkspread.session import materialize

#: Reasons in the order in which the checks are made.
REASONS = ("unparsable", "empty_level", "off_grid", "empty_book", "crossed_or_locked", "time_decreased")
_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_FIELDS = ("bid_price", "ask_price", "bid_qty", "ask_qty")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no from 1, raw_line) of one text file, blank lines included."""
    try:
        text = spark.read.text(path)
    except AnalysisException as e:
        raise BadSchema(f"{path} cannot be read: {e.getCondition() or 'no such file'}") from e
    rows = text.select(F.col("value").alias("raw_line"), F.monotonically_increasing_id().alias("__id"))
    rows = rows.withColumn("__part", F.shiftright("__id", 33)).withColumn("__pos", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__all", F.lit(0))  # one row a file split
    before = Window.partitionBy("__all").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).select("__part", "__start")
    return rows.join(starts, "__part").select(F.lit(path).alias("file"), (F.col("__start") + F.col("__pos") + 1).alias("line_no"), "raw_line")


def _fields(line: Column) -> Column:
    return F.transform(F.split(line, ","), lambda x: F.regexp_replace(F.trim(x), '^"+|"+$', ""))


def _real(text: Column) -> Column:
    value = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def _time_ns(text: Column, unit: str) -> Column:
    """Whole numbers exactly, others rounded; null where invalid or beyond 63 bits."""
    per = UNIT_NS[unit]
    whole = F.try_multiply(text.try_cast("decimal(20,0)").try_cast("bigint"), F.lit(per).cast("bigint"))
    real = F.round(_real(text) * F.lit(float(per)))
    return F.when(text.rlike("^[+]?[0-9]+$"), whole).when((real >= 0) & (real < SCALED_LIMIT), real.try_cast("bigint"))


def _units(raw: Column, layout: CsvLayout, tick: Column) -> tuple[Column, Column]:
    """Price in model units, and whether it is on the tick grid."""
    ticks = raw / F.lit(layout.price_divisor) / tick
    near = F.round(ticks)
    return (near * layout.resolution).try_cast("bigint"), (F.abs(ticks - near) <= GRID_TOLERANCE) & (F.abs(near) <= GRID_LIMIT)


def _size(raw: Column, decimals: Column) -> Column:
    scaled = F.round(raw * F.pow(F.lit(10.0), decimals))
    return F.when((scaled >= 0) & (scaled < SCALED_LIMIT), scaled.try_cast("bigint"))


@dataclass(frozen=True)
class Ingest:
    """Every data row with its status, and the settings they were read with."""

    rows: DataFrame
    layout: CsvLayout

    def quotes(self, symbol: Column | None = None) -> DataFrame:
        """The kept rows; ``sequence`` counts them from 0 in each file."""
        kept = self.rows.where("status = 'kept'")
        columns = ["sequence", "timestamp_ns", "bid", "ask", "bid_qty", "ask_qty"]
        return kept.select((F.lit(0).cast("bigint") if symbol is None else symbol).alias("symbol_id"), *columns)

    def audit(self) -> DataFrame:
        """Per file: rows read, kept, unchanged, and skipped by reason; nothing past
        the row at which the limit stopped the read counts."""
        counted = self.rows.where("status <> 'beyond'")
        return counted.groupBy("file").agg(
            F.count(F.lit(1)).alias("rows_read"), *[F.count_if(F.col("status") == s).alias(s) for s in ("kept", "unchanged", "stopped", *REASONS)]
        )


def ingest(lines: DataFrame, layout: CsvLayout, times: DataFrame | None = None, tick: Column | None = None, decimals: Column | None = None, block: int = BLOCK) -> Ingest:
    """Reads (file, line_no, raw_line) rows; each file is a feed of its own.

    times: (file, row, time_text) of a separate message file, met by row number.
    tick, decimals: per-row overrides of the layout's, over columns of ``lines``.
    """
    tick = F.lit(layout.tick_size) if tick is None else tick
    decimals = F.lit(layout.qty_decimals) if decimals is None else decimals
    data = lines.withColumn("__line", F.regexp_replace("raw_line", "[\\r\\n]+$", "")).where("trim(__line) <> ''")
    wanted = {name: getattr(layout, name) for name in (*_FIELDS, *(["time"] if layout.time is not None else []))}
    if layout.header:
        first = data.groupBy(F.col("file").alias("__f")).agg(F.min("line_no").alias("__first"), F.min_by("__line", "line_no").alias("__head"))
        places = F.transform(_fields(F.col("__head")), lambda x: F.lower(x))
        heads = first.select("__f", "__first", *[(F.array_position(places, c.lower()).cast("int") - 1 if isinstance(c, str) else F.lit(c)).alias(f"__at_{n}") for n, c in wanted.items()])
        missing = heads.where(" OR ".join(f"__at_{n} < 0" for n in wanted)).limit(1).collect()
        if missing:
            lacks = [str(c) for n, c in wanted.items() if missing[0][f"__at_{n}"] < 0]
            raise BadSchema(f"{missing[0]['__f']} has no column {', '.join(lacks)}")
        data = data.join(heads, F.col("file") == F.col("__f")).where("line_no > __first").drop("__f", "__first")
        at = {n: F.col(f"__at_{n}") for n in wanted}
    else:
        if any(isinstance(c, str) for c in wanted.values()):
            raise BadSchema("columns can only be named where there is a header")
        at = {n: F.lit(c) for n, c in wanted.items()}
    data = data.withColumn("__fields", _fields(F.col("__line")))
    text = {n: F.get("__fields", c) for n, c in at.items()}
    if times is not None:
        data = dense_index(data, "file", "line_no", block).join(times.withColumnRenamed("row", "idx"), ["file", "idx"], "left").drop("idx")
        text["time"] = F.col("time_text")
    elif layout.time is None:
        raise BadSchema("the layout has no time column and no times were given")
    raw = {n: _real(text[n]) for n in _FIELDS}
    read = data.select("file", "line_no", *[c for c in lines.columns if c not in ("file", "line_no", "raw_line")], _time_ns(text["time"], layout.time_unit).alias("timestamp_ns"), *[raw[n].alias(f"__{n}") for n in _FIELDS])
    (bid, bid_on), (ask, ask_on) = _units(F.col("__bid_price"), layout, tick), _units(F.col("__ask_price"), layout, tick)
    read = read.select("*", bid.alias("bid"), ask.alias("ask"), _size(F.col("__bid_qty"), decimals).alias("bid_qty"), _size(F.col("__ask_qty"), decimals).alias("ask_qty"), (bid_on & ask_on).alias("__on_grid"))
    level = lambda c: (F.col(c) <= 0) | (F.abs(F.col(c)) >= EMPTY_LEVEL)
    why = (
        F.when(F.expr("timestamp_ns IS NULL OR " + " OR ".join(f"__{n} IS NULL" for n in _FIELDS)), "unparsable")
        .when(level("__bid_price") | level("__ask_price"), "empty_level")
        .when(F.expr("__bid_qty < 0 OR __ask_qty < 0"), "unparsable")
        .when(~F.col("__on_grid"), "off_grid")
        .when(F.expr("bid_qty IS NULL OR ask_qty IS NULL"), "unparsable")
        .when(F.expr("bid_qty = 0 AND ask_qty = 0"), "empty_book")
        .when(F.expr("ask <= bid"), "crossed_or_locked")
    )
    # what looks back reads its rows several times: lines are parsed once
    judged = materialize(read.withColumn("reason", why).drop("__on_grid", *[f"__{n}" for n in _FIELDS]), "lines")
    # a row that fails for its time lies below the maximum and so cannot raise it
    timed = running_max(judged.withColumn("__t", F.when(F.col("reason").isNull(), F.col("timestamp_ns"))), "__t", "__high", "file", "line_no", block).drop("__t")
    timed = timed.withColumn("reason", F.coalesce("reason", F.when(F.col("timestamp_ns") < F.col("__high"), "time_decreased"))).drop("__high")
    timed = materialize(timed, "timed")
    good = timed.where("reason IS NULL").withColumn("__book", F.struct("bid", "ask", "bid_qty", "ask_qty"))
    if layout.drop_unchanged:
        seen = with_previous(good, {"__before": "__book"}, "file", "line_no", block)
        good = seen.withColumn("__same", F.coalesce(F.col("__book") == F.col("__before"), F.lit(False))).drop("__before")
    else:
        good = good.withColumn("__same", F.lit(False))
    good = materialize(good.drop("__book"), "accepted")
    kept = dense_index(good.where("NOT __same"), "file", "line_no", block).withColumnRenamed("idx", "sequence").withColumn("status", F.lit("kept"))
    none = F.lit(None).cast("bigint").alias("sequence")
    same = good.where("__same").select("*", none, F.lit("unchanged").alias("status"))
    bad = timed.where("reason IS NOT NULL").select("*", F.lit(False).alias("__same"), none, F.col("reason").alias("status"))
    rows = kept.unionByName(same).unionByName(bad).drop("__same")
    if layout.max_events is not None:
        ends = kept.where(F.col("sequence") == layout.max_events).select(F.col("file").alias("__f"), F.col("line_no").alias("__end"))
        rows = rows.join(ends, F.col("file") == F.col("__f"), "left").drop("__f")
        rows = rows.withColumn("status", F.when(F.col("line_no") > F.col("__end"), "beyond").when(F.col("line_no") == F.col("__end"), "stopped").otherwise(F.col("status")))
        rows = rows.withColumn("sequence", F.when(F.col("status") == "kept", F.col("sequence"))).drop("__end")
    if layout.on_invalid is RowPolicy.ERROR:
        first_bad = rows.where("reason IS NOT NULL AND status <> 'beyond'").orderBy("line_no").limit(1).collect()
        if first_bad:
            raise BadRow(first_bad[0]["line_no"], first_bad[0]["reason"])
    return Ingest(rows, layout)


def read_delimited(spark: SparkSession, path: str, layout: CsvLayout) -> Ingest:
    """One delimited file."""
    return ingest(numbered_lines(spark, path), layout)


def message_times(spark: SparkSession, path: str, unit: str = "s") -> DataFrame:
    """(file, row from 0, time_text) of a message file: its first fields; blank lines
    are skipped, a value that is no time is an error naming its line."""
    rows = numbered_lines(spark, path).where("trim(raw_line) <> ''")
    rows = rows.withColumn("time_text", _fields(F.col("raw_line"))[0])
    bad = rows.where(_time_ns(F.col("time_text"), unit).isNull()).orderBy("line_no").limit(1).collect()
    if bad:
        raise BadRow(bad[0]["line_no"], "the message time is no number")
    return dense_index(rows, "file", "line_no").select("file", F.col("idx").alias("row"), "time_text")


def read_level_pair(spark: SparkSession, levels: str, messages: str, layout: CsvLayout) -> Ingest:
    """A level file with its message file, met row by row; their counts must agree
    unless a limit of events cut the read short."""
    times = message_times(spark, messages, layout.time_unit).withColumn("file", F.lit(levels))
    lines = numbered_lines(spark, levels)
    if layout.max_events is None:
        a, b = lines.where("trim(raw_line) <> ''").count(), times.count()
        if a != b:
            raise BadSchema(f"{a} level rows but {b} message rows")
    return ingest(lines, layout, times)
