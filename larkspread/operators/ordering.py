"""Ordered operators over sources of any size.

A window over a whole source puts the source into one task. Here a source is cut
into blocks: rows get a dense index (block counts, prefix sums of them, a row
number inside the block), are laid out again by (source, index block), and a few
rows of the neighbouring block travel along as a halo, so that lag and lead see
them. No task holds more than a block, however large the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 1 << 16


def dense_index(df: DataFrame, source: str = "symbol_id", order: str = "sequence", block: int = BLOCK) -> DataFrame:
    """``df`` with ``idx``, 0, 1, 2, ... along ``order`` within each source.

    ``order`` must be unique within a source.
    """
    cut = df.withColumn("__block", F.expr(f"({order} - pmod({order}, {block})) div {block}"))
    counts = cut.groupBy(source, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(source).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(source, "__block").orderBy(order)
    numbered = cut.withColumn("__rn", F.row_number().over(inside))
    return numbered.join(starts, [source, "__block"]).withColumn("idx", F.col("__start") + F.col("__rn") - 1).drop("__block", "__start", "__rn")


def with_neighbours(indexed: DataFrame, columns: dict[str, tuple[str, int]], source: str = "symbol_id", block: int = BLOCK) -> DataFrame:
    """``indexed`` (with ``idx``) plus, for each name -> (column, offset), the
    column's value ``offset`` rows ahead (behind if negative) in the source."""
    ahead = max([0, *(o for _, o in columns.values())])
    behind = max([0, *(-o for _, o in columns.values())])
    if max(ahead, behind) > block:
        raise ValueError("offsets reach beyond a neighbouring block")
    home, rest = F.expr(f"idx div {block}"), F.col("idx") % block
    places = F.array(
        F.struct(home.alias("__block"), F.lit(True).alias("__own")),
        F.when(rest < ahead, F.struct((home - 1).alias("__block"), F.lit(False).alias("__own"))),
        F.when(rest >= block - behind, F.struct((home + 1).alias("__block"), F.lit(False).alias("__own"))),
    )
    laid = indexed.withColumn("__at", F.explode(F.filter(places, lambda p: p.isNotNull()))).select("*", "__at.*").drop("__at")
    w = Window.partitionBy(source, "__block").orderBy("idx")
    seen: list[Column] = [(F.lead(c, o) if o > 0 else F.lag(c, -o)).over(w).alias(n) for n, (c, o) in columns.items()]
    return laid.select("*", *seen).where("__own").drop("__block", "__own")


def with_previous(df: DataFrame, columns: dict[str, str], source: str = "symbol_id", order: str = "sequence", block: int = BLOCK) -> DataFrame:
    """``df`` plus, for each name -> column, the column's value in the row before along
    ``order`` (unique within a source).

    One shuffle of the rows, by (source, block). The last row of each block is
    aggregated map-side, column by column so that the aggregation is a hashed one,
    and handed on to the first row of the next non-empty one.
    """
    cut = df.withColumn("__block", F.expr(f"({order} - pmod({order}, {block})) div {block}"))
    names = {f"__{i}": c for i, c in enumerate(columns.values())}
    ends = cut.groupBy(source, "__block").agg(*[F.max_by(c, order).alias(n) for n, c in names.items()])
    before = Window.partitionBy(source).orderBy("__block")
    handed = ends.select(source, "__block", *[F.lag(n).over(before).alias(f"{n}_carry") for n in names])
    inside = Window.partitionBy(source, "__block").orderBy(order)
    seen = cut.select("*", F.lag(order).over(inside).alias("__order"), *[F.lag(c).over(inside).alias(n) for n, c in names.items()])
    met = seen.join(handed, [source, "__block"], "left")
    first = F.col("__order").isNull()
    return met.select(*df.columns, *[F.when(first, F.col(f"{k}_carry")).otherwise(F.col(k)).alias(n) for k, n in zip(names, columns)])


def last_at_or_before(
    rows: DataFrame, probes: DataFrame, values: list[str], source: str = "symbol_id", time: str = "timestamp_ns", order: str = "idx", bucket_ns: int = 3_600_000_000_000, most: int = BLOCK
) -> DataFrame:
    """``probes`` (source, ``at``, others) with ``values`` of the last row whose
    time is at most ``at``; among equal times the one latest by ``order``.

    Rows and probes meet in buckets of time; a bucket's first probes take what the
    last non-empty bucket before ended with. A bucket of more than ``most`` rows is cut
    into as many parts of equal length, by counts of one row a bucket. ``probes`` have
    no columns named as the values or as ``__``.
    """
    begin = lambda c: F.expr(f"{c} - pmod({c}, {bucket_ns})")
    sizes = rows.groupBy(F.col(source).alias("__s"), begin(time).alias("__begin")).agg(F.ceil(F.count(F.lit(1)) / most).alias("__parts")).where("__parts > 1")
    sizes = sizes.select("__s", "__begin", F.expr(f"({bucket_ns} + __parts - 1) div __parts").alias("__width"))

    def bucketed(df: DataFrame, at: str) -> DataFrame:
        met = df.withColumn("__from", begin(at)).join(sizes, (F.col(source) == F.col("__s")) & (F.col("__from") == F.col("__begin")), "left")
        part = F.expr(f"__from + (({at} - __from) div coalesce(__width, {bucket_ns})) * coalesce(__width, {bucket_ns})")
        return met.withColumn("__b", part).drop("__from", "__s", "__begin", "__width")

    kept = bucketed(rows.select(source, F.col(time).alias("__t"), F.col(order).alias("__o"), F.struct(*values).alias("__v")), "__t")
    asked = bucketed(probes, "at")
    ends = kept.groupBy(source, "__b").agg(F.max_by("__v", F.struct("__t", "__o")).alias("__last"))
    wanted = asked.select(source, "__b").distinct()
    known = Window.partitionBy(source).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.join(wanted, [source, "__b"], "full").withColumn("__carry", F.last("__last", ignorenulls=True).over(known)).select(source, "__b", "__carry")
    payload = F.struct(*[F.col(c) for c in probes.columns])
    both = kept.select(source, "__b", "__t", F.lit(0).alias("__kind"), "__o", "__v", F.lit(None).cast(asked.select(payload).schema[0].dataType).alias("__p")).unionByName(
        asked.select(source, "__b", F.col("at").alias("__t"), F.lit(1).alias("__kind"), F.lit(0).cast("bigint").alias("__o"), F.lit(None).cast(kept.schema["__v"].dataType).alias("__v"), payload.alias("__p"))
    )
    w = Window.partitionBy(source, "__b").orderBy("__t", "__kind", "__o").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__found", F.last("__v", ignorenulls=True).over(w)).where("__kind = 1").join(carried, [source, "__b"], "left")
    met = met.withColumn("__found", F.coalesce("__found", "__carry"))
    return met.select("__p.*", *[F.col(f"__found.{v}").alias(f"found_{v}") for v in values])


def running_max(df: DataFrame, value: str, name: str, source: str, order: str, block: int = BLOCK) -> DataFrame:
    """``df`` with ``name``: the largest ``value`` of earlier rows of the source, by
    block maxima, their running maximum and a window inside each block."""
    cut = df.withColumn("__block", F.expr(f"({order} - pmod({order}, {block})) div {block}"))
    tops = cut.groupBy(source, "__block").agg(F.max(value).alias("__top"))
    before = Window.partitionBy(source).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.withColumn("__carry", F.max("__top").over(before)).drop("__top")
    inside = Window.partitionBy(source, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    met = cut.withColumn("__here", F.max(value).over(inside)).join(carried, [source, "__block"])
    return met.withColumn(name, F.greatest("__here", "__carry")).drop("__block", "__here", "__carry")
