"""Messages delivered at least once, reduced to exactly one copy each.

``first_deliveries`` is a hash aggregation by the message's identity whose
``min_by`` keeps the payload of the first delivery. Both halves of it are
mergeable, so every task reduces its own copies before anything is shuffled: a
message delivered a million times costs one row per map task, and no group is
ever gathered.

Defined cases
-------------
* A null in any identity column: the delivery proves nothing about any other
  one, so it is kept and is nobody's copy.
* Ties of the order columns: end them with a unique column (the delivery id);
  exact repeats of it are one delivery, of which either copy may stay.
* Empty input: empty output with the same columns.
* Extra columns travel along; none is read by name but those passed in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspread.session import materialize

_KEY, _BEST, _ORDER = "__message_key_{}", "__first_payload", "__delivery_order"


def _known(keys: Sequence[Column]) -> Column:
    known = F.lit(True)
    for k in keys:
        known = known & k.isNotNull()
    return known


def first_deliveries(df: DataFrame, keys: dict[str, Column], order: Sequence[str]) -> DataFrame:
    """One row per message: the delivery that is least by ``order``.

    keys: name -> expression of the message's identity. order: delivery time
    and tie-breaks, compared as one struct.
    """
    payload = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    named = {_KEY.format(i): e for i, e in enumerate(keys.values())}
    rows = df.select(*[e.alias(n) for n, e in named.items()], F.struct(*[F.col(f"`{c}`") for c in order]).alias(_ORDER), payload.alias(_BEST))
    known = _known([F.col(n) for n in named])
    kept = (
        rows.where(known)
        .groupBy(*named)
        .agg(F.min_by(_BEST, _ORDER).alias(_BEST))
    )
    return kept.select(f"{_BEST}.*").unionByName(rows.where(~known).select(f"{_BEST}.*"))


def superfluous_deliveries(df: DataFrame, keys: dict[str, Column], order: Sequence[str], id_column: str) -> DataFrame:
    """``id_column`` of every delivery but the first of its message.

    The aggregation keeps only messages that came more than once. They are written
    down and meet the narrow delivery rows as a table of their own: a plain equi-join
    that the optimizer broadcasts where the table is small and that adaptive
    skew handling splits where one message holds a large share of all deliveries
    (the aggregate itself, read straight from its exchange, could not be split).
    """
    named = {_KEY.format(i): e for i, e in enumerate(keys.values())}
    rows = df.select(*[e.alias(n) for n, e in named.items()], F.struct(*[F.col(f"`{c}`") for c in order]).alias(_ORDER), F.col(f"`{id_column}`").alias(id_column))
    rows = rows.where(_known([F.col(n) for n in named]))
    firsts = rows.groupBy(*named).agg(F.min_by(id_column, F.struct(_ORDER, id_column)).alias(_BEST), F.count(F.lit(1)).alias("__copies")).where("__copies > 1")
    firsts = materialize(firsts.drop("__copies"), "repeated-messages")
    return rows.join(firsts, list(named)).where(F.col(id_column) != F.col(_BEST)).select(id_column)
