"""Delimited lines that fail to parse, set apart with the reason and the edits.

The parse is a minimum-cost edit problem. A dynamic program walks a line's
characters over states (field number, quoting state); following the quoting
rules is free, inserting or deleting a quote or a delimiter costs one. A line
loads when its cheapest parse is free *and* every field has its type;
otherwise the edits of the cheapest parse, or the first ill-typed column, say
why it does not. A line with a legal quoting and the header's field count is
the zero-cost path by definition and needs no table. All other lines of an Arrow
batch go through the program at once (NumPy, one step a character position), and
the cost of their cheapest parse decides whether they load.

Defined cases
-------------
* Null, empty and blank lines: status ``blank``; a header, repeated or not:
  ``header``; both are neither quotes nor rejects.
* A file whose first line is absent or no header: all its lines are rejected
  as ``no_header``.
* A line with more than 4000 quotes and delimiters that is not free: the reason
  is ``structure`` alone; its edits are counted in wider numbers.
* Repeated lines are separate lines. Columns other than those named are kept
  untouched unless ``status`` and the like clash, in which case ours win.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspread.session import materialize
from larkspread.workers import arrow_schema, map_arrow

#: The seven columns of a book-ticker line.
COLUMNS = ("update_id", "best_bid_price", "best_bid_qty", "best_ask_price", "best_ask_qty", "transaction_time", "event_time")
PRICES, SIZES = ("best_bid_price", "best_ask_price"), ("best_bid_qty", "best_ask_qty")
FREE_COLUMNS = ("note",)
#: Prices at or above this mark an empty level.
PRICE_LIMIT = 9_999_999_999

#: Characters of all files' names and headers up to which these are broadcast.
BROADCAST_CHARS = 16_000_000

_LEGAL = re.compile(r'(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*')
_FIELD = re.compile(r',("(?:[^"]|"")*"|[^",]*)')
_NUMBER = re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_PLAIN = re.compile(r"[0-9]{1,9}(?:\.[0-9]{1,12})?")
_EDITS = ("insert_quote", "delete_quote", "insert_delimiter", "delete_delimiter")
_BITS, _MANY = 12, 4000
_START, _BARE, _QUOTED, _CLOSED = range(4)


def split_free(line: str) -> list[str] | None:
    """Fields of a line whose quoting is legal, else None."""
    if '"' not in line:
        return line.split(",")
    if not _LEGAL.fullmatch(line):
        return None
    return _fields(line)


def _fields(line: str) -> list[str]:
    """Fields of a line whose quoting is legal."""
    return [f[1:-1].replace('""', '"') if f[:1] == '"' else f for f in _FIELD.findall("," + line)]


def _marks(line: str) -> int:
    return line.count('"') + line.count(",")


def cheapest_edits(lines: list[str], counts: list[int]) -> np.ndarray:
    """Edits (insert quote, delete quote, insert delimiter, delete delimiter) of
    each line's cheapest parse into ``counts[i]`` fields, as an (n, 4) array."""
    n = len(lines)
    if not n:
        return np.zeros((0, 4), dtype=np.int64)
    width, fields = max(map(len, lines)), max(counts)
    most = max(map(_marks, lines))
    # a packed cost: the count of all edits above one counter per kind; beyond 64 bits as Python's own numbers
    bits = _BITS if most <= _MANY else (most + 4 * fields + 8).bit_length()
    kind = np.int64 if bits == _BITS else object
    iq, dq, id_, dd = ((1 << (bits * 4)) | (1 << (bits * edit)) for edit in range(4))
    never = 1 << (bits * 5 + 2)
    code = np.zeros((width, n), dtype=np.int8)  # 0 past the end, 1 other, 2 quote, 3 delimiter
    for i, line in enumerate(lines):
        code[: len(line), i] = 1
        for mark, at in (('"', 2), (",", 3)):
            k = line.find(mark)
            while k >= 0:
                code[k, i] = at
                k = line.find(mark, k + 1)
    cost = np.full((4, fields, n), never, dtype=kind)
    cost[_START, 0] = 0

    def insertions(c: np.ndarray) -> None:
        """Relax insertions; quotes within a field, then delimiters field by field."""
        for f in range(fields):
            if f:
                np.minimum(c[_START, f], np.minimum(np.minimum(c[_START, f - 1], c[_BARE, f - 1]), c[_CLOSED, f - 1]) + id_, out=c[_START, f])
            np.minimum(c[_QUOTED, f], np.minimum(c[_START, f], c[_CLOSED, f]) + iq, out=c[_QUOTED, f])
            np.minimum(c[_CLOSED, f], c[_QUOTED, f] + iq, out=c[_CLOSED, f])

    for column in code:
        insertions(cost)
        other, quote, comma = column == 1, column == 2, column == 3
        new = cost.copy()
        if other.any():
            o = cost[:, :, other]
            moved = np.full_like(o, never)
            moved[_BARE] = np.minimum(o[_START], o[_BARE])
            moved[_QUOTED] = o[_QUOTED]
            new[:, :, other] = moved
        if quote.any():
            q = cost[:, :, quote]
            moved = q + dq
            np.minimum(moved[_QUOTED], np.minimum(q[_START], q[_CLOSED]), out=moved[_QUOTED])
            np.minimum(moved[_CLOSED], q[_QUOTED], out=moved[_CLOSED])
            new[:, :, quote] = moved
        if comma.any():
            d = cost[:, :, comma]
            moved = d + dd
            moved[_QUOTED] = d[_QUOTED]
            np.minimum(moved[_START, 1:], np.minimum(np.minimum(d[_START, :-1], d[_BARE, :-1]), d[_CLOSED, :-1]), out=moved[_START, 1:])
            new[:, :, comma] = moved
        cost = new
    insertions(cost)
    last = np.asarray(counts) - 1
    ends = cost[[_START, _BARE, _CLOSED]][:, last, np.arange(n)].min(axis=0)
    return np.stack([(ends >> (bits * k)) & ((1 << bits) - 1) for k in range(4)], axis=1).astype(np.int64)


def _bad_value(name: str, text: str) -> str | None:
    """Why a field is no valid value of its column."""
    text = text.strip(" ")
    if _PLAIN.fullmatch(text):
        if name in PRICES and not (text.strip("0.") and float(text) < PRICE_LIMIT):
            return "out of range"
        return None
    if not text:
        return "empty"
    if not _NUMBER.fullmatch(text):
        return "not a decimal number"
    if name in PRICES:
        mantissa, _, exponent = text.lower().partition("e")
        if len(exponent) > 6:  # beyond any price; its sign and mantissa decide
            return None if exponent[0] == "-" and mantissa.strip("+0.") and mantissa[0] != "-" else "out of range"
        if not 0 < Decimal(text) < PRICE_LIMIT:
            return "out of range"
    elif name in SIZES:
        value = float(text)
        if value == float("inf"):
            return "not finite"
        if value < 0 or (text[0] == "-" and text.lower().partition("e")[0].strip("-0.")):
            return "negative"
    return None


def _names_of(line: str | None) -> list[str] | None:
    """Column names if the line is a header with each of the seven once."""
    fields = split_free((line or "").removesuffix("\r"))
    names = [f.strip().lower() for f in fields or []]
    return names if len(set(names)) == len(names) and set(COLUMNS) <= set(names) <= {*COLUMNS, *FREE_COLUMNS} else None


RESULT = T.StructType(
    [T.StructField("status", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("edits", T.MapType(T.StringType(), T.IntegerType()))]
    + [T.StructField(c, T.DoubleType() if c in PRICES + SIZES else T.LongType()) for c in COLUMNS]
)


def _long(text: str) -> int | None:
    value = int(text) if text.isdigit() else Decimal(text)
    if not isinstance(value, int):
        if value != value or abs(value.adjusted()) > 20 or value != value.to_integral_value():
            return None
        value = int(value)
    return value if -(1 << 63) <= value < 1 << 63 else None


def _reason(edits: np.ndarray) -> str:
    iq, dq, i, d = (int(x) for x in edits)
    parts = []
    if i:
        parts.append(f"{i} field(s) missing")
    if d:
        parts.append(f"{d} field(s) too many")
    if iq:
        parts.append("quote not closed or not doubled")
    if dq:
        parts.append("stray quote")
    return "structure: " + ", ".join(parts)


def parse_batch(lines: list[str | None], headers: list[str | None]) -> list[tuple]:
    """(status, reason, edits, seven values) of each line under its header."""
    none, known = (None,) * len(COLUMNS), {}
    out: list[tuple] = [("blank", None, None, *none)] * len(lines)
    suspects: list[tuple[int, str, list[str]]] = []

    def typed(names: list[str], fields: list[str]) -> tuple:
        by = dict(zip(names, fields))
        bad = next((f"{c}: {why}" for c in COLUMNS if (why := _bad_value(c, by[c]))), None)
        if bad:
            return ("reject", bad, {}, *none)
        return ("quote", None, None, *(float(by[c]) if c in PRICES + SIZES else _long(by[c].strip(" ")) for c in COLUMNS))

    for i, (line, header) in enumerate(zip(lines, headers)):
        text = (line or "").removesuffix("\r")
        if not text.strip():
            continue
        if header not in known:
            known[header] = _names_of(header)
        names = known[header]
        if not text[0].isdigit() and _names_of(text):
            out[i] = ("header", None, None, *none)
            continue
        if names is None:
            out[i] = ("reject", "no_header", None, *none)
            continue
        fields = split_free(text)
        if fields is None or len(fields) != len(names):
            suspects.append((i, text, names))
            continue
        out[i] = typed(names, fields)
    suspects.sort(key=lambda s: len(s[1]))
    at = 0
    while at < len(suspects):
        # lines of like length share a table; its cells stay under a few MB
        most = max(1, min(2000, 2_000_000 // (32 * max(1, len(suspects[min(at + 1999, len(suspects) - 1)][1]) // 16 + 1))))
        part = suspects[at : at + most]
        at += len(part)
        narrow = [s for s in part if _marks(s[1]) <= _MANY]
        for group in (narrow, *([s] for s in part if _marks(s[1]) > _MANY)):
            for (i, text, names), edits in zip(group, cheapest_edits([s[1] for s in group], [len(s[2]) for s in group])):
                if not edits.any():
                    out[i] = typed(names, _fields(text))
                    continue
                reason = _reason(edits) if group is narrow else "structure"
                out[i] = ("reject", reason, {k: int(v) for k, v in zip(_EDITS, edits) if v}, *none)
    return out


def parse_lines(df: DataFrame, file: str = "feed_file", number: str = "line_no", line: str = "raw_line") -> DataFrame:
    """All lines with ``status``, ``reason``, ``edits`` and the typed columns.

    The header of a file is its line number 1. Headers are one row a file and are
    written down first. Up to ``BROADCAST_CHARS`` measured characters they are broadcast
    and no line is shuffled. Beyond, they meet the lines in an equi-join of two plain
    tables, which adaptive skew handling splits where a file has very many lines, as
    nothing below needs a file's lines together.
    """
    ours = {f.name for f in RESULT}
    kept = [f for f in df.schema.fields if f.name not in ours]
    rows = df.select(*[F.col(f"`{f.name}`") for f in kept])
    headers = df.where(F.col(f"`{number}`") == 1).groupBy(F.col(f"`{file}`").alias("__file")).agg(F.min(f"`{line}`").alias("__header"))
    headers = materialize(headers.where("__file IS NOT NULL"), "headers")
    size = headers.agg(F.sum(F.length("__file") + F.coalesce(F.length("__header"), F.lit(0)) + 16)).first()[0] or 0
    met = F.broadcast(headers) if size <= BROADCAST_CHARS else headers.hint("merge")
    rows = rows.join(met, F.col(f"`{file}`") == F.col("__file"), "left").drop("__file")
    schema = T.StructType(kept + RESULT.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for batch in batches:
            at = batch.schema.get_field_index(line)
            parsed = parse_batch(batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index("__header")).to_pylist())
            columns = list(batch.columns[: len(kept)])
            for k, f in enumerate(RESULT.fields):
                values = [row[k] for row in parsed]
                kind = target.field(len(kept) + k).type
                columns.append(pa.array([None if v is None else list(v.items()) for v in values] if f.name == "edits" else values, type=kind))
            yield pa.RecordBatch.from_arrays([c.cast(target.field(j).type) for j, c in enumerate(columns)], schema=target)

    return map_arrow(rows, run, schema)


def quotes_of(parsed: DataFrame) -> DataFrame:
    """The typed lines."""
    return parsed.where("status = 'quote'").drop("status", "reason", "edits")


def rejects_of(parsed: DataFrame) -> DataFrame:
    """The lines that do not parse, with reason and edits."""
    return parsed.where("status = 'reject'").drop(*COLUMNS, "status")
