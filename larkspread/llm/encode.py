"""Token ids of every text by a public byte-level vocabulary.

Encoding is a monoid: an element is a text with its ids, the empty text is
neutral, and the product of two neighbours is the element of the joined text. A
long text is halved until its pieces are short, the pieces are encoded, and
neighbours are multiplied up the tree. A product re-encodes only a window round
the boundary:

* The pre-tokenizer matches left to right and looks at most a few characters past
  the start of a match and one past its end. A match of the left text that ends
  before the left text does, and starts at least ``_LOOK`` characters before its
  end, is therefore the same in the joined text. The window starts at the first
  match that is not (``settled``).
* The window grows match by match until a match of the joined text begins where
  one of the right text alone begins. From there on both scans see the same
  text, so all later matches, and hence all later ids, are the same.

Merges never cross matches, so ids outside the window provably stay.

Defined cases
-------------
* Null and empty texts: the empty list. Blank texts are encoded as they are.
* Text that looks like a special token is plain text; no special token is added.
* Texts of any length are encoded whole. A single match longer than the window
  (one word of a million letters) makes the window as long as that match.
* Repeated rows are encoded each; nothing else of a row is read.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspread.workers import arrow_schema, map_arrow

#: Characters past a match's start that the contractions of the pattern look at.
_LOOK = 4
#: Longest piece that is encoded at once.
PIECE = 256


def vocabulary_folder() -> str:
    """Where the public vocabularies lie on this machine."""
    found = importlib.util.find_spec("public_tokenizers")
    return os.environ.get("LARKSPREAD_TOKENIZERS") or (os.path.dirname(found.origin) if found and found.origin else "/opt/tokenizers")


class ByteVocabulary:
    """A byte-level vocabulary: encodes a piece and finds its pre-token matches."""

    def __init__(self, ranks_file: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.match = regex.compile(pattern).match
        self.last_break = regex.compile(r"(?r)(?<=\p{L})\s").search

    def ids(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def text(self, ids: list[int]) -> str:
        return self.encoding.decode(ids)


@lru_cache(maxsize=4)
def load_vocabulary(name: str, folder: str, pattern: str | None = None) -> ByteVocabulary:
    """The vocabulary once a process; its pre-token pattern is that of the public files."""
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    return ByteVocabulary(os.path.join(folder, f"{name}.tiktoken"), pattern)


def _shipped(spark: SparkSession, name: str, folder: str | None):
    """A loader for workers, which get the vocabulary's file from the driver: only the
    driver needs the folder."""
    from public_tokenizers import PATTERN

    spark.sparkContext.addFile(os.path.join(folder or vocabulary_folder(), f"{name}.tiktoken"))

    def load() -> ByteVocabulary:
        from pyspark import SparkFiles

        return load_vocabulary(name, SparkFiles.getRootDirectory(), PATTERN)

    return load


def _settled(vocabulary: ByteVocabulary, text: str, start: int) -> int:
    """Start of the first match at or after ``start`` (a match's start) that text
    appended to ``text`` could change."""
    at, n = start, len(text)
    while at < n:
        end = vocabulary.match(text, at).end()
        if end >= n or at + _LOOK > n:
            return at
        at = end
    return n


def _unsettled(vocabulary: ByteVocabulary, text: str) -> int:
    """``_settled`` from the text's start, found from its end."""
    last, near = len(text) - _LOOK, 32
    while last > 0:
        first = max(0, last - near)
        place = vocabulary.last_break(text, first, last)
        if place:
            return _settled(vocabulary, text, place.start())
        if not first:
            break
        near *= 8
    return _settled(vocabulary, text, 0)


class Encoded:
    """A text with its ids; ``settled`` is where its unsettled end begins."""

    __slots__ = ("text", "ids", "settled")

    def __init__(self, text: str, ids: list[int], settled: int):
        self.text, self.ids, self.settled = text, ids, settled


def leaf(vocabulary: ByteVocabulary, text: str) -> Encoded:
    """Element of a short text."""
    return Encoded(text, vocabulary.ids(text), _unsettled(vocabulary, text))


def join(vocabulary: ByteVocabulary, left: Encoded, right: Encoded) -> Encoded:
    """Element of ``left.text + right.text``."""
    if not left.text or not right.text:
        return right if not left.text else left
    tail = left.text[left.settled :]
    window, shift = tail + right.text, len(tail)
    joined, alone = 0, 0  # starts of matches, in the window and in the right text
    between: list[int] = []  # ids of the window's matches
    head = 0  # number of ids of the right text's matches that the window replaces
    while joined < len(window) and joined - shift != alone:
        # match by match: cut short, a text may be matched otherwise
        if joined - shift < alone:
            end = vocabulary.match(window, joined).end()
            between += vocabulary.ids(window[joined:end])
            joined = end
        else:
            end = vocabulary.match(right.text, alone).end()
            head += len(vocabulary.ids(right.text[alone:end]))
            alone = end
    sure = joined - shift  # matches of the right text from here on hold
    while alone < sure:  # the window reached the end first
        end = vocabulary.match(right.text, alone).end()
        head += len(vocabulary.ids(right.text[alone:end]))
        alone = end
    dropped = len(vocabulary.ids(tail)) if tail else 0
    ids = left.ids[: len(left.ids) - dropped] + between + right.ids[head:]
    whole = left.text + right.text
    base = len(left.text)
    if sure <= right.settled and sure + _LOOK <= len(right.text):
        settled = base + right.settled
    else:
        settled = _settled(vocabulary, whole, left.settled)
    return Encoded(whole, ids, settled)


def encode_tree(vocabulary: ByteVocabulary, text: str, piece: int = PIECE) -> Encoded:
    """Element of a text of any length, by halving."""
    if len(text) <= piece:
        return leaf(vocabulary, text)
    half = len(text) // 2
    return join(vocabulary, encode_tree(vocabulary, text[:half], piece), encode_tree(vocabulary, text[half:], piece))


def encode_text(vocabulary: ByteVocabulary, text: str | None, piece: int = PIECE) -> list[int]:
    """Ids of a text; a text of one piece needs no tree."""
    if not text:
        return []
    return vocabulary.ids(text) if len(text) <= piece else encode_tree(vocabulary, text, piece).ids


def decode_tree(vocabulary: ByteVocabulary, ids: list[int], piece: int = PIECE) -> str:
    """Text of a list of ids; bytes of the halves are concatenated up the tree."""

    def up(part: list[int]) -> bytes:
        if len(part) <= piece:
            return vocabulary.encoding.decode_bytes(part)
        half = len(part) // 2
        return up(part[:half]) + up(part[half:])

    return up(ids).decode("utf-8", errors="replace")


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str | None = None, piece: int = PIECE) -> DataFrame:
    """(key, ids) of every row. Nothing is shuffled: the work is one narrow pass."""
    load = _shipped(df.sparkSession, vocabulary, folder)
    rows = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load()
        target = arrow_schema(schema)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 2000):
                part = texts.slice(at, 2000).to_pylist()
                ids = pa.array([encode_text(vocab, t, piece) for t in part], type=target.field("ids").type)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 2000).cast(target.field(0).type), ids], schema=target)

    return map_arrow(rows, run, schema)


def decode_column(df: DataFrame, key: str, ids: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, text) of every row of ids; null ids give null."""
    load = _shipped(df.sparkSession, vocabulary, folder)
    rows = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{ids}`").alias("__ids"))
    schema = T.StructType([df.schema[key], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load()
        target = arrow_schema(schema)
        for batch in batches:
            texts = [None if x is None else decode_tree(vocab, x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(target.field(0).type), pa.array(texts, type=pa.string())], schema=target)

    return map_arrow(rows, run, schema)
