"""Personal information in free text: found by bootstrapped contexts, replaced by
typed placeholders.

1. One narrow pass yields candidates (``mentions``) with their patterns: the words
   around a candidate and, for figures and places, its own layout. E-mail addresses,
   phone numbers, identity numbers and street addresses of a layout that nothing
   else has are seed entities; so are the given and family names at hand. All other
   figures after a word, words with a house number and pairs of capitalised words are open.
2. Spark scores the bipartite graphs of patterns and candidates in rounds. For figures
   and places: a pattern is as good for a kind as the share of its distinct
   candidates that are known to be of that kind, seeds and those found before;
   candidates in a pattern that is sure become known (``kind_scores``). For names: a
   pattern is as good as the share of its distinct candidates that are names, a
   candidate is a name when both its parts are; parts seen in good patterns of several
   candidates become names, and the next round scores with them (``name_scores``).
   Nothing of the graphs reaches the driver.
3. An open figure or place is a mention of the kind for which one of its patterns is
   sure, if the words before it do not speak against it. A seed stays out only where the
   words before it are refuted: those of many candidates, hardly any of its kind.
   An occurrence of a name is one when its best pattern is sure, when both its parts are
   names and the patterns it stands in are good on average (which a firm, a
   product or a phrase of capitalised common words fails), or when a part is a
   name, the pattern likely and no pattern refuses it.

Every table of the graph is keyed by pattern or by candidate and pre-aggregated
before its shuffle, so a pattern that a third of all texts share (the first line
of a signature) costs one row a map task and key.

Defined cases
-------------
* Null, empty and blank texts: no mention; the redacted text is the text.
* The same value twice in a text: one row of ``pii_mentions``' distinct form, both
  places are replaced. Overlapping mentions: the earlier and longer one wins.
* No seed names: no names are found. Nulls among the seeds are ignored.
* Texts of any length are read whole. Repeated texts are treated each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspread.llm.mentions import Spans, mentions, squeeze
from larkspread.session import materialize
from larkspread.workers import arrow_schema, map_arrow

KINDS = ("email", "phone", "id_number", "address", "name")


@dataclass(frozen=True)
class BootstrapModel:
    """Parameters; the defaults are the production ones."""

    rounds: int = 3
    first_good: float = 0.12  # share of seeds that makes a pattern good at first
    good: float = 0.5  # and later, with names found on the way
    support: int = 3  # least distinct candidates of a pattern to be believed
    uses: int = 10  # or least uses
    part_support: int = 2  # other parts that a part goes with in good patterns to be a name
    sure: float = 0.8  # pattern score that accepts an occurrence
    likely: float = 0.6  # pattern score that accepts one with a known part
    refuse: float = 0.1  # pattern score that refuses one that is only likely
    against: float = 0.35  # mean score of a candidate below which it is no name
    kind_rounds: int = 2
    kind_sure: float = 0.8  # pattern score for a kind that makes an open candidate one of that kind
    kind_against: float = 0.3  # score of the words before it below which its layout alone does not
    refuted: float = 0.02  # score of the words before it below which a seed is none
    refuted_support: int = 50  # least distinct candidates of such words


def candidates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every candidate with its place, name parts and patterns."""
    schema = T.StructType(
        [
            T.StructField(key, documents.schema[key].dataType),
            T.StructField("pii_kind", T.StringType()),
            T.StructField("pii_value", T.StringType()),
            T.StructField("char_from", T.IntegerType()),
            T.StructField("char_to", T.IntegerType()),
            T.StructField("seed", T.BooleanType()),
            T.StructField("given", T.StringType()),
            T.StructField("family", T.StringType()),
            T.StructField("patterns", T.ArrayType(T.StringType())),
            T.StructField("shouted", T.BooleanType()),
            T.StructField("teaches", T.BooleanType()),
        ]
    )
    rows = documents.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text")).where("length(__text) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for batch in batches:
            out: list[tuple] = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(k, m.kind, m.value, m.start, m.end, m.seed, m.given, m.family, list(m.patterns), m.shouted, m.teaches) for m in mentions(t)]
            columns = list(zip(*out)) if out else [[]] * len(target)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target)], schema=target)

    return map_arrow(rows, run, schema)


def _seed_parts(names: DataFrame, name: str, kind: str) -> DataFrame:
    """(part, role) of the names at hand."""
    return names.where(f"`{name}` IS NOT NULL AND `{kind}` IN ('given', 'family')").select(
        F.lower(F.regexp_replace(F.trim(f"`{name}`"), r"\s+", " ")).alias("part"), F.col(f"`{kind}`").alias("role")
    ).distinct()


def name_scores(found: DataFrame, names: DataFrame, name: str = "person_name", kind: str = "name_kind", model: BootstrapModel = BootstrapModel()) -> tuple[DataFrame, DataFrame]:
    """Scores after the last round: (given, family, parts, mean, top) of candidates - how
    many of the two parts are names, how good its patterns are on average and the best
    of them - and (pattern, support, uses, good) of patterns."""
    # where everything is in capitals, capitals tell nothing, and after an initial a new
    # sentence may begin: neither teaches anything (n = 0)
    pairs = found.where("pii_kind = 'name'").select("given", "family", "teaches", F.explode("patterns").alias("pattern"))
    edges = materialize(pairs.groupBy("given", "family", "pattern").agg(F.count_if("teaches").alias("n")), "pii-edges")
    parts = seeds = _seed_parts(names, name, kind)
    patterns = instances = None
    for turn in range(model.rounds):
        givens = parts.where("role = 'given'").select(F.col("part").alias("given"), F.lit(1).alias("g"))
        families = parts.where("role = 'family'").select(F.col("part").alias("family"), F.lit(1).alias("f"))
        scored = edges.join(givens, "given", "left").join(families, "family", "left").withColumn("known", F.coalesce(F.col("g") * F.col("f"), F.lit(0)))
        # an initial stands for any name: it neither supports a pattern nor speaks against it
        whole = scored.where("n > 0 AND NOT (endswith(family, '.') OR endswith(given, '.'))")
        patterns = whole.groupBy("pattern").agg(
            F.count(F.lit(1)).alias("support"), F.sum("known").alias("names"), F.sum("n").alias("uses"), F.sum(F.col("n") * F.col("known")).alias("name_uses")
        )
        patterns = patterns.where(f"support >= {model.support} OR uses >= {model.uses}")
        # a phrase repeated everywhere is one candidate but many uses; both shares must be high
        patterns = materialize(patterns.select("pattern", "support", "uses", F.expr("least(names / (support + 1D), name_uses / (uses + 1D))").alias("good")), "pii-patterns")
        if turn == model.rounds - 1:
            met = scored.join(patterns, "pattern", "left")
            instances = met.groupBy("given", "family").agg(F.max(F.coalesce("g", F.lit(0)) + F.coalesce("f", F.lit(0)) + F.col("family").endswith(".").cast("int")).alias("parts"), F.expr("try_divide(sum(n * good), sum(CASE WHEN good IS NOT NULL THEN n END))").alias("mean"), F.max("good").alias("top"))
            break
        limit = model.first_good if turn == 0 else model.good
        chosen = patterns.where(f"good >= {limit} AND pattern NOT LIKE 'S %' AND pattern NOT LIKE 'N2 %'").select("pattern")
        fresh = whole.join(chosen, "pattern", "left_semi").groupBy("given", "family").agg(F.max("g").alias("g"), F.max("f").alias("f"), F.count(F.lit(1)).alias("times"))
        # a part is a name when it goes with several other parts, one of them known or in several good patterns
        learned = [
            fresh.groupBy(F.col(role).alias("part"))
            .agg(F.count_if(F.col(other) == 1).alias("beside"), F.sum("times").alias("times"), F.count(F.lit(1)).alias("partners"))
            .where(f"partners >= {model.part_support} AND (beside >= 1 OR times >= {2 * model.part_support})")
            .select("part", F.lit(word).alias("role"))
            for role, other, word in (("given", "f", "given"), ("family", "g", "family"))
        ]
        parts = materialize(seeds.unionByName(learned[0]).unionByName(learned[1]).distinct(), "pii-parts")
    return instances, patterns


_FIGURES = ("email", "phone", "id_number", "address")
#: Kinds that an open candidate may turn out to be.
_MAY_BE = {"number": ("phone", "id_number"), "place": ("address",)}


def kind_scores(found: DataFrame, model: BootstrapModel = BootstrapModel()) -> DataFrame:
    """(pattern, support, one score a kind) after the last round. A candidate counts
    once a pattern, so a pattern that all texts share weighs as its distinct values."""
    open_ = F.col("pii_kind").isin(*_MAY_BE)
    listed = found.where(F.col("seed") | open_).select("pii_kind", "pii_value", F.explode("patterns").alias("pattern"))
    edges = materialize(listed.groupBy("pii_kind", "pii_value", "pattern").agg(F.count(F.lit(1)).alias("n")), "pii-kind-edges")
    known = edges.where(F.col("pii_kind").isin(*_FIGURES)).withColumn("kind", F.col("pii_kind"))
    unknown = edges.where(~F.col("pii_kind").isin(*_FIGURES))
    labelled = known.unionByName(unknown.withColumn("kind", F.lit(None).cast("string")))
    scores = None
    for turn in range(model.kind_rounds):
        each = [
            F.least(F.count_if(F.col("kind") == k) / (F.count(F.lit(1)) + 1), F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)) / (F.sum("n") + 1)).alias(k) for k in _FIGURES
        ]
        scores = labelled.groupBy("pattern").agg(F.count(F.lit(1)).alias("support"), *each).where(f"support >= {model.support}")
        scores = materialize(scores, "pii-kind-patterns")
        if turn < model.kind_rounds - 1:
            sure = scores.where(F.greatest(*_FIGURES) >= model.kind_sure)
            met = unknown.join(sure, "pattern").groupBy("pii_kind", "pii_value").agg(*[F.max(k).alias(k) for k in _FIGURES])
            kind = F.lit(None).cast("string")
            for cls, kinds in _MAY_BE.items():
                for k in kinds:
                    most = F.greatest(*[F.col(x) for x in kinds]) if len(kinds) > 1 else F.col(k)
                    kind = F.when((F.col("pii_kind") == cls) & (F.col(k) >= model.kind_sure) & (F.col(k) == most), k).otherwise(kind)
            learned = materialize(met.select("pii_kind", "pii_value", kind.alias("kind")).where("kind IS NOT NULL"), "pii-kinds")
            labelled = known.unionByName(unknown.join(learned, ["pii_kind", "pii_value"], "left"))
    return scores


def _settled_kinds(found: DataFrame, scores: DataFrame, key: str, model: BootstrapModel) -> DataFrame:
    """Occurrences of figures and places with their kind: open candidates in a sure
    pattern, unless words before them speak against it, and seeds that no words before
    them refute. Only candidates that meet such a pattern are grouped."""
    at = [key, "pii_kind", "pii_value", "char_from", "char_to"]
    words = "(pattern LIKE 'L2 %' OR pattern LIKE 'L3 %')"
    sure = scores.where(F.greatest(*_FIGURES) >= model.kind_sure)
    open_ = found.where(F.col("pii_kind").isin(*_MAY_BE)).select(*at, "patterns", F.explode("patterns").alias("pattern"))
    met = open_.join(sure, "pattern").groupBy(*at, "patterns").agg(*[F.max(k).alias(k) for k in _FIGURES])
    kind, score = F.lit(None).cast("string"), F.lit(0.0)
    for cls, kinds in _MAY_BE.items():
        best = F.greatest(*[F.col(x) for x in kinds], F.lit(0.0))
        for k in kinds:
            good = (F.col("pii_kind") == cls) & (F.col(k) >= model.kind_sure) & (F.col(k) == best)
            kind, score = F.when(good, k).otherwise(kind), F.when(good, F.col(k)).otherwise(score)
    met = met.select(*at, "patterns", kind.alias("kind"), score.alias("score")).where("kind IS NOT NULL")
    against = scores.where(words).select("pattern", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("as_kind"), F.col("support").alias("support")) for k in _FIGURES])).alias("s")).select("pattern", "s.*")
    opposed = met.select(*at, "kind", F.explode("patterns").alias("pattern")).join(against.where(f"as_kind < {model.kind_against}").select("pattern", "kind"), ["pattern", "kind"]).select(*at).distinct()
    named = met.join(opposed, at, "left_anti").select(key, F.col("kind").alias("pii_kind"), "pii_value", "char_from", "char_to", (F.col("score") + 1.0).alias("score"))
    seeds = found.where("seed")
    refuting = against.where(f"support >= {model.refuted_support} AND as_kind < {model.refuted}").select("pattern", F.col("kind").alias("pii_kind"))
    refuted = seeds.select(*at, F.explode("patterns").alias("pattern")).join(refuting, ["pattern", "pii_kind"]).select(*at).distinct()
    return seeds.select(*at, F.lit(9.0).alias("score")).join(refuted, at, "left_anti").unionByName(named)


def pii_mentions(
    documents: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", name: str = "person_name", kind: str = "name_kind", model: BootstrapModel = BootstrapModel()
) -> DataFrame:
    """(key, pii_kind, pii_value, char_from, char_to) of every mention; overlaps
    are resolved."""
    found = materialize(candidates(documents, key, text), "pii-candidates")
    instances, patterns = name_scores(found, names, name, kind, model)
    # the others can be no names: none of their patterns is likely, nor are both their parts names
    hopeful = instances.where(f"parts = 2 OR top >= {model.likely}")
    places = found.where("pii_kind = 'name'").join(hopeful, ["given", "family"])
    places = places.select(key, "pii_value", "char_from", "char_to", "given", "family", "shouted", "parts", "mean", F.explode("patterns").alias("pattern"))
    # the words beside an occurrence decide it, not its mere place, not figures or points
    # alone, not the one word after it; in capitals, two words at least
    place = F.col("pattern").startswith("S ") | F.col("pattern").startswith("R1 ")
    single = F.col("pattern").startswith("L1 ")
    best = (
        places.join(patterns, "pattern", "left")
        .groupBy(key, "pii_value", "char_from", "char_to", "given", "family", "shouted", "parts", "mean")
        .agg(
            F.max(F.when(~place & F.col("pattern").rlike(r"^\w+ .*\p{L}") & ~(single & F.col("shouted")), F.col("good"))).alias("best"),
            F.max(F.when(F.col("pattern").startswith("S rule"), F.col("good"))).alias("signed"),
            F.min(F.when(F.substr("pattern", F.lit(1), F.lit(2)).isin("R2", "L2"), F.col("good"))).alias("worst"),
        )
    )
    context = F.greatest(F.coalesce("best", F.lit(0.0)), F.coalesce("signed", F.lit(0.0)))
    parts = F.col("parts")
    accepted = best.where(
        ((context >= model.sure) & ((parts >= 1) | ~F.col("shouted")))
        | ((parts == 2) & (F.coalesce("mean", F.lit(1.0)) >= model.against))
        | ((context >= model.likely) & (parts >= 1) & (F.coalesce("worst", F.lit(1.0)) >= model.refuse))
    ).select(key, F.lit("name").alias("pii_kind"), "pii_value", "char_from", "char_to", (parts + context - F.when(F.col("family").endswith("."), 0.5).otherwise(0.0)).alias("score"))
    settled = _settled_kinds(found, kind_scores(found, model), key, model)
    listed = settled.unionByName(accepted).groupBy(key).agg(F.collect_set(F.struct("score", "char_from", "char_to", "pii_kind", "pii_value")).alias("found"))
    schema = T.StructType(
        [T.StructField(key, documents.schema[key].dataType), T.StructField("pii_kind", T.StringType()), T.StructField("pii_value", T.StringType())]
        + [T.StructField(c, T.IntegerType()) for c in ("char_from", "char_to")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for batch in batches:
            out = []
            for k, ms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kept = Spans()
                for m in sorted(ms, key=lambda m: (-m["score"], m["char_from"], -m["char_to"], m["pii_kind"])):
                    if kept.add(m["char_from"], m["char_to"]):
                        out.append((k, m["pii_kind"], m["pii_value"], m["char_from"], m["char_to"]))
            columns = list(zip(*out)) if out else [[]] * len(target)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target)], schema=target)

    return map_arrow(listed, run, schema)


def redact(documents: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with every mention replaced by its kind in square brackets."""
    spans = found.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("char_from", "char_to", "pii_kind"))).alias("__spans"))
    rows = documents.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text")).join(spans, key, "left")
    cut = F.aggregate(
        "__spans",
        F.struct(F.lit("").alias("kept"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.concat(a["kept"], F.substr("__text", a["at"] + 1, s["char_from"] - a["at"]), F.lit("["), F.upper(s["pii_kind"]), F.lit("]")).alias("kept"), s["char_to"].alias("at")
        ),
    )
    return rows.select(key, F.when(F.col("__spans").isNull(), F.col("__text")).otherwise(F.concat(cut["kept"], F.substr("__text", cut["at"] + 1))).alias("text"))


__all__ = ["KINDS", "BootstrapModel", "candidates", "name_scores", "pii_mentions", "redact", "squeeze"]
