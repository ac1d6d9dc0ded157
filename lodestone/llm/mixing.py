"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents are counted into cells (source, language, topic) by their tokens (words, the
longest runs without [\\x20\\x09-\\x0D]). Raking scales the cells' weights to the target
share of each source, language and topic in turn, until no share is off by more than
``tolerance`` (or for ``rounds`` rounds). A cell's multiplier is its raked weight over its
tokens, 1 on average; a document's probability is ``fraction * multiplier``.

Sampling can thin names out but not repeat documents, so the targets hold in the sample
only while no probability exceeds 1. ``fraction`` is therefore the share of all tokens that
is asked for or the largest at which every probability is at most 1, whichever is less:
every source, language and topic then has its target share of the expected tokens. Where that
would leave less than ``least`` of all tokens, ``least`` is sampled and raking goes on with
bounds: a cell that is too small for its weight is taken whole, and the other cells of its
names make up for it. Targets that no sample of that size can have are then missed, as
far as the supply of a name falls short. What was reached is told by ``shares``. A document is sampled if a hash of its id and the seed,
as a number in [0, 1), is below its probability, so a rerun samples the same documents.

Targets are weights by name, taken over the names that have tokens (a name that the given
targets lack has share 0); without them a dimension's own shares are flattened to the power
``flatten[dimension]``. The topic is a column that the caller passes; without one it is the
form of the text (``form_topic``).

Null source, language or topic is the name ``unknown``; a null or empty text has no
tokens and its cell alone never decides a share; a cell without tokens gets multiplier
0. Repeated rows are sampled alike. A null id hashes as the word ``null``. An empty
table gives an empty result. All of a document's columns are kept, whatever their names.
A very long text counts with all its tokens.

Only cells are shuffled, after partial sums; a name's sum is an aggregate that is joined
back, so no task gathers the cells of a name. Documents meet the cell table by an equi-join
(broadcast where Spark finds it small, else sort-merge with skew splitting). Each step is
written once, so its lineage stays short.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stored, text_or_empty, whole_row

DIMENSIONS = ("source", "lang", "topic")
FLATTEN = {"source": 0.5, "lang": 0.7, "topic": 0.5}
WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 8
TOLERANCE = 1e-12
#: The largest share of all tokens that is sampled.
FRACTION = 0.8
#: Where the targets would leave less, this share is sampled, and small cells are taken whole.
LEAST = 0.1


def form_topic(text: Column) -> Column:
    """A topic by the form of a text; callers with a classifier pass its column instead."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit(" = ")), "config")
        .when(F.contains(text, F.lit("@")), "contact")
        .when(F.contains(text, F.lit("icense")), "licensed")
        .when(F.length(text) < 400, "short")
        .otherwise("prose")
    )


def keyed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", topic: Column | None = None) -> DataFrame:
    """``row`` (all columns), ``id, source, lang, topic, tokens``."""
    text = text_or_empty(text_col)
    named = {d: F.coalesce(F.col(d), F.lit("unknown")) for d in ("source", "lang")}
    named["topic"] = F.coalesce(topic if topic is not None else form_topic(text), F.lit("unknown"))
    tokens = F.regexp_count(text, F.lit(WORD)).cast("long")
    return docs.select(whole_row(docs), F.col(id_col).alias("id"), *[c.alias(d) for d, c in named.items()], tokens.alias("tokens"))


def _targets(cells: DataFrame, dim: str, given: Mapping[str, float] | None, flatten: float) -> DataFrame:
    """``dim, share_<dim>``: the shares that the dimension shall have; they sum to 1 over names with tokens."""
    own = cells.groupBy(dim).agg(F.sum("mass").alias("own"))
    if given is None:
        raised = own.select(dim, F.when(F.col("own") > 0, F.pow("own", F.lit(float(flatten)))).otherwise(0.0).alias("raised"))
    else:
        rows = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in given.items()], f"`{dim}` string, weight double")
        raised = own.join(rows, dim, "left").select(
            dim, F.when(F.col("own") > 0, F.coalesce("weight", F.lit(0.0))).otherwise(0.0).alias("raised")
        )
    total = float(raised.agg(F.sum("raised")).first()[0] or 0.0) or 1.0
    return raised.select(dim, (F.col("raised") / total).alias(f"share_{dim}"))


def raked_cells(
    docs: DataFrame,
    text_col: str = "text",
    topic: Column | None = None,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    flatten: Mapping[str, float] = FLATTEN,
    rounds: int = ROUNDS,
    fraction: float = FRACTION,
    tolerance: float = TOLERANCE,
    least: float = LEAST,
) -> DataFrame:
    """One row per cell: ``source, lang, topic, mass, multiplier, prob`` and the target shares of its names."""
    counted = keyed(docs, text_col, text_col, topic).groupBy(*DIMENSIONS).agg(F.sum("tokens").cast("double").alias("mass"))
    cells = stored(counted, "cells")
    total = float(cells.agg(F.sum("mass")).first()[0] or 0.0)
    now = cells.withColumn("weight", F.col("mass"))
    for d in DIMENSIONS:
        now = now.join(_targets(cells, d, (targets or {}).get(d), flatten[d]).hint("merge"), d)
    now = stored(now, "rake-0")
    rated = _multipliers(_raked(now, total, rounds, tolerance))
    most = float(rated.agg(F.max("multiplier")).first()[0] or 0.0)
    reached = min(fraction, 1 / most) if most > 0 else fraction
    if reached < min(least, fraction):
        reached = min(least, fraction)
        rated = _multipliers(_raked(now, total, rounds, tolerance, reached))
    return rated.withColumn("prob", F.least(F.lit(1.0), F.col("multiplier") * reached))


def _multipliers(cells: DataFrame) -> DataFrame:
    multiplier = F.when(F.col("mass") > 0, F.col("weight") / F.col("mass")).otherwise(0.0)
    return stored(cells.select(*[c for c in cells.columns if c not in ("weight", "off")], multiplier.alias("multiplier")), "multipliers")


def _raked(now: DataFrame, total: float, rounds: int, tolerance: float, bounded_at: float | None = None) -> DataFrame:
    """Weights scaled to the shares of each dimension in turn; at ``bounded_at`` of all tokens none needs more than its cell has."""
    columns = [c for c in now.columns if c != "weight"]
    for n in range(rounds):
        for d in DIMENSIONS:
            have = now.groupBy(d).agg(F.sum("weight").alias("have"))
            factor = F.when(F.col("have") > 0, F.col(f"share_{d}") * total / F.col("have")).otherwise(0.0)
            scaled = F.col("weight") * factor
            if bounded_at is not None:
                scaled = F.least(scaled, F.col("mass") / bounded_at)
            moved = F.when(F.col("weight") > 0, F.abs(scaled / F.col("weight") - 1)).otherwise(0.0)
            off = moved if d == DIMENSIONS[0] else F.greatest("off", moved)
            step = now.join(have.hint("merge"), d).select(*columns, scaled.alias("weight"), off.alias("off"))
            now = stored(step, f"rake-{n + 1}-{d}")  # a plan of all three would hold the first one's four times
        if (now.agg(F.max("off")).first()[0] or 0.0) < tolerance:
            break
    return now


def uniform(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the id."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def with_probabilities(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = 17, topic: Column | None = None, **raking
) -> DataFrame:
    """Per document ``row`` (all its columns), ``id, source, lang, topic, tokens, multiplier, prob, sampled``."""
    cells = raked_cells(docs, text_col, topic, **raking).select(*DIMENSIONS, "multiplier", "prob")
    joined = keyed(docs, text_col, id_col, topic).join(cells, list(DIMENSIONS))
    return joined.withColumn("sampled", uniform(F.col("id"), seed) < F.col("prob"))


def shares(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = 17, topic: Column | None = None, **raking) -> DataFrame:
    """``dimension, name, target, expected, sampled, residual, fraction``: shares of the tokens, asked for and reached.

    ``residual`` is the expected share less the target, ``fraction`` the expected share of all tokens.
    """
    cells = stored(raked_cells(docs, text_col, topic, **raking), "raked")
    drawn = keyed(docs, text_col, id_col, topic).join(cells.select(*DIMENSIONS, "prob"), list(DIMENSIONS))
    drawn = drawn.where(uniform(F.col("id"), seed) < F.col("prob")).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("drawn"))
    both = stored(cells.join(drawn, list(DIMENSIONS), "left").withColumn("expected", F.col("mass") * F.col("prob")), "drawn")
    expected, sampled, total = (float(x or 0.0) or 1.0 for x in both.agg(F.sum("expected"), F.sum("drawn"), F.sum("mass")).first())
    out = None
    for d in DIMENSIONS:
        own = both.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("name")).agg(
            F.max(f"share_{d}").alias("target"),
            (F.sum("expected") / expected).alias("expected"),
            (F.coalesce(F.sum("drawn"), F.lit(0)) / sampled).alias("sampled"),
        )
        out = own if out is None else out.unionByName(own)
    return out.withColumns({"residual": F.col("expected") - F.col("target"), "fraction": F.lit(expected / total)})


def sample_to_targets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The sampled documents with their own columns only."""
    return with_probabilities(docs, text_col, id_col, **options).where("sampled").select("row.*")
