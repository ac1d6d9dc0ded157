"""Personal data: patterns give seeds, bootstrapped contexts find what the patterns miss.

DataFrame operations only. Base findings, leftmost and non-overlapping per kind:
``email``, ``ip`` (four parts of at most 255), ``card`` (13 to 19 digits that pass the
Luhn check) and ``phone`` (+, 9 to 15 digits). Positions come from splitting a text by
the same expression that extracts the matches and adding up lengths, in code points.

Bootstrapping. Every identifier-like word (it holds a digit or @) or row of digit groups,
without the punctuation around it, that meets no base finding is a candidate instance. A
lexical pattern is the word before and the word after. Seeds (base findings) vote for the
patterns around them; a candidate has the kinds of the seeds that share one of its patterns,
whatever its form. Patterns and instances form a graph: a pattern's score is the mean score
of its distinct instances, an instance's the mean of its patterns' by their number of seeds,
seeds stay at 1; a candidate starts at ``LIKE`` if its shape (digits as 9, letters as a, or
something @ something) is one of its kind's seeds, else at 0. After ``ROUNDS`` rounds,
instances of at least ``CONFIDENT`` that stand in a pattern of at least as much, which at
least ``SUPPORT`` different seeds support, are new findings, each of its likeliest kind.
These are seeds of the next generation: they induce patterns at all places where they stand,
which find further instances, for ``GENERATIONS`` generations or until nothing is new.
Where there is no word on either side only candidates of a seed's shape enter.

Null and empty texts have no findings; repeated rows and null ids are scanned each by
itself; an empty table gives an empty result; columns other than id and text are
ignored. Expressions start only where a run of characters starts (or where the last
match ended) and take runs possessively, so very long runs cost linear time. A text of n
matches takes n * sqrt(n) steps for their positions, which are summed in blocks.

The scan is stored once; all graph tables are aggregates of it with partial sums before
each shuffle, so a frequent pattern or a hot source is never gathered into one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stored, text_or_empty

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
GENERATIONS = 3
CONFIDENT = 0.8
SUPPORT = 5
#: First score of a candidate that looks like a seed of its kind.
LIKE = 0.5
#: Fixed expressions of the four kinds, each led by where it may start.
EXPRESSIONS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = (
    r"(?<![^\x20\x09-\x0D])(?:[+(]*+[0-9][0-9().\/-]*+(?:\x20[0-9(][0-9().\/-]*+(?![^\x20\x09-\x0D,;:!?\"'\]}>]))++"
    r"|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
)
#: Punctuation around a candidate; parentheses only where the other one is missing.
OPENING, CLOSING = r"\"'\[{<,;:", r".,;:!?\"'\]}>"
#: Characters of the pieces beside a match in which its neighbour words are sought.
BESIDE = 40


def _before(piece: Column) -> Column:
    return F.lower(F.regexp_extract(F.right(piece, F.lit(BESIDE)), r"([\p{L}\p{N}_]+)[^\p{L}\p{N}_]*$", 1))


def _after(piece: Column) -> Column:
    return F.lower(F.regexp_extract(F.left(piece, F.lit(BESIDE)), r"^[^\p{L}\p{N}_]*([\p{L}\p{N}_]+)", 1))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _block(items: Column) -> Column:
    """Length of the blocks in which a long array is gone through: about its square root."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items))).cast("int"))


def _each_block(items: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` each block of the array, in order."""
    return F.transform(
        F.sequence(F.lit(0), F.size(items) - 1, _block(items)), lambda at: of(F.slice(items, at + 1, _block(items)))
    )


def _sums_before(numbers: Column) -> Column:
    """At each place the sum of what comes before it."""
    return F.transform(numbers, lambda _, k: _sum(F.slice(numbers, F.lit(1), k)))


def matches(text: Column, expression: str, present: Column) -> tuple[Column, Column]:
    """Matches of the expression and the pieces between them; empty where not ``present``."""
    none = F.array().cast("array<string>")
    return (
        F.when(present, F.regexp_extract_all(text, F.lit(expression), F.lit(0))).otherwise(none),
        F.when(present, F.split(text, expression, -1)).otherwise(none),
    )


def placed(found: Column, pieces: Column, steps: Column, before: Column) -> Column:
    """``start, end, value, before, after`` of each match.

    ``steps``: the length of each piece and the match after it; ``before``: their sums up to each block.
    """

    def one(value: Column, k: Column) -> Column:
        block = F.floor(k / _block(steps)).cast("int")
        upto = F.slice(steps, block * _block(steps) + 1, k - block * _block(steps))
        start = F.get(before, block) + _sum(upto) + F.length(F.get(pieces, k))
        return F.struct(
            start.alias("start"),
            (start + F.length(value)).alias("end"),
            value.alias("value"),
            _before(F.get(pieces, k)).alias("before"),
            _after(F.get(pieces, k + 1)).alias("after"),
        )

    return F.transform(found, one)


def trimmed(span: Column) -> Column:
    """The span without the punctuation around its value."""
    value = span["value"]
    lead, trail = (
        F.when(F.contains(value, F.lit(other)), F.regexp_extract(value, f"^[{marks}]*+", 0) if first else F.regexp_extract(value, f"(?<![{marks}])[{marks}]++$", 0)).otherwise(
            F.regexp_extract(value, f"^[{marks}{own}]*+", 0) if first else F.regexp_extract(value, f"(?<![{marks}{own}])[{marks}{own}]++$", 0)
        )
        for marks, own, other, first in ((OPENING, "(", ")", True), (CLOSING, ")", "(", False))
    )
    start, end = span["start"] + F.length(lead), span["end"] - F.length(trail)
    core = F.substring(value, F.length(lead) + 1, end - start)
    return F.struct(start.alias("start"), end.alias("end"), core.alias("value"), span["before"].alias("before"), span["after"].alias("after"))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits, the last one included, pass the Luhn check."""

    def term(k: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - k, F.lit(1)).cast("int")
        double = digit * 2
        return F.when(k % 2 == 0, digit).when(double > 9, double - 9).otherwise(double)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(F.transform(places, term), F.lit(0), lambda a, x: a + x) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """The check that a match of the kind has to pass."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(digits_of(value))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits_of(value))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def passing(kind: str) -> Callable[[Column], Column]:
    return lambda span: holds(kind, span["value"])


def labelled(kind: str) -> Callable[[Column], Column]:
    return lambda span: F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"))


def shape_of(value: Column) -> Column:
    """Digits as 9, runs of letters as one a, the rest stays; around an @ everything is one w."""
    plain = F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), "[0-9]", "9")
    return F.when(F.contains(value, F.lit("@")), F.regexp_replace(value, "[^@]+", "w")).otherwise(plain)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``__row, id, email, ip, card, phone, candidates``: base findings and candidates, stored."""
    base = docs.select(F.col(id_col), text_or_empty(text_col).alias("__text"))
    text = F.col("__text")
    signs = base.withColumn("__at", F.contains(text, F.lit("@"))).withColumn("__digit", text.rlike("[0-9]"))
    present = {
        "email": F.col("__at"),
        "ip": F.col("__digit"),
        "card": F.col("__digit"),
        "phone": F.col("__digit") & F.contains(text, F.lit("+")),
        "candidates": F.col("__at") | F.col("__digit"),
    }
    # Each layer of columns uses the ones before it.
    layers: list[dict[str, Column]] = [{}, {}, {}, {}, {}]
    for kind, there in present.items():
        found, pieces = matches(text, EXPRESSIONS.get(kind, CANDIDATE), there)
        m, p, steps, sums, before = (F.col(f"__{c}_{kind}") for c in ("m", "p", "steps", "sums", "before"))
        layers[0] |= {f"__m_{kind}": found, f"__p_{kind}": pieces}
        layers[1] |= {f"__steps_{kind}": F.zip_with(p, m, lambda a, b: F.length(a) + F.coalesce(F.length(b), F.lit(0)))}
        layers[2] |= {f"__sums_{kind}": F.when(F.size(m) > 0, _each_block(steps, _sum))}
        layers[3] |= {f"__before_{kind}": _sums_before(sums)}
        spans = placed(m, p, steps, before)
        if kind in KINDS:
            spans = F.filter(spans, passing(kind))
        else:
            spans = F.filter(F.transform(spans, trimmed), lambda c: c["start"] < c["end"])
        layers[4][kind] = spans
    for layer in layers:
        signs = signs.withColumns(layer)
    every = F.array_sort(F.transform(F.concat(*KINDS), lambda s: F.struct(s["start"], s["end"])))
    bounds = lambda block: F.struct(
        F.get(block, F.lit(0))["start"].alias("low"), F.array_max(F.transform(block, lambda s: s["end"])).alias("high"), block.alias("spans")
    )
    signs = signs.withColumn("__every", every)
    signs = signs.withColumn("__blocks", F.when(F.size("__every") > 0, _each_block(F.col("__every"), bounds)))
    meets = lambda c: F.exists(
        "__blocks",
        lambda b: (b["low"] < c["end"]) & (c["start"] < b["high"]) & F.exists(b["spans"], lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])),
    )
    free = F.when(F.col("__blocks").isNull(), F.col("candidates")).otherwise(F.filter("candidates", lambda c: ~meets(c)))
    return stored(
        signs.select(F.monotonically_increasing_id().alias("__row"), id_col, *KINDS, free.alias("candidates")), "pii-scan"
    )


def _pattern() -> Column:
    return F.concat_ws(" ", "s.before", F.lit("_"), "s.after").alias("pattern")


def _instances(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds (``kind, pattern, instance, shape``) and candidates (without ``kind``), each distinct."""
    seeds = None
    for kind in KINDS:
        some = scanned.where(F.size(kind) > 0).select(F.lit(kind).alias("kind"), F.explode(kind).alias("s"))
        seeds = some if seeds is None else seeds.unionByName(some)
    own = [_pattern(), F.col("s.value").alias("instance"), shape_of(F.col("s.value")).alias("shape")]
    others = scanned.where(F.size("candidates") > 0).select(F.explode("candidates").alias("s"))
    return stored(seeds.select("kind", *own).distinct(), "pii-seeds"), stored(others.select(*own).distinct(), "pii-candidates")


def _edges(seeds: DataFrame, candidates: DataFrame) -> DataFrame:
    """``kind, pattern, instance, like, seed``: the graph's distinct edges."""
    shapes = seeds.select("kind", "shape", F.lit(True).alias("like")).distinct()
    entering = candidates.join(seeds.select("kind", "pattern").distinct(), "pattern").join(shapes, ["kind", "shape"], "left")
    entering = entering.where(F.col("like") | (F.col("pattern") != " _ ")).select("kind", "instance").distinct()
    entering = entering.join(seeds.select("kind", "instance").distinct(), ["kind", "instance"], "left_anti")
    others = candidates.join(entering, "instance").join(shapes, ["kind", "shape"], "left")
    columns = ["kind", "pattern", "instance", F.coalesce("like", F.lit(False)).alias("like"), "seed"]
    return stored(
        seeds.withColumns({"like": F.lit(True), "seed": F.lit(True)}).select(*columns).unionByName(others.withColumn("seed", F.lit(False)).select(*columns)),
        "pii-graph",
    )


def accepted(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``kind, pattern, instance``: the confident occurrences, after iterative scoring."""
    start = F.when(F.col("seed"), 1.0).when(F.col("like"), LIKE).otherwise(0.0)
    now = edges.withColumn("score", start)
    for _ in range(rounds):
        patterns = now.groupBy("kind", "pattern").agg(
            F.avg("score").alias("trust"), F.count_if("seed").alias("support")
        )
        joined = now.drop("score").join(patterns, ["kind", "pattern"])
        weight = F.col("support") + 1
        instances = joined.groupBy("kind", "instance").agg((F.sum(F.col("trust") * weight) / F.sum(weight)).alias("mean"))
        now = stored(
            joined.join(instances, ["kind", "instance"]).select(
                "kind", "pattern", "instance", "like", "seed", "trust", "support",
                F.when(F.col("seed"), 1.0).otherwise(F.col("mean")).alias("score"),
            ),
            "pii-round",
        )
        edges_now, now = now, now.drop("trust", "support")
    sure = edges_now.where(~F.col("seed") & (F.col("score") >= CONFIDENT) & (F.col("trust") >= CONFIDENT) & (F.col("support") >= SUPPORT))
    best = F.max(F.struct("like", "support", "kind"))
    return sure.groupBy("pattern", "instance").agg(best.alias("best")).select("best.kind", "pattern", "instance")


def bootstrapped(scanned: DataFrame, generations: int = GENERATIONS, rounds: int = ROUNDS) -> DataFrame:
    """``kind, pattern, instance``: the confident occurrences of all generations."""
    seeds, candidates = _instances(scanned)
    found = None
    for n in range(generations):
        good = stored(accepted(_edges(seeds, candidates), rounds), f"pii-accepted-{n}")
        found = good if found is None else found.unionByName(good)
        if n + 1 == generations or good.isEmpty():
            break
        # What was found is a seed from now on, wherever it stands.
        promoted = candidates.join(good.select("kind", "instance").distinct(), "instance").select("kind", "pattern", "instance", "shape")
        seeds = stored(seeds.unionByName(promoted), f"pii-seeds-{n + 1}")
    return found


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, base, found``: arrays of ``kind, start, end`` by kind as listed, then start."""
    scanned = scan(docs, id_col, text_col)
    good = bootstrapped(scanned)
    occurrences = (
        scanned.where(F.size("candidates") > 0)
        .select("__row", F.explode("candidates").alias("s"))
        .select("__row", "s.start", "s.end", _pattern(), F.col("s.value").alias("instance"))
        .join(good, ["pattern", "instance"])
    )
    found = occurrences.groupBy("__row").agg(
        F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("found")
    )
    base = F.concat(*[F.transform(k, labelled(k)) for k in KINDS])
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return scanned.join(found, "__row", "left").select(id_col, base.alias("base"), F.coalesce("found", none).alias("found"))
