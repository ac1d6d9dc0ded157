"""The stored index: tables in hash-trie buckets, published by generation.

A store is a folder. Each of its tables (chunks, postings, ...) has rows of articles, keyed by
``type, article_slug``. Per type the articles lie in the leaves of a binary trie over 64 bits
of a hash of their key; a leaf is one folder of Parquet files. A leaf that a change brings above
``split_rows`` is cut into halves until its parts hold that, so a change of one article rewrites one
leaf of that size at most, however large the store has become.

A generation is one small Parquet file, the manifest: a row per leaf (its folder and number of
rows), the schema of each table, and counters. Changes write new folders and then
publish a manifest that names them; nothing is changed in place. So a reader, who
opens one manifest, sees a change of all tables wholly or not at all, and what a failed change
has written is never seen. One writer at a time: of two that publish the same generation the
second fails. ``vacuum`` removes folders that no kept generation names.

The manifest is read and written by the driver: a row of some hundred bytes per ``split_rows`` rows.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.operators.bm25 import unpacked
from lodestone.sources.tables import removed

KEY = ["type", "article_slug"]
SPLIT_ROWS = 1 << 17
BITS = 64
#: Articles whose keys are broadcast, at most, to take their rows out of the tasks in which they lie.
FEW_KEYS = 1 << 19
#: Folders of signed counts that are read one beside the other; then they are summed up.
MOST_DELTAS = 16
MANIFEST = "generation long, name string, kind string, prefix string, folder string, rows long, meta string"


class IndexMismatch(ValueError):
    """Rows that do not have the schema of the store that they are written into."""


@dataclass(frozen=True)
class Leaf:
    """A bucket of table ``name``: articles of type ``kind`` whose key's bits begin with ``prefix``. No folder, no rows."""

    name: str
    kind: str
    prefix: str
    folder: str | None
    rows: int


def same_article(left: DataFrame, right: DataFrame) -> Column:
    return left["type"].eqNullSafe(right["type"]) & left["article_slug"].eqNullSafe(right["article_slug"])


def place(parts: int, *key: str) -> Column:
    """In which of ``parts`` partitions an article is: ranges of its hash, so that a leaf's rows are in one or in neighbours."""
    return F.shiftright(F.shiftrightunsigned(F.xxhash64(*key), 33) * parts, 31).cast("int")


def without(rows: DataFrame, keys: DataFrame, few: bool = False) -> DataFrame:
    """The rows of other articles; a null type or slug equals a null one. ``few`` keys (``FEW_KEYS``) go to the rows, which stay where they lie."""
    own, other = rows.alias("own"), keys.select(*KEY).distinct().alias("other")
    if few:
        other = F.broadcast(other)
    return own.join(other, F.expr("own.type <=> other.type AND own.article_slug <=> other.article_slug"), "left_anti")


def only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    own, other = rows.alias("own"), keys.select(*KEY).distinct().alias("other")
    return own.join(other, F.expr("own.type <=> other.type AND own.article_slug <=> other.article_slug"), "left_semi")


def _keyed(rows: DataFrame) -> DataFrame:
    bits = F.lpad(F.bin(F.xxhash64(*KEY)), BITS, "0")
    return rows.withColumns({"__kind": F.coalesce(F.col("type"), F.lit("")), "__bits": bits})


def _at_home(rows: DataFrame, leaves: DataFrame, depths: Iterable[int]) -> DataFrame:
    """``rows`` with the leaf (``__home``) of each; leaves have some few depths, and at one of them a row's bits are a leaf's."""
    every = _keyed(rows).withColumn("__depth", F.explode(F.array(*[F.lit(d) for d in sorted(set(depths))])))
    placed = every.withColumn("__home", F.expr("substring(__bits, 1, __depth)")).drop("__depth")
    return placed.join(F.broadcast(leaves), ["__kind", "__home"])


@dataclass
class Snapshot:
    """One generation of a store."""

    spark: SparkSession
    path: str
    generation: int
    leaves: list[Leaf]
    meta: dict = field(default_factory=dict)

    def schema(self, name: str) -> StructType:
        return StructType.fromJson(self.meta["tables"][name])

    def read(self, leaves: Iterable[Leaf], name: str) -> DataFrame:
        folders = [f"{self.path}/{leaf.folder}" for leaf in leaves if leaf.folder]
        if not folders:
            return self.spark.createDataFrame([], self.schema(name))
        return self.spark.read.schema(self.schema(name)).parquet(*folders)

    def of(self, name: str, types: Iterable[str] | None = None) -> list[Leaf]:
        wanted = None if types is None else {t or "" for t in types}
        return [leaf for leaf in self.leaves if leaf.name == name and (wanted is None or leaf.kind in wanted)]

    def table(self, name: str, types: Iterable[str] | None = None) -> DataFrame:
        """The rows of a table; with ``types`` no other type's folders are read. Packed postings come a row each."""
        rows = self.packed(name, types)
        return unpacked(rows) if "entries" in rows.columns else rows

    def packed(self, name: str, types: Iterable[str] | None = None) -> DataFrame:
        """The rows of a table as they are stored: postings one row per chunk."""
        return self.read(self.of(name, types), name)

    def rows(self, name: str) -> int:
        return sum(leaf.rows for leaf in self.of(name))


def snapshot(spark: SparkSession, path: str, generation: int | None = None) -> Snapshot | None:
    """The newest generation, or the one asked for; none where nothing has been published."""
    try:
        manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    if generation is None:
        generation = manifest.agg(F.max("generation")).first()[0]
    rows = manifest.where(F.col("generation") == generation).collect() if generation is not None else []
    if not rows:
        return None
    leaves = [Leaf(r["name"], r["kind"], r["prefix"], r["folder"], r["rows"]) for r in rows if r["meta"] is None]
    return Snapshot(spark, path, generation, leaves, json.loads(next(r["meta"] for r in rows if r["meta"] is not None)))


def _attempt(s: Snapshot) -> str:
    """A name of its own for what one attempt at a generation writes, so that two never meet in a folder."""
    return f"{s.generation:08d}-{uuid.uuid4().hex[:12]}"


def _publish(s: Snapshot) -> Snapshot:
    rows = [(leaf.name, leaf.kind, leaf.prefix, leaf.folder, leaf.rows, None) for leaf in s.leaves]
    rows.append((None, None, None, None, None, json.dumps(s.meta)))
    table = s.spark.createDataFrame(rows, MANIFEST.replace("generation long, ", ""))
    # One file of one task: there at once, and only when it is whole.
    table.coalesce(1).write.mode("errorifexists").parquet(f"{s.path}/manifest/generation={s.generation}")
    return s


def _split_into(home: str, rows: int, split_rows: int) -> int:
    """How many bits more the parts of a leaf have."""
    return min(BITS - len(home), max(0, math.ceil(math.log2(rows / split_rows)))) if rows > split_rows else 0


def _write(
    spark: SparkSession, path: str, name: str, attempt: str, homes: set[tuple[str, str]], rows: DataFrame, sized: DataFrame, split_rows: int,
    most: dict[tuple[str, str], int] | None = None, placed: bool = False, exact: bool = False,
) -> list[Leaf]:
    """``rows``, all that the leaves ``homes`` hold from now on, in new folders; ``sized`` has as many rows by article.

    ``most``: how many rows a leaf can have; if that asks for no split, or if it is ``exact``, nothing is counted. ``placed``: the
    rows lie by ``place`` in their tasks, each of which writes its own part of the leaves; nothing is shuffled.
    """
    if not homes:
        return []
    depths = {len(prefix) for _, prefix in homes}
    there = spark.createDataFrame(sorted(homes), "__kind string, __home string")
    counts = most if most is not None and (exact or max(most.values(), default=0) <= split_rows) else _counts(sized, there, depths)
    numbers = {kind: i for i, kind in enumerate(sorted({kind for kind, _ in homes}))}
    extra = {home: _split_into(home[1], counts.get(home, 0), split_rows) for home in homes}
    parts = {
        f"t{numbers[kind]}b{prefix}{tail}": (kind, prefix + tail)
        for (kind, prefix), more in extra.items()
        for tail in ([format(i, f"0{more}b") for i in range(1 << more)] if more else [""])
    }
    folder, had = f"{name}/{attempt}", {}
    if any(counts.values()):
        plan = spark.createDataFrame([(k, p, len(p) + extra[k, p], numbers[k]) for k, p in sorted(homes)], "__kind string, __home string, __to int, __number int")
        bucket = F.expr("concat('t', __number, 'b', substring(__bits, 1, __to))")
        dealt = _at_home(rows, plan, depths).withColumn("bucket", bucket).drop("__kind", "__home", "__bits", "__to", "__number")
        # Large leaves are written by several tasks, small ones together by one.
        ordered = (dealt if placed else dealt.hint("rebalance", "bucket")).sortWithinPartitions("bucket", *KEY)
        ordered.write.partitionBy("bucket").parquet(f"{path}/{folder}")
        written = spark.read.schema("bucket string").parquet(f"{path}/{folder}")
        had = {r["bucket"]: r["n"] for r in written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [Leaf(name, kind, prefix, f"{folder}/bucket={b}" if b in had else None, had.get(b, 0)) for b, (kind, prefix) in sorted(parts.items())]


def _counts(rows: DataFrame, leaves: DataFrame, depths: Iterable[int]) -> dict[tuple[str, str], int]:
    """How many of ``rows`` each leaf has."""
    found = _at_home(rows.select(*KEY), leaves, depths).groupBy("__kind", "__home").agg(F.count(F.lit(1)).alias("n"))
    return {(r["__kind"], r["__home"]): r["n"] for r in found.collect()}


def _kinds(rows: DataFrame) -> set[str]:
    return {r[0] for r in rows.select(F.coalesce(F.col("type"), F.lit(""))).distinct().collect()}


def differences(have: StructType, want: StructType) -> list[str]:
    """What ``have`` lacks, has otherwise or has besides ``want``, by column."""
    a, b = ({f.name: f.dataType.simpleString() for f in s} for s in (have, want))
    return [f"{n}: {a.get(n, 'missing')} instead of {b.get(n, 'nothing')}" for n in sorted({*a, *b}) if a.get(n) != b.get(n)]


def create(
    spark: SparkSession, path: str, tables: dict[str, DataFrame], meta: dict | None = None, split_rows: int = SPLIT_ROWS,
    sized: dict[str, DataFrame] | None = None, deltas: dict[str, DataFrame] | None = None, placed: Iterable[str] = (),
) -> Snapshot:
    """A store anew, as the next generation of whatever is there.

    ``sized``: cheaper tables with as many rows by article. ``deltas``: tables of signed counts (the last
    column), which changes add to; they are not by article. ``placed``: tables whose rows lie by ``place``.
    """
    last = snapshot(spark, path)
    s = Snapshot(spark, path, last.generation + 1 if last else 1, [], {**(meta or {}), "split_rows": split_rows})
    s.meta["tables"] = {name: rows.schema.jsonValue() for name, rows in {**tables, **(deltas or {})}.items()}
    attempt = _attempt(s)
    counted: dict[int, dict[tuple[str, str], int]] = {}
    for name, rows in tables.items():
        size = (sized or {}).get(name, rows)
        if id(size) not in counted:
            counted[id(size)] = {(r[0], ""): r[1] for r in size.groupBy(F.coalesce(F.col("type"), F.lit(""))).count().collect()}
        most = counted[id(size)]
        s.leaves += _write(spark, path, name, attempt, set(most), rows, size, split_rows, most, name in placed, exact=True)
    for name, rows in (deltas or {}).items():
        _append(s, name, attempt, rows)
    return _publish(s)


def touched(s: Snapshot, name: str, keys: DataFrame, kinds: set[str] | None = None) -> list[Leaf]:
    """The leaves where articles of ``keys`` (of ``kinds``, if known) are or would be; a type's first leaf where it has none yet."""
    leaves = {(leaf.kind, leaf.prefix): leaf for leaf in s.of(name)}
    new = (_kinds(keys) if kinds is None else kinds) - {kind for kind, _ in leaves}
    if not leaves:
        return [Leaf(name, kind, "", None, 0) for kind in sorted(new)]
    there = s.spark.createDataFrame(sorted(leaves), "__kind string, __home string")
    hit = _at_home(keys.select(*KEY), there, {len(p) for _, p in leaves}).select("__kind", "__home").distinct().collect()
    return [leaves[r["__kind"], r["__home"]] for r in hit] + [Leaf(name, kind, "", None, 0) for kind in sorted(new)]


@dataclass
class Change:
    """Of one table: the articles of ``keys`` go, ``rows`` come in."""

    keys: DataFrame
    rows: DataFrame


def _append(s: Snapshot, name: str, attempt: str, rows: DataFrame) -> None:
    """A folder of signed counts more; from ``MOST_DELTAS`` on all of them become one, summed by what they count."""
    folder, old = f"{name}/{attempt}/all", s.of(name)
    if len(old) >= MOST_DELTAS:
        by, count = rows.columns[:-1], rows.columns[-1]
        summed = s.read(old, name).unionByName(rows).groupBy(*by).agg(F.sum(count).alias(count))
        rows, s.leaves = summed.where(F.col(count) != 0), [leaf for leaf in s.leaves if leaf.name != name]
    rows.write.parquet(f"{s.path}/{folder}")
    s.leaves = [*s.leaves, Leaf(name, "", str(s.generation), folder, s.spark.read.schema(rows.schema).parquet(f"{s.path}/{folder}").count())]


def replace(
    s: Snapshot, changes: dict[str, Change], meta: dict | None = None, deltas: dict[str, DataFrame] | None = None, placed: Iterable[str] = ()
) -> Snapshot:
    """The next generation, in which all ``changes`` have been made, each to the leaves that it touches, and ``deltas`` added.

    ``placed``: tables whose new rows lie by ``place``. Those of the leaves do, as they were written; where
    more than a leaf is rewritten they are not shuffled either.
    """
    for name, change in changes.items():
        if wrong := differences(change.rows.schema, s.schema(name)):
            raise IndexMismatch(f"{name} at {s.path}: " + "; ".join(wrong))
    new = Snapshot(s.spark, s.path, s.generation + 1, list(s.leaves), {**s.meta, **(meta or {})})
    attempt = _attempt(new)
    # Tables of one change share their keys, which are gone through once.
    kinds = {id(keys): _kinds(keys) for keys in {id(c.keys): c.keys for c in changes.values()}.values()}
    n_keys: dict[int, int] = {}
    for name, change in changes.items():
        old = touched(s, name, change.keys, kinds[id(change.keys)])
        stays = name in placed and sum(leaf.rows for leaf in old) > s.meta["split_rows"]
        if stays:
            if id(change.keys) not in n_keys:
                n_keys[id(change.keys)] = change.keys.count()
            stays = n_keys[id(change.keys)] <= FEW_KEYS
        kept = without(s.read(old, name), change.keys, stays)
        rows = kept.unionByName(change.rows.select(*kept.columns))
        homes = {(leaf.kind, leaf.prefix): leaf.rows for leaf in old}
        if homes:
            there = s.spark.createDataFrame(sorted(homes), "__kind string, __home string")
            for home, n in _counts(change.rows, there, {len(prefix) for _, prefix in homes}).items():
                homes[home] += n
        written = _write(s.spark, s.path, name, attempt, set(homes), rows, rows, s.meta["split_rows"], homes, stays)
        gone = set(old)
        new.leaves = [leaf for leaf in new.leaves if leaf not in gone] + written
    for name, rows in (deltas or {}).items():
        _append(new, name, attempt, rows)
    return _publish(new)


def article_rows(s: Snapshot, name: str, keys: DataFrame) -> DataFrame:
    """The stored rows of the articles in ``keys``, from the leaves that may hold them."""
    return only(s.read(touched(s, name, keys), name), keys)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Removes what no one of the newest ``keep`` generations names; readers of older ones lose it. Gives the number of folders."""
    last = snapshot(spark, path)
    if last is None:
        return 0
    kept = [k for g in range(max(1, last.generation - keep + 1), last.generation + 1) if (k := snapshot(spark, path, g))]
    named = {leaf.folder for k in kept for leaf in k.leaves if leaf.folder}
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = fs_path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = [f"{path}/manifest/{f.getPath().getName()}" for f in fs.listStatus(fs_path(f"{path}/manifest")) if f.getPath().getName() not in {f"generation={k.generation}" for k in kept}]
    for name in last.meta["tables"]:
        if not fs.exists(fs_path(f"{path}/{name}")):
            continue
        for generation in (f.getPath().getName() for f in fs.listStatus(fs_path(f"{path}/{name}"))):
            buckets = [b.getPath().getName() for b in fs.listStatus(fs_path(f"{path}/{name}/{generation}")) if b.isDirectory()]
            old = [b for b in buckets if f"{name}/{generation}/{b}" not in named]
            gone += [f"{path}/{name}/{generation}"] if len(old) == len(buckets) else [f"{path}/{name}/{generation}/{b}" for b in old]
    removed(spark, *gone)
    return len(gone)
