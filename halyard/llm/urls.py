"""URL filters: exact membership in listed keys by cascades of Bloom filters, without a join.

A cascade alternates levels.  Level 1 holds the listed keys; level 2 those keys of the universe (all
keys that the corpus can ask about) which level 1 lets through although they are not listed; level 3
the listed keys that level 2 lets through; and so on until a level lets nothing through.  A key of
the universe, or a listed one, is then judged exactly: it is listed when the first level that
refuses it is an even one, or when it passes all of an odd number of levels.

The size is bounded by the list: level 1 is given so many bits a key that about as many keys of the
universe pass it as there are listed keys, and later levels shrink.  Filters are literals in the
plan.  A long list is cut by a hash of its keys into several cascades, and a key asks its own.  Only building
takes a join, which tells level 1's false positives from the listed keys: few rows on either side.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the op5 query: (rule, verdict).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Listed keys of one cascade, on average; a longer list is cut into several.
CASCADE_KEYS = 1 << 18
HASHES = 3


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


@dataclass
class Level:
    bits: int
    words: list[int]

    def holds(self, key: Column, seed: int) -> Column:
        """True where the level lets the key through; the filter is a constant, which Spark reads once."""
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")
        bit = lambda p: F.call_function("shiftright", F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
        return F.forall(F.array(*positions(key, self.bits, seed)), bit)


def positions(key: Column, bits: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * HASHES + k)), F.lit(bits).cast("long")) for k in range(HASHES)]


def build_level(keys: DataFrame, bits: int, seed: int) -> Level:
    """A filter of ``keys.key``: words are OR-ed by key ranges, so only the filter itself is gathered."""
    marks = keys.select(F.explode(F.array(*positions(F.col("key"), bits, seed))).alias("p"))
    rows = marks.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("b")).collect()
    words = [0] * ((bits + 63) // 64)
    for r in rows:
        words[r["w"]] = r["b"]
    return Level(bits, words)


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    @classmethod
    def build(cls, inside: DataFrame, universe: DataFrame, n_listed: int, n_outside: int) -> Cascade:
        """From distinct, non-null ``key`` columns: listed keys, and keys of the corpus (listed ones may be among them)."""
        out, passing = cls(), []
        outside = universe
        while n_listed:
            level = len(out.levels)
            within, other, n = (inside, outside, n_listed) if level % 2 == 0 else (outside, inside, n_outside)
            if not n:
                break
            ratio = max(2.0, (n_outside / max(1, n_listed)) * math.sqrt(2)) if level == 0 else 4.0
            bits = 64 * max(1, math.ceil(n * 1.44 * math.log2(ratio) * 1.2 / 64))
            out.levels.append(build_level(within, bits, level))
            passed = other.where(out.levels[-1].holds(F.col("key"), level))
            if level == 0:
                passed = passed.join(inside.withColumnRenamed("key", "_listed"), F.col("key") == F.col("_listed"), "left_anti")
            passed = materialize(passed, "url-passed")  # at most about as many as there are listed keys
            passing.append(passed)
            n_passed = passed.count()
            if level % 2 == 0:
                outside, n_outside = passed, n_passed
            else:
                inside, n_listed = passed, n_passed
            if not n_passed:
                break
        discard(*passing)
        return out

    def holds(self, key: Column) -> Column:
        """Whether a key is listed: the parity of the first level that refuses it."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[k].holds(key, k), F.lit(k % 2 == 1)).otherwise(out)
        return F.coalesce(out, F.lit(False)) if self.levels else F.lit(False)


@dataclass
class Cascades:
    """As many cascades as the list's length asks for; a key's hash tells which is its own."""

    parts: list[Cascade]

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame) -> Cascades:
        """From ``key`` columns: listed keys, and the distinct keys of the corpus (listed ones may be among them).

        Null keys are in neither.  An empty list gives cascades without levels, which hold nothing.
        """
        keys = materialize(listed.where(F.col("key").isNotNull()).select("key").distinct(), "url-listed")
        universe = universe.where(F.col("key").isNotNull()).select("key")
        n = keys.count()
        many = max(1, -(-n // CASCADE_KEYS))
        if many == 1:
            out = cls([Cascade.build(keys, universe, n, universe.count() if n else 0)])
        else:
            own = cls.own(F.col("key"), many)
            sizes = {r["p"]: r["n"] for r in keys.groupBy(own.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cascade
            others = {r["p"]: r["n"] for r in universe.groupBy(own.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
            out = cls([Cascade.build(keys.where(own == p), universe.where(own == p), sizes.get(p, 0), others.get(p, 0)) for p in range(many)])
        discard(keys)
        return out

    @staticmethod
    def own(key: Column, many: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(many)).cast("int")

    def holds(self, key: Column) -> Column:
        out = self.parts[0].holds(key)
        for p, cascade in enumerate(self.parts[1:], 1):
            out = F.when(self.own(key, len(self.parts)) == p, cascade.holds(key)).otherwise(out)
        return out


def shapes(rules: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """(labels of the host, characters of the path) that rules have; a rule without a path has none."""
    return sorted({(host.count(".") + 1, len(slash + path)) for host, slash, path in (r.partition("/") for r, _ in rules)}, reverse=True)


def candidate(host: Column, path: Column, labels: int, chars: int) -> Column:
    """The key of that shape which a url can fit, null where it is too short for one."""
    parts = F.split(host, r"\.", -1)
    fits = (F.size(parts) >= labels) & (F.length(path) >= chars)
    return F.when(fits, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, chars)))


def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Add host, path, rule and verdict.

    The rules are the listed keys; the universe is every key that some url of the corpus can fit.  Further cascades tell the
    blocking rules among the listed.  Longest fitting rule wins; where no key is listed, ``allow``.  A null or odd url has no
    host, so none fits.  Of a rule given twice the first verdict holds.  Columns of ``pages`` with these names are replaced.
    """
    spark = pages.sparkSession
    first: dict[str, str] = {}
    for rule, verdict in rules:
        first.setdefault(rule, verdict)
    host, path = host_and_path(F.col("url"))
    urls = pages.withColumns({"host": host, "path": path})
    keys = F.array_compact(F.array(*[candidate(F.col("host"), F.col("path"), *s) for s in shapes(rules)])) if rules else F.array().cast("array<string>")
    universe = materialize(urls.select(F.explode(keys).alias("key")).distinct(), "url-keys")
    of = lambda some: spark.createDataFrame([(r,) for r in some], "key string")
    listed = Cascades.build(of(first), universe)
    blocking = Cascades.build(of([r for r, v in first.items() if v == "block"]), of(first))
    discard(universe)
    hits = F.transform(F.filter(keys, listed.holds), lambda key: F.struct(F.length(key).alias("n"), key.alias("rule"), blocking.holds(key).alias("blocks")))
    best = "best"
    while best in urls.columns:
        best += "_"
    urls = urls.withColumn(best, F.array_max(hits))
    verdict = F.when(F.coalesce(F.col(best)["blocks"], F.lit(False)), "block").otherwise("allow")
    return urls.withColumns({"rule": F.col(best)["rule"], "verdict": verdict}).drop(best)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, longest fitting rule and verdict of every page's url."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
