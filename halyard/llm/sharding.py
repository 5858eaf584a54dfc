"""Best-fit-decreasing sharding of indivisible groups.

Groups (equal texts) are counted by size class, and bins are filled from the largest class down: a
group enters the bin whose remaining capacity is tightest, found in a balanced tree.  All groups of
a class are alike, so the driver places (class, count) runs: its work follows the number of classes,
which is bounded whatever the corpus.  The smallest capacity that needs no more than the asked number
of shards is found by bisection.  Which group of a class goes to which bin is a matter of its rank
within the class, worked out by the executors.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table, text_or_empty

SHARDS = 40
#: Bytes that every document takes beside its text.
OVERHEAD = 16
#: A class keeps so many leading bits of a group's size, rounded up: at most 2**CLASS_BITS classes an octave.
CLASS_BITS = 11
#: Groups of a class whose ranks are worked out in one task, on average, and parts of all classes beyond one each, at most.
RANK_GROUPS, RANK_PARTS = 50_000, 1 << 16
#: Rows of a shard that are numbered in one task, on average.
SLOT_ROWS = 20_000


class RemainingTree:
    """Balanced (AVL) tree of (remaining capacity, bin): tightest fit and removal in logarithmic time."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None

    @staticmethod
    def _height(n):
        return n[3] if n else 0

    @classmethod
    def _build(cls, key, left, right):
        return (key, left, right, 1 + max(cls._height(left), cls._height(right)))

    @classmethod
    def _balance(cls, key, left, right):
        gap = cls._height(left) - cls._height(right)
        if gap > 1:
            if cls._height(left[1]) < cls._height(left[2]):
                inner = left[2]
                return cls._build(inner[0], cls._build(left[0], left[1], inner[1]), cls._build(key, inner[2], right))
            return cls._build(left[0], left[1], cls._build(key, left[2], right))
        if gap < -1:
            if cls._height(right[2]) < cls._height(right[1]):
                inner = right[1]
                return cls._build(inner[0], cls._build(key, left, inner[1]), cls._build(right[0], inner[2], right[2]))
            return cls._build(right[0], cls._build(key, left, right[1]), right[2])
        return cls._build(key, left, right)

    def add(self, key: tuple[int, int]) -> None:
        def put(n):
            if n is None:
                return self._build(key, None, None)
            return self._balance(n[0], put(n[1]), n[2]) if key < n[0] else self._balance(n[0], n[1], put(n[2]))

        self.root = put(self.root)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The smallest (remaining, bin) with remaining >= size."""
        n, best = self.root, None
        while n:
            if n[0][0] >= size:
                n, best = n[1], n[0]
            else:
                n = n[2]
        return best

    def remove(self, key: tuple[int, int]) -> None:
        def least(n):
            return n[0] if n[1] is None else least(n[1])

        def drop(n, k):
            if k < n[0]:
                return self._balance(n[0], drop(n[1], k), n[2])
            if k > n[0]:
                return self._balance(n[0], n[1], drop(n[2], k))
            if n[1] is None or n[2] is None:
                return n[1] or n[2]
            after = least(n[2])
            return self._balance(after, n[1], drop(n[2], after))

        self.root = drop(self.root, key)


def best_fit_decreasing(classes: Iterable[tuple[int, int]], capacity: int, most: int | None = None) -> list[list[tuple[int, int]]] | None:
    """Place (size, count) classes; per class, in the given order, a list of (bin, count).

    Sizes above the capacity get a bin of their own each.  With ``most``, None when more bins are needed.
    """
    tree, bins, out = RemainingTree(), 0, []
    for size, count in classes:
        runs: list[tuple[int, int]] = []
        while count:
            found = tree.tightest(size)
            if found is None:
                if most is not None and bins >= most:
                    return None
                found = (max(capacity, size), bins)
                bins += 1
            else:
                tree.remove(found)
            remaining, at = found
            n = min(count, remaining // size)
            runs.append((at, n))
            count -= n
            if remaining - n * size > 0:
                tree.add((remaining - n * size, at))
        out.append(runs)
    return out


def into_shards(classes: list[tuple[int, int]], shards: int) -> list[list[tuple[int, int]]]:
    """Best fit with the smallest capacity (to a part in 1024) that needs no more than ``shards`` bins."""
    total, largest = sum(s * n for s, n in classes), max((s for s, _ in classes), default=1)
    low = max(-(-total // shards), largest)
    high = low
    best = best_fit_decreasing(classes, high, shards)
    while best is None:
        low, high = high, high + max(1, high // 64)
        best = best_fit_decreasing(classes, high, shards)
    while high - low > max(1, low // 1024):
        middle = (low + high) // 2
        tried = best_fit_decreasing(classes, middle, shards)
        if tried is None:
            low = middle
        else:
            high, best = middle, tried
    return best


def size_class(size: Column) -> Column:
    """Sizes up to 2**CLASS_BITS as they are; above, rounded up to their CLASS_BITS leading bits."""
    shift = F.greatest(F.length(F.bin(size)) - CLASS_BITS, F.lit(0))
    step = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return F.floor((size + step - 1) / step).cast("long") * step


def assign(items: DataFrame, shards: int) -> DataFrame:
    """Add ``shard`` to rows of (group, size) that can be read twice; rows of a group stay together.

    Shards come out near equal in size, as far as the largest group allows: a group is never split.
    """
    spark = items.sparkSession
    groups = items.groupBy("group").agg(F.sum("size").alias("size"))
    groups = materialize(groups.select("group", size_class(F.col("size")).alias("cls")), "shard-sizes")
    classes = [(int(r["cls"]), int(r["n"])) for r in groups.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()]  # bounded: classes
    per = max(RANK_GROUPS, sum(n for _, n in classes) // RANK_PARTS)
    many = spark.createDataFrame([(c, -(-n // per)) for c, n in classes if n > per], "_c long, parts long")
    salted = groups.join(many, F.col("cls") == F.col("_c"), "left")
    salt = F.pmod(F.xxhash64("group"), F.coalesce("parts", F.lit(1))).cast("int").alias("salt")
    groups = materialize(salted.select("group", "cls", salt), "shard-groups")
    cells = groups.groupBy("cls", "salt").count().toPandas().sort_values(["cls", "salt"], ascending=[False, True])  # bounded: classes and RANK_PARTS
    plan = into_shards([(int(c), int(n)) for c, n in zip(cells["cls"], cells["count"], strict=True)], shards)
    rows = []
    for c, s, runs in zip(cells["cls"], cells["salt"], plan, strict=True):
        at = 0
        for shard, n in runs:
            rows.append((int(c), int(s), at, at + n, shard))
            at += n
    runs = spark.createDataFrame(pd.DataFrame(rows, columns=["cls", "salt", "low", "high", "shard"]).astype({"shard": "int32", "salt": "int32"}), "cls long, salt int, low long, high long, shard int")
    many = runs.groupBy("cls", "salt").agg(F.sort_array(F.collect_list(F.struct("low", "high", "shard"))).alias("runs"))
    rank = F.row_number().over(Window.partitionBy("cls", "salt").orderBy("group")) - 1
    placed = groups.withColumn("rank", rank).join(many, ["cls", "salt"])
    shard = F.expr("element_at(filter(runs, r -> r.low <= rank and rank < r.high), 1).shard")
    placed = materialize(placed.select(F.col("group").alias("_group"), shard.alias("shard")), "shard-plan")
    return items.join(placed, F.col("group") == F.col("_group")).drop("_group")


def number(rows: DataFrame, n_rows: int, order: list[str]) -> DataFrame:
    """Add ``slot``, gapless from 0 within each shard: counts by (shard, part) first, then ranks within parts.

    A row's part comes from its ``spread``, which is dropped: a written number, so that equal rows lie in many parts.
    """
    parts = max(1, -(-n_rows // SLOT_ROWS))
    rows = rows.withColumn("_part", F.pmod("spread", F.lit(parts)).cast("int")).drop("spread")
    counts = rows.groupBy("shard", "_part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("shard").alias("_s"), F.col("_part").alias("_p"), before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy("shard", "_part").orderBy(*order)) - 1
    numbered = rows.withColumn("_rank", rank).join(starts, (F.col("shard") == F.col("_s")) & (F.col("_part") == F.col("_p")))
    return numbered.withColumn("slot", F.col("_rank") + F.col("_before")).drop("_part", "_rank", "_before", "_s", "_p")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    Null text counts as no bytes and is of one group with empty text.  Rows with a null or repeated
    doc_id are rows like others.  An empty table gives no rows.
    """
    text = text_or_empty()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("group"),
        F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("spread"),
    )
    rows = materialize(rows, "shard-rows")
    sharded = materialize(assign(rows, shards).drop("group"), "shard-of")
    return number(sharded, sharded.count(), ["doc_id", "text_crc32", "size"])


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39, sizes near equal, equal texts together."""
    out = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
