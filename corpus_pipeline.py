"""The corpus pipeline: quality rules, near-duplicate join, suffix deduplication, secret masking, packing.

Every stage takes the documents that its predecessor kept, and all but the last give back documents with the
columns they came with.
"""

from __future__ import annotations

import contextvars
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import delete, discard, materialize, written
from halyard.llm.jaccard import BROADCAST_BYTES, Measure, near_duplicates
from halyard.llm.packing import VOCABULARY, pack
from halyard.llm.quality import judge, with_statistics
from halyard.llm.secrets import mask_secrets
from halyard.llm.suffixes import deduplicate

OWN = ("doc_id", "text", "lang", "source")
#: What earlier stages that were called in this thread have left in the shared folder.
_left: contextvars.ContextVar[tuple[str, ...]] = contextvars.ContextVar("left", default=())


def guarded(stage):
    """Run a stage with all columns but its own under neutral names, so that none can clash with what it adds.

    What earlier stages left in the shared folder is deleted first, unless ``docs`` still reads from it: a stage is given
    documents that were written and read again, so nobody else needs it.
    """

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _left.get() and not any(path in file for file in docs.inputFiles() for path in map(name_of, _left.get())):
            for path in _left.get():
                delete(spark, path)
            _left.set(())
        before = set(written())
        others = {c: f"extra_column_{i}" for i, c in enumerate(docs.columns) if c not in OWN}
        out = stage(spark, docs.withColumnsRenamed(others), sf_dir)
        _left.set((*_left.get(), *(p for p in written() if p not in before)))
        return out.withColumnsRenamed({v: k for k, v in others.items()})

    return run_stage


def name_of(path: str) -> str:
    return path.rpartition("/")[2]


#: Bytes of a row of fates, in memory.
FATE_BYTES = 48
#: Near duplicates: shingles of five words, Jaccard similarity of 0.8 or more.
NEAR = Measure(5, 80, 100)


@guarded
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or lie beyond their group's thresholds; null text fails."""
    columns = docs.columns
    judged = judge(materialize(with_statistics(docs), "quality"))
    return judged.where("kept").select(*columns)


@guarded
def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of linked ones: that of smallest doc_id, null ids last, then by a hash of the text.

    Documents without words link with nothing and stay.  Rows alike in doc_id and text are one document: if it stays, one
    row does.
    """
    columns = docs.columns
    named = materialize(near_duplicates(docs, NEAR), "near-named").where(F.col("root").isNotNull())
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    keeper = named.groupBy("root").agg(F.min(order).alias("best")).select("best.doc_id", "best.text_hash", F.lit(True).alias("stays"))
    rows = named.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    same = rows["doc_id"].eqNullSafe(keeper["doc_id"]) & (rows["text_hash"] == keeper["text_hash"])
    fate = rows.join(keeper, same, "left").where(F.col("stays").isNull() | (F.col("n") > 1))
    fate = materialize(fate.select(rows["doc_id"].alias("_id"), rows["text_hash"].alias("_hash"), F.coalesce("stays", F.lit(False)).alias("_stays")), "near-fate")
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    some = F.broadcast(fate) if fate.count() * FATE_BYTES <= BROADCAST_BYTES else fate
    joined = docs.withColumn("_h", hashed).join(some, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left")
    single = joined.where(F.col("_stays").isNull())
    again = joined.where(F.col("_stays")).dropDuplicates(["doc_id", "_h"])
    return single.select(*columns).unionByName(again.select(*columns))


@guarded
def suffix_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out of the texts the bytes of 100-byte strings that occur earlier, in whole characters; all rows stay."""
    columns = docs.columns
    out = deduplicate(docs, columns, True)
    return out.withColumn("text", F.col("kept")).select(*columns)


@guarded
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts; all rows stay."""
    return mask_secrets(docs)


@guarded
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into windows."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicate_join", near_duplicate_join),
    ("suffix_deduplication", suffix_deduplication),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Suffixes, masking and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again as the next one's input, and then deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if hasattr(before, "_halyard_path"):
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
