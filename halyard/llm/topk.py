"""Exact top-k search by exhaustive term-at-a-time accumulation.

Candidates and queries are dealt into blocks of bounded size, and every pair of blocks is a cell of a grid, with a
partition of its own.  There the candidates are turned into postings, one list of (row, weight) a dimension; every
query scatters its weighted postings into a dense array of scores, and a partition selection keeps the cell's k best.
The k best of all cells are then merged by query.  Blocks of equal size on both sides move the fewest vectors for
a cell's work; what there is of queries below a block moves candidates once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table, take_ranges

K = 10
SCALE = 1024
#: Candidates, and queries, in a block, at most: its postings and scores must fit one Python worker.  Candidates' blocks are
#: smaller where that gives every core a few, down to the second number.
BLOCK_ROWS, BLOCK_LEAST = 65_536, 1024
#: Partitions of the grid; beyond it, one takes several cells, one after another.
PARTITIONS = 16_384
#: Queries scored together.
QUERY_ROWS = 64


def integer_vector(column: Column) -> Column:
    """floor(1024 * x) of every component as long; null for vectors that are null or hold null, NaN or infinity."""
    usable = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(F.coalesce(usable, F.lit(False)), F.transform(column, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


class Postings:
    """Postings of a block of integer vectors; vectors may differ in length (missing components are 0)."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, offsets: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, lengths = ids[order], np.diff(offsets)[order]
        at = take_ranges(offsets[:-1][order], lengths)
        rows = np.repeat(np.arange(len(order)), lengths)
        dims = at - np.repeat(offsets[:-1][order], lengths)
        weights = values[at]
        used = np.flatnonzero(weights)
        by_dim = used[np.argsort(dims[used], kind="stable")]
        ends = np.searchsorted(dims[by_dim], np.arange(int(lengths.max(initial=0)) + 1))
        self.terms = []
        for low, high in zip(ends[:-1], ends[1:], strict=True):
            r, w = rows[by_dim[low:high]], weights[by_dim[low:high]]
            self.terms.append((None if len(r) == len(ids) else r, w))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Dense scores of one sparse query, term at a time; arithmetic wraps at 64 bits."""
        out = np.zeros(len(self.ids), np.int64)
        for t in np.flatnonzero(query[: len(self.terms)]):
            rows, weights = self.terms[t]
            if rows is None:
                out += query[t] * weights
            else:
                out[rows] += query[t] * weights  # a row occurs once in a posting list
        return out

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows that aren't the query's own; ties to smaller ids."""
        scores = self.scores(query)
        own = np.searchsorted(self.ids, query_id, "left"), np.searchsorted(self.ids, query_id, "right")
        rows = np.concatenate([np.arange(own[0]), np.arange(own[1], len(self.ids))]) if own[0] < own[1] else np.arange(len(self.ids))
        found = scores[rows]
        if len(rows) > k:
            floor = np.partition(found, len(rows) - k)[len(rows) - k]
            sure = np.flatnonzero(found > floor)
            tied = np.flatnonzero(found == floor)[: k - len(sure)]  # rows are in order of id
            pick = np.concatenate([sure, tied])
            rows, found = rows[pick], found[pick]
        return self.ids[rows], found


def search_blocks(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by cell (block); in it the candidates (kind 0) first, then the queries (kind 1)."""
        block, parts, index = None, [], None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            kinds = batch.column("kind").to_numpy()
            ids = batch.column("id").to_numpy()
            vectors = batch.column("v")
            offsets = vectors.offsets.to_numpy().astype(np.int64)
            values = vectors.values.to_numpy()
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if low == high:
                    continue
                if blocks[low] != block:
                    block, parts, index = blocks[low], [], None
                if kinds[low] == 0:
                    parts.append((ids[low:high].copy(), values[offsets[low] : offsets[high]].copy(), np.diff(offsets[low : high + 1])))
                    continue
                if index is None and parts:
                    lengths = np.concatenate([p[2] for p in parts])
                    index = Postings(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([[0], np.cumsum(lengths)]))
                    parts = []
                if index is None:
                    continue
                for at in range(low, high, QUERY_ROWS):
                    found = [(q, *index.best(ids[q], values[offsets[q] : offsets[q + 1]], k)) for q in range(at, min(high, at + QUERY_ROWS))]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([np.full(len(i), ids[q]) for q, i, _ in found]), pa.int64()),
                            pa.array(np.concatenate([i for _, i, _ in found]), pa.int64()),
                            pa.array(np.concatenate([s for _, _, s in found]), pa.int64()),
                        ],
                        schema=schema,
                    )

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k best rows of ``vectors`` but its own.

    Both have (id long, v array<bigint>); rows with a null id or vector take no part.  A repeated id
    in ``queries`` counts once (with the smallest vector); in ``vectors`` each of its rows is a
    candidate.  Fewer than k candidates: all are returned.  Either table empty: no rows.
    """
    usable = F.col("id").isNotNull() & F.col("v").isNotNull()
    spark = vectors.sparkSession
    spread = F.xxhash64("id", F.monotonically_increasing_id()).alias("spread")  # rows of one id lie in many blocks
    vectors = materialize(vectors.where(usable).select("id", "v", spread), "vectors")
    queries = materialize(queries.where(usable).groupBy("id").agg(F.min("v").alias("v")), "queries")
    n, asked = vectors.count(), queries.count()
    size = min(BLOCK_ROWS, max(BLOCK_LEAST, -(-n // (3 * spark.sparkContext.defaultParallelism))))
    across, down = max(1, -(-n // size)), max(1, -(-asked // BLOCK_ROWS))
    cell = lambda c, q: (c.cast("long") * down + q).alias("block")
    rows = vectors.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).select(cell(F.pmod("spread", F.lit(across)), F.col("q")), F.lit(0).alias("kind"), "id", "v")
    ask = queries.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).select(cell(F.col("c"), F.pmod(F.xxhash64("id"), F.lit(down))), F.lit(1).alias("kind"), "id", "v")
    parts = min(across * down, PARTITIONS)
    dealt = rows.unionByName(ask).repartitionById(parts, F.pmod("block", F.lit(parts)).cast("int")).sortWithinPartitions("block", "kind", "id")
    found = dealt.mapInArrow(search_blocks(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best rows for every row whose vec_id is divisible by 100, by integer inner product."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), integer_vector(F.col("embedding")).alias("v"))
    return top_k(vectors, vectors.where(F.col("id") % 100 == 0))


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, unnest(range(0, len(v))) AS d, unnest(v) AS w FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
  FROM x AS q JOIN x AS c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""
