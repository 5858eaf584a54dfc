"""N-gram Jaccard join with token-combination prefixes.

Every distinct shingle set is a node.  Shingles that many documents hold form the frequent class (heavy
hitters, found by counts that merge; at most ``FREQUENT_MOST`` of them); all others are rare.  In the
global order rare shingles come before frequent ones.  A set that may miss m-1 of its shingles in a partner is
indexed by its first m rare shingles alone.  If it has fewer, its prefix is extended into the frequent
class, which is cut into small sub-classes by hash: there pairs of shingles are indexed, and a
sub-class with c shingles in the prefix counts c-1, since a partner that shares one of them shares no pair.
The prefix ends when the counts reach m; two linked sets then have a signature in common.

Nodes that share a signature are joined to the least of them (a star), never to each other: so rows
grow with the signatures.  A star's family holds all its candidate pairs.  Large families are cut into blocks that each
get the leader too; only members that don't come to the leader's side there are compared across blocks, since the
others are in one component already.  Upper bounds on the overlap from hash histograms take out pairs that
can't link.  The components of what is left are clusters: a node's set is sent to its cluster alone, where the
exact overlaps are counted, and linked nodes become components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, discard, materialize, mix, partitions, releasing, slices, table, text_or_empty, whole_groups
from .graph import components
from .shingles import shingle_sets

#: Documents that hold a frequent shingle, at least, and the most such shingles (by count), which bounds the broadcast.
FREQUENT_LEAST, FREQUENT_MOST = 64, 1 << 16
#: A batch reports shingles held by one in so many of its documents.
LOCAL_SHARE = 1000
#: A set's histogram has a power of two of buckets, about one for so many shingles, and no fewer than the second number.
BUCKET_SHINGLES, BUCKETS_LEAST = 8, 64
#: Shingles and members of a block; a unit of work compares one block or two, and larger groups are cut.
BLOCK_SHINGLES, BLOCK = 500_000, 4096
#: Sets from which sub-classes are used; below, all shingles count as rare.
SPLIT_LEAST = 24
#: Bytes up to which the list of candidates is broadcast; beyond it, it is joined by shuffle.
BROADCAST_BYTES = 32 << 20
_PAIR, _MODE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class Measure:
    """Shingles of ``k`` words; sets link when den * intersection >= num * union."""

    def __init__(self, k: int, num: int, den: int):
        self.k, self.num, self.den = k, num, den

    def least_overlap(self, n: int) -> int:
        return -(-self.num * n // self.den)

    def band(self, n: int) -> int:
        return int(math.log(n) / math.log(self.den / self.num) + 1e-9)

    def band_size(self, band: int) -> float:
        return (self.den / self.num) ** band

    def links(self, overlap, a, b):
        return self.den * overlap >= self.num * (a + b - overlap)


def node_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def histogram(tokens: np.ndarray) -> bytes:
    """Shingles by the low bits of their hash: the width of a count, and the counts."""
    size = max(BUCKETS_LEAST, 1 << (len(tokens) // BUCKET_SHINGLES).bit_length())
    counts = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size)
    if counts.max(initial=0) < 256:
        return b"\1" + counts.astype("u1").tobytes()
    if counts.max() > 65_535:
        counts[:] = 65_535  # too large a set to bound: it passes every time
    return b"\2" + counts.astype("<u2").tobytes()


def counts_of(packed: np.ndarray) -> np.ndarray:
    """The counts of a packed histogram."""
    return packed[1:] if packed[0] == 1 else packed[1:].view("<u2")


def folded(counts: np.ndarray, size: int) -> np.ndarray:
    """The histogram of fewer buckets (a power of two)."""
    return np.minimum(counts.astype(np.int64).reshape(-1, size).sum(0), 65_535) if len(counts) != size else counts


def signatures(tokens: np.ndarray, frequent: np.ndarray, m: Measure) -> np.ndarray:
    """Signature hashes of one sorted token set."""
    n = len(tokens)
    need = n - m.least_overlap(n) + 1
    band = m.band(n)
    first_split = m.band(SPLIT_LEAST) + 1
    out = []
    if band < first_split:  # as rare, whatever their class
        out.append(mix(tokens[:need] + _MODE))
    if band + 1 >= first_split:
        often = np.zeros(n, bool)
        if len(frequent):
            often = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
        rare = tokens[~often][:need]
        out.append(rare)
        need -= len(rare)
        if need > 0:
            common = tokens[often]
            for g in (band, band + 1):
                if g < first_split:
                    continue
                classes = max(1, int(m.band_size(g)) // 6)
                kind = (mix(common.copy()) % np.uint64(classes)).astype(np.int64)
                order = np.argsort(kind, kind="stable")
                rank = np.zeros(len(common), np.int64)
                ordered = kind[order]
                begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                rank[order] = np.arange(len(common)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(common)]])))
                end = int(np.searchsorted(np.cumsum(rank > 0), need)) + 1  # the prefix: rank > 0 counts one
                order = order[order < end]
                kinds = kind[order]
                for gap in range(1, len(order)):
                    same = kinds[gap:] == kinds[:-gap]
                    if not same.any():
                        break
                    a, b = common[order[:-gap][same]], common[order[gap:][same]]
                    out.append(mix(mix(a * _PAIR + np.uint64(g)) + b))
    return np.concatenate(out)


def describe(measure: Measure):
    """Rows of kind 0: a document's node, set size and histogram; of kind 1: a shingle frequent in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text"):
            sets = shingle_sets(*buffers(rows.column(rows.schema.get_field_index("text"))), measure.k)
            n = rows.num_rows
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(n, np.int32)),
                    rows.column(rows.schema.get_field_index("doc_id")),
                    rows.column(rows.schema.get_field_index("text_hash")),
                    pa.array([node_of(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([histogram(s) if len(s) else None for s in sets], pa.binary()),
                    none,
                ],
                names=["kind", "doc_id", "text_hash", "node", "n", "histogram", "token"],
            )
            seen = {s.tobytes(): s for s in sets}  # a set counts once
            tokens, counts = np.unique(np.concatenate(list(seen.values())), return_counts=True)
            often = np.flatnonzero(counts >= max(2, n // LOCAL_SHARE))
            k = len(often)
            gone = pa.nulls(k, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(k, np.int32)), pa.nulls(k, rows.schema.field("doc_id").type), pa.nulls(k, pa.int64()), gone, pa.array(counts[often].astype(np.int64)), gone, pa.array(tokens[often].view(np.int64))],
                names=["kind", "doc_id", "text_hash", "node", "n", "histogram", "token"],
            )

    return releasing(run)


def index_signatures(measure: Measure, frequent, buckets: int):
    """Signatures of a task's distinct sets, packed by bucket: arrays of hashes, set numbers and nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(frequent.value, np.uint64)
        seen: set[bytes] = set()
        nodes: list[bytes] = []
        held: list[np.ndarray] = []
        total = 0

        def flush():
            nonlocal total
            if not held:
                return
            flat, who = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.uint32), [len(h) for h in held])
            bucket = (flat % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            packed = np.frombuffer(b"".join(nodes), "V16")
            for b in np.flatnonzero(np.diff(cuts)):
                some = order[cuts[b] : cuts[b + 1]]
                mine, local = np.unique(who[some], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(b)], pa.int32()), pa.array([flat[some].tobytes()]), pa.array([local.astype("<u4").tobytes()]), pa.array([packed[mine].tobytes()])],
                    names=["bucket", "signatures", "who", "nodes"],
                )
            nodes.clear()
            held.clear()
            total = 0

        for rows in slices(batches, "text"):
            for s in shingle_sets(*buffers(rows.column(rows.schema.get_field_index("text"))), measure.k):
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                nodes.append(node)
                held.append(signatures(s, often, measure))
                total += len(held[-1])
            if total > 1_500_000:
                yield from flush()
                seen.clear()
        yield from flush()

    return releasing(run)


@releasing
def star_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leader, member) of all signatures of a partition's buckets that two nodes or more have."""
    sigs, owners = [], []
    for batch in batches:
        for s, w, n in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            sigs.append(np.frombuffer(s, np.uint64))
            owners.append(np.frombuffer(n, ">u8").reshape(-1, 2)[np.frombuffer(w, "<u4")].astype(np.uint64))
    if not sigs:
        return
    sig, own = np.concatenate(sigs), np.concatenate(owners)
    order = np.argsort(sig, kind="stable")
    sig = sig[order]
    same = np.zeros(len(sig), bool)
    same[1:] = sig[1:] == sig[:-1]
    same[:-1] |= same[1:]
    sig, own = sig[same], own[order[same]]
    order = np.lexsort((own[:, 1], own[:, 0], sig))
    sig, own = sig[order], own[order]
    begins = np.ones(len(sig), bool)
    begins[1:] = sig[1:] != sig[:-1]
    leader = own[np.flatnonzero(begins)[np.cumsum(begins) - 1]] if len(sig) else own
    apart = (leader != own).any(1)
    pairs = np.unique(np.concatenate([leader[apart], own[apart]], 1), axis=0) if apart.any() else np.zeros((0, 4), np.uint64)
    raw = pairs.astype(">u8")
    for begin in range(0, len(raw), 50_000):
        some = raw[begin : begin + 50_000]
        fixed = lambda x: pa.array(np.ascontiguousarray(x).view("V16").ravel().tolist(), pa.binary())
        yield pa.RecordBatch.from_arrays([fixed(some[:, :2]), fixed(some[:, 2:])], names=["leader", "member"])


def find(parent: list[int], k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = parent[k]
    return k


def lead(parent: list[int], k: int) -> None:
    """Make k the root of its tree."""
    parent[find(parent, k)] = k
    parent[k] = k


def groups_of(whole: pa.Table, key: list[str]) -> Iterator[tuple[int, int]]:
    """Row ranges of the groups of a table sorted by ``key``."""
    n = whole.num_rows
    begins = np.zeros(n, bool)
    begins[0] = True
    for k in key:
        codes = whole.column(k).chunk(0).dictionary_encode().indices.to_numpy()
        begins[1:] |= codes[1:] != codes[:-1]
    at = np.flatnonzero(begins)
    yield from zip(at.tolist(), [*at[1:].tolist(), n], strict=True)


UNIT = ["leader", "a", "b"]


def possible_links(measure: Measure):
    """Of each unit, the pairs whose bound lets them link, as stars (u, v) of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, UNIT, 20_000):
            sizes, members = whole.column("n").to_numpy(), whole.column("member")
            rows, heads = [], []
            leads = pc.equal(members, whole.column("leader")).to_numpy()
            data, at = buffers(whole.column("histogram").chunk(0))
            for low, high in groups_of(whole, UNIT):
                if high - low < 2:
                    continue
                order = low + np.argsort(sizes[low:high], kind="stable")
                n = sizes[order]
                h = [counts_of(data[at[k] : at[k + 1]]) for k in order]
                ends = np.searchsorted(n, measure.den * n // measure.num, "right")
                parent = list(range(len(order)))
                size = 0
                for i in range(len(order) - 1):
                    if ends[i] > i + 1:
                        if len(h[i]) != size or reach < ends[i]:  # as many buckets as the smaller set has
                            size, begin, reach = len(h[i]), i, max(int(ends[i]), int(np.searchsorted(n, 2 * n[i])))
                            level = np.array([folded(x, size) for x in h[begin:reach]], np.uint16)
                        most = np.minimum(level[i - begin], level[i + 1 - begin : ends[i] - begin]).sum(1, dtype=np.int64)
                        for j in np.flatnonzero(measure.links(most, n[i], n[i + 1 : ends[i]])):
                            parent[find(parent, i + 1 + int(j))] = find(parent, i)
                for k in np.flatnonzero(leads[order])[:1].tolist():
                    lead(parent, k)
                for k in range(len(order)):
                    if (r := find(parent, k)) != k:
                        rows.append(int(order[k]))
                        heads.append(int(order[r]))
            if rows:
                yield pa.RecordBatch.from_arrays([members.take(pa.array(rows)).combine_chunks(), members.take(pa.array(heads)).combine_chunks()], names=["u", "v"])

    return releasing(run)


def blocks_for(n: str = "n"):
    return F.greatest(F.ceil(F.sum(n) / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int")


def block_of(blocks: str):
    return F.pmod(F.xxhash64("member"), F.col(blocks)).cast("int")


def linked(members: DataFrame, run) -> DataFrame:
    """Links (u, v) that connect within every group of (leader, member, n) what is to be connected; leaders are members.

    ``run`` compares all pairs of each unit (leader, a, b) and gives stars, whose centre is the leader where it takes part.
    A group beyond a block is cut by hash, with the leader in every block; then what isn't connected with the leader meets
    all others, block by block.  Two members that are both connected with the leader needn't meet.
    """
    sizes = members.groupBy("leader").agg(blocks_for().alias("blocks")).where(F.col("blocks") > 1)
    sizes = materialize(sizes.select(F.col("leader").alias("_l"), "blocks"), "shingle-large-groups")
    columns = members.columns
    dealt = members.join(sizes, F.col("leader") == F.col("_l"), "left")
    own = F.when(F.col("_l").isNull(), F.array(F.lit(0))).when(F.col("leader") == F.col("member"), F.expr("sequence(0, blocks - 1)")).otherwise(F.array(block_of("blocks")))
    units = dealt.withColumn("a", F.explode(own)).withColumn("b", F.col("a")).select(*columns, "a", "b")
    links = materialize(run(units), "shingle-links")
    if sizes.isEmpty():
        return links
    done = links.select(F.col("v").alias("_l2"), F.col("u").alias("_m"))
    many = members.join(sizes, F.col("leader") == F.col("_l"))
    apart = (F.col("leader") != F.col("member")) & F.col("_m").isNull()
    many = many.join(done.distinct(), (F.col("leader") == F.col("_l2")) & (F.col("member") == F.col("_m")), "left").withColumn("apart", apart)
    many = materialize(many.select(*columns, "blocks", "apart"), "shingle-many")
    few = many.where("apart").groupBy("leader").agg(blocks_for().alias("parts"))
    few = materialize(few.select(F.col("leader").alias("_l"), "parts"), "shingle-apart")
    if not few.isEmpty():
        rest = many.join(few, F.col("leader") == F.col("_l"))
        alone = rest.where("apart").withColumns({"mine": block_of("parts"), "other": F.explode(F.expr("sequence(0, parts - 1)"))})
        alone = alone.select(*columns, F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"))
        guests = rest.where("apart").select(*columns, block_of("parts").alias("a"), F.explode(F.expr("sequence(-blocks, -1)")).alias("b"))
        hosts = rest.where("not apart").select(*columns, F.explode(F.expr("sequence(0, parts - 1)")).alias("a"), (-1 - block_of("blocks")).alias("b"))
        links = materialize(links.unionByName(run(alone.unionByName(guests).unionByName(hosts))), "shingle-links")
    discard(sizes, many, few)
    return links


def shingle_rows(measure: Measure):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text"):
            sets = shingle_sets(*buffers(rows.column("text")), measure.k)
            yield pa.RecordBatch.from_arrays(
                [rows.column("units"), pa.array([node_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["units", "member", "tokens"],
            )

    return releasing(run)


def verify(measure: Measure):
    """Links of each unit, as stars of its components; every pair of sizes that fit is counted exactly."""

    def links(sets: list[np.ndarray], leader: int | None) -> list[tuple[int, int]]:
        n = np.array([len(s) for s in sets])
        order = np.argsort(n, kind="stable")
        n = n[order]
        tokens, ids = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
        owner = np.repeat(np.arange(len(order)), n)
        by_token = np.argsort(ids, kind="stable")
        owners, starts = owner[by_token], np.searchsorted(ids[by_token], np.arange(len(tokens) + 1))
        at = np.concatenate([[0], np.cumsum(n)])
        ends = np.searchsorted(n, measure.den * n // measure.num, "right")
        parent = list(range(len(order)))
        for i in range(len(order) - 1):
            if ends[i] == i + 1:
                continue
            mine = ids[at[i] : at[i + 1]]
            lengths = starts[mine + 1] - starts[mine]
            total = int(lengths.sum())
            where = np.arange(total) + np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
            overlap = np.bincount(owners[where], minlength=len(order))[i + 1 : ends[i]]
            for j in np.flatnonzero(measure.links(overlap, n[i], n[i + 1 : ends[i]])):
                parent[find(parent, i + 1 + int(j))] = find(parent, i)
        if leader is not None:
            lead(parent, int(np.flatnonzero(order == leader)[0]))
        return [(int(order[k]), int(order[r])) for k in range(len(order)) if (r := find(parent, k)) != k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, UNIT):
            nodes, tokens = whole.column("member").to_pylist(), whole.column("tokens")
            u, v = [], []
            for low, high in groups_of(whole, UNIT):
                distinct = {nodes[k]: k for k in range(low, high)}
                if len(distinct) < 2:
                    continue
                names = list(distinct)
                leader = whole.column("leader")[low].as_py()
                for a, b in links([np.frombuffer(tokens[k].as_py(), np.uint64) for k in distinct.values()], names.index(leader) if leader in distinct else None):
                    u.append(names[a])
                    v.append(names[b])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    return releasing(run)


def near_duplicates(docs: DataFrame, measure: Measure) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash and root (the component's least node; null without shingles) of every row.

    Null text is empty.  Sets without shingles link with nothing: their component is their own doc_id.  A
    component's id is its smallest doc_id; rows with a null doc_id take part, and get their component's id, which is
    null if no row of it has one.  Rows with a repeated doc_id are rows like others.
    """
    spark = docs.sparkSession
    buckets = partitions(spark)
    text = docs.select("doc_id", text_or_empty().alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    found = text.withColumn("text_hash", F.xxhash64("text")).mapInArrow(describe(measure), f"kind int, doc_id {kind}, text_hash long, node binary, n long, histogram binary, token long")
    found = materialize(found, "shingle-sets")
    often = found.where("kind = 1").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_LEAST).orderBy(F.desc("n"), "token").limit(FREQUENT_MOST)
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r["token"] for r in often.collect()], np.int64).view(np.uint64)).tobytes())
    sets = found.where((F.col("kind") == 0) & F.col("node").isNotNull())
    nodes = materialize(sets.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("sample"), F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("histogram").alias("histogram")), "shingle-nodes")

    packed = text.select("text").mapInArrow(index_signatures(measure, frequent, buckets), "bucket int, signatures binary, who binary, nodes binary")
    stars = packed.repartition(buckets, "bucket").mapInArrow(star_rows, "leader binary, member binary")
    stars = materialize(stars.distinct(), "shingle-stars")
    members = stars.unionByName(stars.select("leader", F.col("leader").alias("member")).distinct())
    members = members.join(nodes.select(F.col("node").alias("_n"), "n"), F.col("member") == F.col("_n")).drop("_n")

    def bounded(units: DataFrame) -> DataFrame:
        units = units.drop("n").join(nodes.select(F.col("node").alias("_n"), "n", "histogram"), F.col("member") == F.col("_n")).drop("_n")
        units = units.select(*UNIT, "member", "n", "histogram").repartition(buckets, *UNIT).sortWithinPartitions(*UNIT)
        return units.mapInArrow(possible_links(measure), "u binary, v binary")

    clusters = components(linked(members, bounded))
    clusters = clusters.withColumnRenamed("node", "member").join(nodes.select("node", "n", "sample"), F.col("member") == F.col("node")).drop("node")
    clusters = materialize(clusters.withColumnRenamed("root", "leader"), "shingle-clusters")
    discard(stars)

    def exact(units: DataFrame) -> DataFrame:
        wanted = units.groupBy("member").agg(F.collect_list(F.struct(*UNIT)).alias("units"), F.first("sample").alias("sample"))
        wanted = materialize(wanted.select(F.col("sample.doc_id").alias("_d"), F.col("sample.text_hash").alias("_h"), "units"), "shingle-wanted")
        size = wanted.agg(F.sum(F.size("units") * 44 + 40)).collect()[0][0] or 0
        some = F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted
        of_wanted = text.join(some, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_h")))
        tokens = of_wanted.select("text", "units").mapInArrow(shingle_rows(measure), "units array<struct<leader:binary, a:int, b:int>>, member binary, tokens binary")
        tokens = tokens.select(F.explode("units").alias("u"), "member", "tokens").select("u.*", "member", "tokens")
        return tokens.repartition(buckets, *UNIT).sortWithinPartitions(*UNIT).mapInArrow(verify(measure), "u binary, v binary")

    roots = materialize(components(linked(clusters, exact)), "shingle-roots")

    ids = nodes.select("node", F.col("doc_id").alias("own_id"))
    named = roots.withColumnRenamed("node", "_n")
    of_node = ids.join(named, F.col("node") == F.col("_n"), "left").withColumn("root", F.coalesce("root", "node")).select("node", "root", "own_id")
    least = of_node.groupBy("root").agg(F.min("own_id").alias("component_id")).withColumnRenamed("root", "_r")
    final = materialize(of_node.join(least, F.col("root") == F.col("_r")).select(F.col("node").alias("_n"), "root", "component_id"), "shingle-components")
    discard(nodes, clusters, roots)
    out = found.where("kind = 0").select("doc_id", "text_hash", "node", "n").join(final, F.col("node") == F.col("_n"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "text_hash", "root")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), Measure(4, 85, 100)).select("doc_id", "n_shingles", "component_id")


OP7_SQL = r"""
WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM o JOIN n AS x ON x.doc_id = u JOIN n AS y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l)
SELECT * FROM (WITH RECURSIVE r(doc_id, m) AS (SELECT doc_id, doc_id FROM t UNION SELECT e.u, r.m FROM r JOIN e ON e.v = r.doc_id WHERE r.m < e.u)
  SELECT t.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.m) AS component_id FROM t LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY t.doc_id)
"""
