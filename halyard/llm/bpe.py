"""Byte-level BPE as Spark expressions.

Text is cut by the vocabulary's pattern; a word is the array of its UTF-8 bytes, and a fold merges the
neighbouring pieces of lowest rank, leftmost first, until no neighbours have a rank.  The ranks are
a literal in the plan: an array of small maps, entered by a hash of the piece, so a look-up costs the
same for any vocabulary.  Bytes are written as the characters U+0000 to U+00FF, so pieces are strings.

Only distinct words are folded, each of them once.  Documents are cut into words and put together in slices, in which a word is
a code.  A slice's distinct words are dealt by hash, so all of one kind meet, are folded there; from there
every slice is told the ids of its words, and puts its documents together again.  Slices are written once, in buckets, so
that only the answers move to them.  Nothing about words passes the driver.  A fold
rebuilds its arrays at every merge, so its time grows with the square of a word's length; the rare words of more than ``LONG``
bytes have their merges ordered by a heap over linked pieces instead.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, collect_garbage, delete, materialize, partitions, release, releasing, table, take_ranges, text_or_empty

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BUCKETS = 1 << 16
NO_RANK = (1 << 31) - 1
#: Bytes beyond which a word is merged by a heap.
LONG = 256
#: Words of a slice, as far as whole documents allow, and words that are looked up together.
SLICE_WORDS, ASKED_WORDS = 1_000_000, 1_000_000
#: Level of compression of what lies on disk or moves.
LEVEL = 6


def murmur3(data: bytes) -> int:
    """Spark's ``hash`` of a string: 32-bit Murmur3 with seed 42, the last bytes one at a time and signed."""

    def mixed(h: int, k: int) -> int:
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        h ^= (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
        return ((h << 13 | h >> 19) * 5 + 0xE6546B64) & 0xFFFFFFFF

    h, whole = 42, len(data) - len(data) % 4
    for i in range(0, whole, 4):
        h = mixed(h, int.from_bytes(data[i : i + 4], "little"))
    for b in data[whole:]:
        h = mixed(h, (b - 256) & 0xFFFFFFFF if b > 127 else b)
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def read_ranks(path: str) -> list[bytes]:
    """The pieces of a rank file, by rank."""
    with open(path, "rb") as f:
        found = sorted((int(rank), base64.b64decode(piece)) for piece, rank in (line.split() for line in f if line.strip()))
    if [r for r, _ in found] != list(range(len(found))):
        raise ValueError(f"ranks in {path} have gaps")
    return [piece for _, piece in found]


_SPACE, _SOLID = r"\p{IsWhite_Space}", r"\P{IsWhite_Space}"
#: A pattern in common use, and one for Java that cuts alike: alternatives that can't begin with the same character
#: change places, and what never needs to be given back is possessive.
COMMON_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
COMMON_FOR_JAVA = rf" ?+\p{{L}}++|'(?:[stmd]|re|ve|ll)| ?+[^{_SPACE}\p{{L}}\p{{N}}]++| ?+\p{{N}}++|{_SPACE}+(?!{_SOLID})|{_SPACE}++"


def java_pattern(pattern: str) -> str:
    """The pattern for Java, where white space has to be named to be that of Unicode."""
    if pattern == COMMON_PATTERN:
        return COMMON_FOR_JAVA
    return pattern.replace(r"[^\s", "[^" + _SPACE).replace(r"\s", _SPACE).replace(r"\S", _SOLID)


class Coder:
    """Expressions for one vocabulary: pieces by rank, and the pattern that cuts text into words."""

    def __init__(self, pieces: list[bytes], pattern: str):
        maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
        texts = [p.decode("latin-1") for p in pieces]
        for rank, t in enumerate(texts):
            maps[murmur3(t.encode()) % BUCKETS][t] = rank
        self.rank_json, self.pattern = json.dumps(maps), java_pattern(pattern)

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def encode(self, word: Column) -> Column:
        """The ids of a word."""
        ranks = F.from_json(F.lit(self.rank_json), "array<map<string,int>>")

        def rank(table: Column, piece: Column) -> Column:
            return F.get(table, F.hash(piece).bitwiseAND(F.lit(BUCKETS - 1)))[piece]

        def let(value: Column, body) -> Column:
            return F.get(F.transform(F.array(value), body), F.lit(0))

        def folded(table: Column, latin: Column) -> Column:
            def start(p: Column) -> Column:
                return F.struct(p.alias("p"), F.transform(p, lambda x, i: F.coalesce(rank(table, F.concat(x, F.get(p, i + 1))), F.lit(NO_RANK))).alias("r"))

            def merge(s: Column, k: Column) -> Column:
                """Pieces k and k + 1 (from 1) become one; the ranks with its neighbours are looked up anew."""
                p, r = s["p"], s["r"]

                def ranked(piece: Column) -> Column:
                    return F.coalesce(rank(table, piece), F.lit(NO_RANK))

                def join(new: Column) -> Column:
                    with_left, with_right = ranked(F.concat(F.get(p, k - 2), new)), ranked(F.concat(new, F.get(p, k + 1)))
                    pieces = F.transform(p, lambda x, i: F.when(i == k - 1, new).otherwise(x))
                    ranks = F.transform(r, lambda x, i: F.when(i == k - 2, with_left).when(i == k - 1, with_right).otherwise(x))
                    return F.struct(F.filter(pieces, lambda x, i: i != k).alias("p"), F.filter(ranks, lambda x, i: i != k).alias("r"))

                return let(F.concat(F.get(p, k - 1), F.get(p, k)), join)

            def step(s: Column, _: Column) -> Column:
                return let(F.array_position(s["r"], F.array_min(s["r"])).cast("int"), lambda k: F.when(F.get(s["r"], k - 1) == NO_RANK, s).otherwise(merge(s, k)))

            start_at = let(F.filter(F.split(latin, ""), lambda c: c != ""), start)
            return F.aggregate(F.sequence(F.lit(2), F.greatest(F.length(latin), F.lit(2))), start_at, step, lambda s: s["p"])

        def coded(table: Column) -> Column:
            latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
            pieces = let(latin, lambda w: F.when(rank(table, w).isNotNull(), F.array(w)).otherwise(folded(table, w)))
            return F.transform(pieces, lambda x: rank(table, x))

        return let(ranks, coded)


def merged_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: of all neighbours the pair of lowest rank is merged, leftmost first, in time n log n."""
    n = len(word)
    ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that begins at a place
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n + 1)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or ranks.get(word[i : ends[j]]) != rank:
            continue  # one of the two has changed since
        ends[i], after[i], gone[j] = ends[j], after[j], 1
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : ends[after[i]]])) is not None:
                heapq.heappush(heap, (r, i))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k : ends[i]])) is not None:
            heapq.heappush(heap, (r, k))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = after[i]
    return out


def planes(values: np.ndarray) -> bytes:
    """32-bit numbers as their lowest bytes, then the next ones, and so on, which packs better."""
    return np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def packed_words(words: pa.Array, packer: zstandard.ZstdCompressor) -> bytes:
    data, at = buffers(words)
    return packer.compress(len(words).to_bytes(4, "little") + planes(np.diff(at)) + data.tobytes())


def unpacked_words(blob: bytes) -> pa.Array:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    at = np.concatenate([[0], np.cumsum(from_planes(raw[4 : 4 * n + 4]))]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(at), pa.py_buffer(raw).slice(4 * n + 4)])


def home(words: pa.Array, buckets: int) -> np.ndarray:
    """The bucket of every word."""
    return np.fromiter((zlib.crc32(w.encode()) % buckets for w in words.to_pylist()), np.int64, len(words))


def into_slices(buckets: int, kind: pa.DataType):
    """Slices: documents as codes of words (kind 0), and the distinct words by bucket (kind 1); a code's place is that of its word in all buckets."""
    names = ["kind", "slice", "to", "docs", "counts", "places", "codes", "words"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.list_(kind), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def slice_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        whole = pa.Table.from_batches(held).combine_chunks()
        lists = whole.column("words").chunk(0)
        at = lists.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(lists.values.slice(at[0], at[-1] - at[0]))
        words, bucket, at_word = coded.dictionary, home(coded.dictionary, buckets), coded.indices.to_numpy()
        ranked = np.empty(len(words), np.int64)
        ranked[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
        order = np.lexsort((ranked, bucket))  # in order of letters, words and their ids pack well
        place, often = np.empty(len(order), np.int32), np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        common = np.argsort(-np.bincount(at_word, minlength=len(words)), kind="stable")
        often[common] = np.arange(len(order))  # codes by frequency, byte by byte, pack well too
        own = uuid.uuid4().int >> 65  # a written table holds it, so it is drawn once
        rows = [(0, own, None, whole.column("doc_id").to_pylist(), packer.compress(np.diff(at).astype("<u4").tobytes()), packer.compress(planes(place[common])), packer.compress(planes(often[at_word])), None)]
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            rows.append((1, own, b, None, None, None, None, packed_words(words.take(pa.array(order[cuts[b] : cuts[b + 1]])), packer)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for batch in batches:
            ends = batch.column("words").offsets.to_numpy()
            begin = 0
            while begin < batch.num_rows:  # as many rows as there is room for, or one
                end = min(batch.num_rows, max(begin + (not held), int(np.searchsorted(ends, ends[begin] + SLICE_WORDS - words, "right")) - 1))
                if end > begin:
                    held.append(batch.slice(begin, end - begin))
                    words += int(ends[end] - ends[begin])
                if end < batch.num_rows:
                    yield slice_of(held)
                    held, words = [], 0
                    release()
                begin = end
        if held:
            yield slice_of(held)

    return releasing(run)


WORD_OR_LIST = ["kind", "slice", "to", "words", "word", "given"]


def distinct_words(vocabulary):
    """The distinct words of a task's buckets (kind 0), with the ids of long ones, and then the slices' lists (kind 1) as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = pa.array([], pa.string())
        held: list[pa.Array] = []
        size = 0

        def met() -> pa.Array:
            return pc.unique(pa.chunked_array([seen, *held], pa.string()))

        lists = []
        for batch in batches:
            for own, to, blob in zip(*(batch.column(c).to_pylist() for c in ("slice", "to", "words")), strict=True):
                lists.append((own, to, blob))
                held.append(unpacked_words(blob))
                size += len(held[-1])
                if size > max(1_000_000, 2 * len(seen)):
                    seen, held, size = met(), [], 0
        seen = met()
        long = pc.greater(pc.binary_length(seen), LONG).to_numpy(zero_copy_only=False)
        given: dict[int, list[int]] = {}
        if long.any():
            ranks = {p: i for i, p in enumerate(vocabulary.value)}
            given = {k: merged_by_heap(seen[k].as_py().encode(), ranks) for k in np.flatnonzero(long).tolist()}
        seen = seen.combine_chunks() if isinstance(seen, pa.ChunkedArray) else seen
        for i in range(0, len(seen), 10_000):
            some = seen.slice(i, 10_000)
            n = len(some)
            given_here = pa.array([given.get(k) for k in range(i, i + n)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), some, given_here], names=WORD_OR_LIST)
        for own, to, blob in lists:
            row = (1, own, to, blob, None, None)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.list_(pa.int32())), strict=True)], names=WORD_OR_LIST)

    return releasing(run)


@releasing
def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of every slice's words; a partition's folded words (kind 0) come before its lists."""
    packer = zstandard.ZstdCompressor(level=LEVEL)
    words, lists, known, asked, size = [], [], None, [], 0
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        cut = int(np.searchsorted(kinds, 1))
        if cut:
            words.append(batch.column("word").slice(0, cut))
            lists.append(batch.column("ids").slice(0, cut))
        if cut == batch.num_rows:
            continue
        if known is None:
            known, ids = pa.chunked_array(words).combine_chunks(), pa.chunked_array(lists).combine_chunks()
            at, flat = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy()
            words, lists = [], []
        for row in zip(*(batch.column(c).slice(cut).to_pylist() for c in ("slice", "to", "words")), strict=True):
            asked.append((*row[:2], unpacked_words(row[2])))
            size += len(asked[-1][2])
            if size > ASKED_WORDS:
                yield from look_up(asked, known, at, flat, packer)
                asked, size = [], 0
    if asked:
        yield from look_up(asked, known, at, flat, packer)


def look_up(asked: list[tuple], known: pa.Array, at: np.ndarray, flat: np.ndarray, packer: zstandard.ZstdCompressor) -> Iterator[pa.RecordBatch]:
    """Answers to many slices at once: a look-up builds a table of all words first."""
    index = pc.index_in(pa.chunked_array([a[2] for a in asked]).combine_chunks(), value_set=known).to_numpy()
    rows, begin = [], 0
    for own, to, words in asked:
        mine = index[begin : begin + len(words)]
        begin += len(words)
        n = at[mine + 1] - at[mine]
        rows.append((1, own, to, packer.compress(planes(n)), packer.compress(planes(flat[take_ranges(at[mine], n)]))))
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["kind", "slice", "to", "counts", "codes"])


def assemble(vocabulary, digests: bool):
    """Documents of each slice from its codes and the answers of its buckets."""

    def documents(docs: pa.Array, counts: bytes, places: bytes, codes: bytes, answers: list[dict] | None, texts: pa.Array, pieces: pa.Array) -> pa.RecordBatch:
        read = zstandard.ZstdDecompressor().decompress
        answers = sorted(answers or [], key=lambda a: a["to"])
        n = np.concatenate([np.zeros(0, "<i4"), *(from_planes(read(a["counts"])) for a in answers)]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, "<i4"), *(from_planes(read(a["codes"])) for a in answers)])
        code = from_planes(read(places))[from_planes(read(codes))]
        words = np.concatenate([[0], np.cumsum(np.frombuffer(read(counts), "<u4"), dtype=np.int64)])
        lengths = n[code]
        ids = flat[take_ranges((np.cumsum(n) - n)[code], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[words]
        offsets, index = pa.array(ends.astype(np.int32)), pa.array(ids)
        told = pc.binary_join(pa.ListArray.from_arrays(offsets, texts.take(index)), ",")
        decoded = pc.binary_join(pa.ListArray.from_arrays(offsets, pieces.take(index)), b"")
        if digests:
            told, decoded = (pa.array([hashlib.sha256(x).hexdigest() for x in column.cast(pa.binary()).to_pylist()]) for column in (told, decoded))
        return pa.RecordBatch.from_arrays([docs, pa.array(np.diff(ends)), told, decoded], names=["doc_id", "n_tokens", "ids", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(vocabulary.value, pa.binary())
        texts = pa.array([str(i) for i in range(len(pieces))])
        for batch in batches:
            lists = batch.column("docs")
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("counts", "places", "codes", "answers")), strict=True)):
                yield documents(lists.slice(i, 1).flatten(), *row, texts, pieces)
                release()

    return releasing(run)


def encode_documents(docs: DataFrame, pieces: list[bytes], pattern: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by commas) and decoded bytes of every row's whole text, or the SHA-256 of the last two.

    Null text is empty, and gives no ids.  Rows with a null or repeated doc_id are rows like others.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    buckets = partitions(spark)
    coder = Coder(pieces, pattern)
    kind = dict(docs.dtypes)["doc_id"]
    vocabulary = spark.sparkContext.broadcast(pieces)
    cut = docs.select("doc_id", coder.words(text_or_empty()).alias("words"))
    fields = f"slice long, to int, docs array<{kind}>, counts binary, places binary, codes binary, words binary"
    sliced = cut.mapInArrow(into_slices(buckets, to_arrow_type(docs.schema["doc_id"].dataType)), f"kind int, {fields}")
    coded = materialize(sliced, "bpe-slices", 500, "slice", "kind")
    lists = coded.where("kind = 1").select("slice", "to", "words").repartition(buckets, "to")
    met = lists.mapInArrow(distinct_words(vocabulary), "kind int, slice long, to int, words binary, word string, given array<int>")
    ids = F.when(F.col("word").isNotNull(), F.when(F.col("given").isNotNull(), F.col("given")).otherwise(coder.encode(F.col("word"))))
    answers = met.select("kind", "slice", "to", "words", "word", ids.alias("ids")).mapInArrow(answer, "kind int, slice long, to int, counts binary, codes binary")
    answers = materialize(answers, "bpe-answers", 10_000)
    delete(spark, f"{coded._halyard_path}/kind=1")  # the lists have been answered
    collect_garbage(spark)
    answers = answers.groupBy(F.col("slice").alias("of")).agg(F.collect_list(F.struct("to", "counts", "codes")).alias("answers"))
    both = coded.where("kind = 0").join(answers, F.col("slice") == F.col("of"), "left").select("docs", "counts", "places", "codes", "answers")
    return both.mapInArrow(assemble(vocabulary, digests), f"doc_id {kind}, n_tokens long, ids string, bytes {'string' if digests else 'binary'}")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, for all documents."""
    import public_tokenizers

    pieces = read_ranks(public_tokenizers.path(VOCABULARY))
    coded = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces, public_tokenizers.PATTERN, True)
    return coded.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("bytes").alias("decoded_sha256"))
