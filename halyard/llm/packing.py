"""Packing of token streams into windows by Karmarkar-Karp multiway differencing.

A document's tokens are cut at multiples of the window; full pieces are windows of their own.  The rests
are dealt into blocks by hash, and every block is partitioned into near-equal windows: each rest
starts as a partial partition, and the two partial partitions of largest spread are merged again and
again, the large sums of one meeting the small sums of the other.  When a window exceeds the
capacity, the block is partitioned anew with one window more.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, releasing, slices, table, take_ranges

WINDOW = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Rests that are partitioned together, on average.
BLOCK_RESTS = 1024
SLICE = 4 << 20
LETTER_THEN_MARK = "([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?]+)"
#: The pre-tokenizer that never joins a letter with the punctuation after it, and drops white space.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What this normalizer and the pre-tokenizer's second step do to a text; words of LETTERS alone need only their last parts.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
AS_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
#: Words that are one piece to the pre-tokenizer, in composed letters that Python lower-cases like the tokenizer, one for one.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Words that the tokenizer takes as one text; it cuts at blanks, so each is encoded as if alone.
JOINED_WORDS = 100
#: Distinct words whose ids a Python worker remembers.
MEMORY_WORDS = 200_000


def parts_of(step: dict | None, many: str) -> list[dict]:
    """The steps of a tokenizer's normalizer or pre-tokenizer, which may be a sequence."""
    return [] if step is None else step[many] if step["type"] == "Sequence" else [step]


class WordIds:
    """Ids of whole texts through ids of their words, each encoded once while it is remembered.

    That holds for tokenizers that cut at white space and drop it; others get whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads would hold memory of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.lowers = any(n["type"] == "Lowercase" for n in parts_of(config.get("normalizer"), "normalizers"))
        first = (parts_of(config.get("pre_tokenizer"), "pretokenizers") or [{}])[0]
        self.by_word = first.get("pattern") == {"Regex": WORD_SPLIT} and first.get("behavior") == "Removed" and first.get("invert") is True
        self.letters, self.last = self.without_rules(config) if self.by_word else (None, None)
        self.known: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lengths, self.hits = (np.zeros(1 << 12, np.int64) for _ in range(3))

    def without_rules(self, config: dict):
        """A tokenizer of the same model that cuts at blanks alone, and which ids end a piece; nothing for other rules or models."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        rest, model = parts_of(config["pre_tokenizer"], "pretokenizers")[1:], config["model"]
        suffix = model.get("end_of_word_suffix")
        if parts_of(config.get("normalizer"), "normalizers") != NORMALIZERS or len(rest) != 1 or not suffix or model.get("dropout"):
            return None, None
        if any(rest[0].get(k) != v for k, v in AS_BYTES.items()):
            return None, None
        letters = Tokenizer(self.tokenizer.model)
        letters.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        last = np.zeros(max(vocabulary.values()) + 1, bool)
        last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        return letters, last

    def forget(self) -> None:
        """Keep the words that were met again since they were learned."""
        names = list(self.known)
        kept = np.flatnonzero(self.hits[: len(names)] > 1)
        if 2 * len(kept) > MEMORY_WORDS:
            kept = kept[:0]
        lengths = self.lengths[kept]
        ids = self.ids[take_ranges(self.starts[kept], lengths)]
        self.ids, self.used = np.concatenate([ids, np.zeros(1 << 16, np.int32)]), len(ids)
        self.starts = np.concatenate([np.cumsum(lengths) - lengths, np.zeros(1 << 12, np.int64)])
        self.lengths = np.concatenate([lengths, np.zeros(1 << 12, np.int64)])
        self.hits = np.concatenate([np.ones(len(kept), np.int64), np.zeros(1 << 12, np.int64)])
        self.known = {names[k]: i for i, k in enumerate(kept.tolist())}

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and how many each has; many go through the tokenizer as one text."""
        texts = [" ".join(words[i : i + JOINED_WORDS]) for i in range(0, len(words), JOINED_WORDS)]
        coded = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in coded), np.int32)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # in code points, with a blank after each
        before = np.concatenate([[0], ends])[0 : len(words) : JOINED_WORDS]
        counts = [len(e) for e in coded]
        starts = np.fromiter(chain.from_iterable(map(itemgetter(0), e.offsets) for e in coded), np.int64, len(ids))
        return ids, np.bincount(np.searchsorted(ends, starts + np.repeat(before, counts), "right"), minlength=len(words))

    def encode_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words of LETTERS: each is one piece, so its last id tells where it ends."""
        texts = [" ".join(words[i : i + JOINED_WORDS]).lower() for i in range(0, len(words), JOINED_WORDS)]
        coded = self.letters.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in coded), np.int32)
        ends = np.flatnonzero(self.last[ids])
        return (ids, np.diff(ends, prepend=-1)) if len(ends) == len(words) else self.encode_words(words)

    def learn(self, words: list[str], encode) -> None:
        for begin in range(0, len(words), 10_000):
            some = words[begin : begin + 10_000]
            fresh, lengths = encode(some)
            if (end := self.used + len(fresh)) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(fresh)), np.int32)])
            n = len(self.known)
            if n + len(some) > len(self.starts):
                self.starts, self.lengths, self.hits = (np.concatenate([x, np.zeros(max(len(x), len(some)), np.int64)]) for x in (self.starts, self.lengths, self.hits))
            self.ids[self.used : end] = fresh
            self.lengths[n : n + len(some)] = lengths
            self.starts[n : n + len(some)] = self.used + np.cumsum(lengths) - lengths
            self.known.update(zip(some, range(n, n + len(some)), strict=True))
            self.used = end

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, END_ID after each text, and offsets of the texts (one more than there are texts)."""
        if not self.by_word:
            coded = self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)
            ends = np.cumsum([len(e) for e in coded], dtype=np.int64)
            ids = np.fromiter(chain.from_iterable(e.ids for e in coded), np.int32)
            return np.insert(ids, ends, END_ID), np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
        # a token never spans a letter and the punctuation after it, so words are met more often when cut there
        if self.lowers:
            texts = pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts)  # as the tokenizer will
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, LETTER_THEN_MARK, r"\1 \2"))
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(lists.values.slice(bounds[0], bounds[-1] - bounds[0]))
        bounds -= bounds[0]
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > MEMORY_WORDS:
            self.forget()
        found = list(map(self.known.get, words))
        new = [k for k, i in enumerate(found) if i is None]
        plain = {k for k in new if LETTERS(words[k])} if self.letters else set()
        for some, encode in ((sorted(plain), self.encode_letters), ([k for k in new if k not in plain], self.encode_words)):
            n = len(self.known)
            self.learn([words[k] for k in some], encode)
            for i, k in enumerate(some, n):
                found[k] = i
        index = np.array(found, np.int64)
        self.hits[index] += 1
        starts, lengths = self.starts[index], self.lengths[index]
        at = coded.indices.to_numpy()
        lengths = lengths[at] if len(at) else np.zeros(0, np.int64)
        ids = self.ids[take_ranges(starts[at] if len(at) else lengths, lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[bounds[1:]]
        return np.insert(ids, ends, END_ID), np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])


_coders: dict[str, WordIds] = {}


def cut_into_pieces(path: str, window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _coders:
            _coders[path] = WordIds(path)
        coder = _coders[path]
        for rows in slices(batches, "text", SLICE):
            texts = rows.column(rows.schema.get_field_index("text")).fill_null("")
            ids, at = coder.encode(texts)
            total = np.diff(at)
            pieces = -(-total // window)
            doc = np.repeat(np.arange(len(total)), pieces)
            start = take_ranges(np.zeros(len(total), np.int64), pieces) * window
            length = np.minimum(window, total[doc] - start)
            raw = memoryview(ids.astype("<u4")).cast("B")
            low, high = (at[doc] + start) * 4, (at[doc] + start + length) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            columns = [rows.column(rows.schema.get_field_index("doc_id")).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[doc])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array([bytes(raw[a:b]) for a, b in zip(low.tolist(), high.tolist(), strict=True)], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        coder.forget()

    return releasing(run)


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """Indexes of ``sizes`` in ``ways`` sets of near-equal sums, by largest differencing.

    A partial partition is kept as its non-empty sets, largest first: (sum, tree of indexes).
    """
    heap = [(-s, k, [(s, k)]) for k, s in enumerate(sizes)]  # of one non-empty set: the spread is its sum
    heapq.heapify(heap)
    stamp = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        meet = len(a) + len(b) - ways  # sets that have to be united: the smallest of one with the largest of the other
        if meet <= 0:
            union = a + b
        else:
            # a's sets at ways-1-j face b's set j, so b's first ``meet`` sets face a's last ones
            joined = [(a[ways - 1 - j][0] + b[j][0], (a[ways - 1 - j][1], b[j][1])) for j in range(ways - len(a), len(b))]
            union = a[: ways - len(b)] + joined + b[: ways - len(a)]
        union.sort(key=itemgetter(0), reverse=True)
        spread = union[0][0] - (union[-1][0] if len(union) == ways else 0)
        heapq.heappush(heap, (-spread, stamp, union))
        stamp += 1
    sets = []
    for _, tree in heap[0][2] if heap else []:
        members, todo = [], [tree]
        while todo:
            t = todo.pop()
            if isinstance(t, tuple):
                todo += t
            else:
                members.append(t)
        sets.append(sorted(members))
    return sets


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``: one more whenever the fullest exceeds it."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = difference(sizes, ways)
        if all(sum(sizes[k] for k in s) <= capacity for s in sets):
            return sets
        ways += 1


def pack_block(window: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        full = rows["length"].to_numpy() == window
        rests = np.flatnonzero(~full)
        sets = windows([int(x) for x in rows["length"].to_numpy()[rests]], window) if len(rests) else []
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for w, members in enumerate(sets):
            at = rests[members]
            lengths = rows["length"].to_numpy()[at]
            sequence[at], offset[at] = w, np.cumsum(lengths) - lengths
        sequence[full] = len(sets) + np.arange(int(full.sum()))
        return rows.assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset).drop(columns="block")

    return run


def pack(docs: DataFrame, path: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Null text is empty: a piece of the end id alone.  Rows with a null or repeated doc_id are documents of their
    own.  Windows are near-equal within a block, and no id is dropped or repeated.  Pieces are dealt by their row in the
    written table too, so equal ones spread over the blocks like others.
    """
    kind = dict(docs.dtypes)["doc_id"]
    fields = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    pieces = materialize(docs.select("doc_id", "text").mapInArrow(cut_into_pieces(path, window, with_ids), fields), "pieces")
    blocks = max(1, round(pieces.where(F.col("length") < window).count() / BLOCK_RESTS))
    block = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(blocks)).cast("long")
    return pieces.withColumn("block", block).groupBy("block").applyInPandas(pack_block(window), fields + ", sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
