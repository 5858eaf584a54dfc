"""Secret scans: fixed patterns, and a battery of randomness tests for strings that no pattern knows.

A candidate is a long run of characters of the common encodings.  Its encoding is inferred from its characters, and
the battery asks how far it is from a uniform string over that alphabet: chi-squared of all the alphabet's letters, runs of
values above and below the middle and of character classes, and serial correlation.  The null hypothesis is that a
candidate is structured, as names, paths, words and numbers are.  Its p-value is the share of structured strings of its
encoding and length that look as random: they are simulated from words and numbers, so the p-value holds for any length,
and is large for short strings, which can't be told apart.  Over a document's candidates the false-discovery rate is
controlled (Benjamini-Hochberg), so of what is reported as secret no more than that share is structured, in expectation.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import buffers, slices, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
HEX = re.compile(rb"[0-9a-f]{32,}")
#: What can be a key at all; how sure one can be of a short one is for its p-value to say.
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_-]{12,}={0,2}")
ASSIGN_LEAST = 8
#: Share of structured strings among the reported ones, at most, in expectation.
FALSE_DISCOVERY = 0.005
#: Structured strings that are simulated for an encoding and a length.
SIMULATED = 50_000
#: Lengths for which they are; a candidate is held against the next shorter one, which can only make its p-value larger.
LENGTHS = np.array([12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 26, 28, 30, 32, 36, 40, 48, 56, 64, 80, 96, 128, 192, 256])
SLICE = 4 << 20
_DIGIT, _LOWER, _UPPER = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings, narrowest first: name and the classes of its alphabet, in the order of their values.
ENCODINGS = (
    ("decimal", (_DIGIT,)),
    ("hex", (_DIGIT, b"abcdef")),
    ("HEX", (_DIGIT, b"ABCDEF")),
    ("lower", (_LOWER,)),
    ("upper", (_UPPER,)),
    ("base32", (_UPPER, b"234567")),
    ("alnum36", (_DIGIT, _LOWER)),
    ("ALNUM36", (_DIGIT, _UPPER)),
    ("letters", (_UPPER, _LOWER)),
    ("alnum62", (_UPPER, _LOWER, _DIGIT)),
    ("base64", (_UPPER, _LOWER, _DIGIT, b"+/")),
    ("base64url", (_UPPER, _LOWER, _DIGIT, b"-_")),
    ("any", (_UPPER, _LOWER, _DIGIT, b"+/", b"-_")),
)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every encoding the value and the class of every byte, -1 outside of its alphabet."""
    value, kind = np.full((len(ENCODINGS), 256), -1, np.int16), np.full((len(ENCODINGS), 256), -1, np.int16)
    for e, (_, classes) in enumerate(ENCODINGS):
        for k, members in enumerate(classes):
            for c in members:
                value[e, c], kind[e, c] = (value[e] >= 0).sum(), k
    return value, kind


VALUES, CLASSES = _tables()
_FITS = np.zeros(256, np.uint32)  # bit e: the byte is in encoding e
for _e in range(len(ENCODINGS)):
    _FITS |= (VALUES[_e] >= 0).astype(np.uint32) << np.uint32(_e)


def encodings(matrix: np.ndarray) -> np.ndarray:
    """The narrowest encoding of every row of bytes."""
    both = np.bitwise_and.reduce(_FITS[matrix], axis=1)
    return np.log2((both & (~both + np.uint32(1))).astype(np.float64)).astype(np.int64)


def distances(matrix: np.ndarray, encoding: int) -> np.ndarray:
    """How far rows of bytes are from uniform ones over the encoding's alphabet: the battery's statistics, added up.

    Each is in standard deviations of a uniform string of that length, so that lengths and encodings compare.
    """
    v, kind = VALUES[encoding][matrix].astype(np.int64), CLASSES[encoding][matrix]
    m, n = v.shape
    sizes = np.array([len(c) for c in ENCODINGS[encoding][1]])
    letters = int(sizes.sum())
    counts = np.bincount((np.arange(m)[:, None] * letters + v).ravel(), minlength=m * letters).reshape(m, letters)
    square = (counts.astype(np.float64) ** 2).sum(1) * letters / n - n
    out = np.maximum(0, (square - (letters - 1)) / np.sqrt(2 * (letters - 1) * (n - 1) / n))
    high = v >= letters / 2
    for of, stay in ((high, ((letters // 2) ** 2 + (letters - letters // 2) ** 2) / letters**2), (kind, float((sizes**2).sum()) / letters**2)):
        if stay < 1:
            turns = (of[:, 1:] != of[:, :-1]).sum(1)
            out += np.abs(turns - (n - 1) * (1 - stay)) / np.sqrt((n - 1) * stay * (1 - stay))
    d = v - (letters - 1) / 2
    return out + np.abs((d[:, 1:] * d[:, :-1]).sum(1)) / ((letters**2 - 1) / 12 * np.sqrt(n - 1))


@functools.cache
def vocabulary() -> tuple[str, ...]:
    """Common words: those in the names of Unicode's symbols and pictographs."""
    found = set()
    for block in (range(0x2000, 0x2C00), range(0x1F300, 0x1F700), range(0x1F900, 0x1FA00)):
        for c in block:
            found.update(w for w in re.findall(r"[A-Z]{2,}", unicodedata.name(chr(c), "")) if len(w) < 13)
    return tuple(sorted(w.lower() for w in found))


def structured(encoding: int, length: int, most: int) -> np.ndarray:
    """Simulated structured strings of one encoding and length, as rows of bytes: words and numbers, joined as names are."""
    r = np.random.default_rng([encoding, length])
    fits = {c for members in ENCODINGS[encoding][1] for c in members.decode()}
    lower = [w for w in vocabulary() if set(w) <= fits]
    upper = [w.upper() for w in vocabulary() if set(w.upper()) <= fits]
    title = [w.title() for w in vocabulary() if set(w.title()) <= fits]
    styles = [s for s in (lower, upper, title) if s]
    joints = ["", *[c for c in "_-/+" if c in fits]]
    digits = [c for c in "0123456789" if c in fits]
    runs = [c for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" if c in fits]

    def number() -> str:
        form = r.integers(4)
        if form == 0:
            return "".join(x for x in f"{r.integers(1990, 2031)}{r.integers(1, 13):02d}{r.integers(1, 29):02d}" if x in fits)
        if form == 1:
            return digits[r.integers(len(digits))] * int(r.integers(1, 9))
        if form == 2:
            at = int(r.integers(len(digits)))
            return "".join((digits * 3)[at : at + int(r.integers(2, 10))])
        return "".join(digits[i] for i in r.integers(len(digits), size=int(r.integers(1, 5))))

    def one() -> str:
        style = styles[r.integers(len(styles))] if styles else []
        joint = joints[0] if r.random() < 0.3 else joints[r.integers(len(joints))]
        busy = r.random() * 0.5  # how readily a number comes in
        parts, size, whole = [], 0, int(r.integers(0, 8))
        while size < length + whole:
            if digits and (not style or r.random() < busy):
                parts.append(number())
            elif style and r.random() < 0.97:
                own = style if r.random() < 0.8 else styles[r.integers(len(styles))]
                parts.append(own[r.integers(len(own))])
            else:
                parts.append(runs[r.integers(len(runs))] * int(r.integers(2, 6)))
            size += len(parts[-1]) + len(joint)
        return joint.join(parts)[whole : whole + length].ljust(length, "0" if digits else runs[0])

    out = np.zeros((0, length), np.uint8)
    for _ in range(6):  # strings that a narrower alphabet covers are of another encoding
        rows = np.frombuffer("".join(one() for _ in range(most // 3)).encode(), np.uint8).reshape(-1, length)
        out = np.concatenate([out, rows[encodings(rows) == encoding]])
        if len(out) >= most:
            break
    return out[:most]


@functools.cache
def null_distances(encoding: int, length: int) -> np.ndarray:
    """Distances from uniformity of simulated structured strings, sorted."""
    few = structured(encoding, length, SIMULATED // 10)
    if not len(few):
        return np.zeros(0)
    # segments of simulated strings are put together anew, which is cheap and keeps what a string is made of
    r = np.random.default_rng([length, encoding])
    left, right = few[r.integers(len(few), size=SIMULATED)], few[r.integers(len(few), size=SIMULATED)]
    cut = np.arange(length) < r.integers(0, length + 1, size=SIMULATED)[:, None]
    rows = np.where(cut, left, right)
    return np.sort(distances(rows[encodings(rows) == encoding], encoding))


def p_values(candidates: list[bytes]) -> np.ndarray:
    """The share of structured strings, of a candidate's encoding and length, that are as near to uniform."""
    out = np.ones(len(candidates))
    bodies = [c.rstrip(b"=") for c in candidates]
    lengths = np.array([len(b) for b in bodies])
    for n in np.unique(lengths).tolist():
        if n < LENGTHS[0]:
            continue
        of = np.flatnonzero(lengths == n)
        matrix = np.frombuffer(b"".join(bodies[k] for k in of.tolist()), np.uint8).reshape(-1, n)
        kinds = encodings(matrix)
        for e in np.unique(kinds).tolist():
            mine = np.flatnonzero(kinds == e)
            null = null_distances(e, int(LENGTHS[np.searchsorted(LENGTHS, n, "right") - 1]))
            if len(null):
                for i in range(0, len(mine), 4096):
                    some = mine[i : i + 4096]
                    out[of[some]] = (1 + np.searchsorted(null, distances(matrix[some], e), "right")) / (1 + len(null))
    return out


def discoveries(ps: np.ndarray, rate: float = FALSE_DISCOVERY) -> np.ndarray:
    """Which hypotheses Benjamini and Hochberg's procedure rejects."""
    ordered = np.sort(ps)
    under = np.flatnonzero(ordered <= rate * np.arange(1, len(ps) + 1) / len(ps))
    return ps <= (ordered[under[-1]] if len(under) else -1.0)


def random_ones(candidates: list[bytes]) -> list[bool]:
    """Which candidates of one document are reported as secrets."""
    return discoveries(p_values(candidates)).tolist() if candidates else []


def scan(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, in order; texts in ``data`` are parted by NUL, which no pattern takes."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(data)]
    return sorted(spans)


def by_text(rows: pa.RecordBatch) -> dict[int, tuple[bytes, list[tuple[int, int, int]]]]:
    """For each row with a span (by its index): the text's bytes and spans in bytes: base ones, and random ones that touch none of them."""
    data, at = buffers(rows.column(rows.schema.get_field_index("text")))
    n = rows.num_rows
    joined = np.zeros(len(data) + n, np.uint8)
    keep = np.ones(len(joined), bool)
    keep[at[1:] + np.arange(n)] = False
    joined[keep] = data
    blob, starts = joined.tobytes(), at[:-1] + np.arange(n)
    found: dict[int, tuple[list, list]] = {}
    for s, k, e in scan(blob):
        d = int(np.searchsorted(starts, s, "right")) - 1
        found.setdefault(d, ([], []))[0].append((s - int(starts[d]), k, e - int(starts[d])))
    free = []  # (row, start, end) of candidates
    for m in CANDIDATE.finditer(blob):
        d = int(np.searchsorted(starts, m.start(), "right")) - 1
        s, e = m.start() - int(starts[d]), m.end() - int(starts[d])
        base = found.setdefault(d, ([], []))[0]
        if not base or all(e <= b or s >= c for b, _, c in base):
            free.append((d, s, e))
    if free:
        kinds: dict[bytes, int] = {}
        texts = [blob[starts[d] + s : starts[d] + e] for d, s, e in free]
        index = [kinds.setdefault(t, len(kinds)) for t in texts]
        ps = p_values(list(kinds))[index]
        row = np.array([f[0] for f in free])  # in order
        bounds = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]])).tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            for k in np.flatnonzero(discoveries(ps[a:b])).tolist():
                d, s, e = free[a + k]
                found[d][1].append((s, 3, e))
    out = {}
    for d, (base, more) in found.items():
        if base or more:
            out[d] = (blob[starts[d] : starts[d] + at[d + 1] - at[d]], sorted(base + more))
    return out


def code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in code points, by counting the bytes that begin one."""
    if text.isascii():
        return spans
    begins = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(begins[s]), k, int(begins[e])) for s, k, e in spans]


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    empty = hashlib.sha256(b"").hexdigest()
    for rows in slices(batches, "text", SLICE):
        n = rows.num_rows
        counts = [[0] * n for _ in range(3)]
        base_sha, texts = [empty] * n, [""] * n
        for d, (text, spans) in by_text(rows).items():
            told = code_points(text, spans)
            base = [s for s in told if s[1] < 3]
            for _, k, _ in base:
                counts[k][d] += 1
            base_sha[d], texts[d] = hashlib.sha256(digest(base).encode()).hexdigest(), digest(told)
        yield pa.RecordBatch.from_arrays(
            [rows.column(rows.schema.get_field_index("doc_id")), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_sha), pa.array(texts)],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row's whole text.

    Null text is empty: no spans, and the digest of the empty string.  Equal candidates of a document fare alike.  Spans of a kind don't overlap;
    those of different kinds may, except that ``random`` ones touch no other.  Rows with a null or
    repeated doc_id are rows like others.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(scan_batches, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


MASK = b"[secret]"


def mask(text: bytes, spans: list[tuple[int, int, int]]) -> bytes:
    """The text with every maximal stretch of spans replaced by a mark."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], MASK]
        at = max(at, e)
    return b"".join([*out, text[at:]])


def mask_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, "text", SLICE):
        k = rows.schema.get_field_index("text")
        found = by_text(rows)
        if found:
            texts = rows.column(k).to_pylist()
            for d, (text, spans) in found.items():
                texts[d] = mask(text, spans).decode("utf-8")
            rows = rows.set_column(k, "text", pa.array(texts, rows.schema.field(k).type))
        yield rows


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The documents with their secrets masked in ``text``; other columns and all rows stay as they are."""
    return docs.mapInArrow(mask_batches, docs.schema)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
