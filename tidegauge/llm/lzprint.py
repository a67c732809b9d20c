"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (each the shortest prefix of the rest that is not a phrase yet), the
phrases are hashed, and the smallest hash of each of ``BINS`` bins is the text's signature. The likeness of two
texts is the share of bins that agree among the bins that either fills: an estimate of the Jaccard index of the
phrase sets, which follows how well one text compresses given the other.

Every document is also compared with an edited copy that ends in the next document's beginning. Spark sorts the
documents into ranges, and a task streams through its range holding two documents at a time. Rows of one doc_id are
parted by a hash of their text and equal rows by their place in the input, so that no id is bound to one range. The
last document of a range meets the first of the next in a second, small pass.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.llm._shared import written

BINS = 64
EMPTY = 0xFFFF
#: Rows of a range, and ranges at most: a task streams, so that longer ranges cost time and no memory.
RANGE_ROWS = 2_048
MAX_RANGES = 100_000


def parse(text: str, seen: set[str], held: str = "") -> str:
    """Add the phrases of ``text`` to ``seen``, starting with an unfinished phrase; returns the one left unfinished."""
    add = seen.add
    for c in text:
        held += c
        if held not in seen:
            add(held)
            held = ""
    return held


def signature(phrases: set[str], rest: str) -> np.ndarray:
    """``BINS`` 16-bit values: per bin (the hash's top bits) the smallest hash, ``EMPTY`` if there is none."""
    crc = zlib.crc32
    h = np.array([crc(p.encode()) for p in phrases] + ([crc(rest.encode())] if rest else []), np.uint64)
    h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)  # wraps: a multiplicative mix of the CRC
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h = np.sort(h)
    bins = (h >> np.uint64(58)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]])) if len(h) else np.array([], np.int64)
    out = np.full(BINS, EMPTY, np.uint16)
    # 58 bits are left below the bin; sixteen of them from the middle tell minima apart
    out[bins[first]] = np.minimum((h[first] >> np.uint64(20)) & np.uint64(0xFFFF), np.uint64(EMPTY - 1)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a != EMPTY) | (b != EMPTY)
    return float(((a == b) & filled).sum() / filled.sum()) if filled.any() else 1.0


def as_text(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


class _Parsed:
    """A document: its signature, and the parse as it stood where the edit begins."""

    def __init__(self, doc_id, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        cut = len(self.text) - len(self.text) // 4
        self.kept, self.seen = self.text[:cut], set()
        self.held = parse(self.kept, self.seen)
        seen = self.seen.copy()
        rest = parse(self.text[cut:], seen, self.held)
        self.sig = signature(seen, rest)

    def row(self, after: _Parsed) -> tuple:
        tail = after.text[: len(self.text) - len(self.kept)]
        edited = signature(self.seen, parse(tail, self.seen, self.held))  # the last use of the parse
        return (
            self.doc_id,
            len(self.text),
            hashlib.sha256((self.kept + tail).encode()).hexdigest(),
            as_text(self.sig),
            as_text(edited),
            likeness(self.sig, edited),
            likeness(self.sig, after.sig),
        )


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
#: A range's first (0) and last (1) document, its place in the order and its text; ``edge`` is null for results.
_EDGE = "edge int, id long, hash long, row long, text string"
_EDGE_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in order: each but the last meets its successor; the first and the last are given out too."""
    names, types = [*_NAMES, *(x.split()[0] for x in _EDGE.split(", "))], [*_TYPES, *_EDGE_TYPES]
    current, place = None, None

    def edge(kind: int) -> tuple:
        return (current.doc_id, *[None] * (len(_TYPES) - 1), kind, *place, current.text)

    for batch in batches:
        rows = []
        keys = [batch.column(c).to_pylist() for c in ("doc_id", "id", "hash", "row")]
        for doc_id, *at, text in zip(*keys, batch.column("text"), strict=True):
            own = _Parsed(doc_id, text.as_py())
            if current is not None:
                rows.append((*current.row(own), *[None] * len(_EDGE_TYPES)))
            first = current is None
            current, place = own, at
            if first:
                rows.append(edge(0))
        if rows:
            yield _batch(rows, names, types)
    if current is not None:
        yield _batch([edge(1)], names, types)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")), strict=True)
        yield _batch([_Parsed(i, a).row(_Parsed(None, b)) for i, a, b in rows], _NAMES, _TYPES)


def lz_fingerprints(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per row of
    ``docs(doc_id, text)``; other columns are not read.

    A null text is empty. The next document is the one with the next doc_id, after the last the first; a null
    doc_id counts as the lowest. Rows that share a doc_id follow each other in the order of a hash of their text, equal
    ones in the order of the input. A single document is its own next one. An empty table gives an empty result.
    """
    n_ranges = max(1, min(MAX_RANGES, -(-docs.count() // range_rows)))
    order = ["id", "hash", "row"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(
        F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"), "doc_id", "text"
    )
    dealt = rows.repartitionByRange(n_ranges, *order).sortWithinPartitions(*order).mapInArrow(_stream, f"{_OUT}, {_EDGE}")
    ranges = written(dealt, "ranges")
    edges = ranges.where("edge is not null").select("edge", *order, "doc_id", "text")
    # two keys a range, no texts: at most 2 * MAX_RANGES rows meet in one task
    along = Window.orderBy(*order, "edge")
    follower = F.coalesce(F.lead("row").over(along), F.first("row").over(along))
    after = edges.select("edge", F.col("row").alias("at"), follower.alias("next")).where("edge = 1").select("at", "next")
    heads = edges.where("edge = 0").select(F.col("row").alias("next"), F.col("text").alias("next_text"))
    pairs = edges.where("edge = 1").join(after, F.col("row") == F.col("at")).join(heads, "next").select("doc_id", "text", "next_text")
    return ranges.where("edge is null").select(*_NAMES).union(pairs.mapInArrow(_meet, _OUT))
