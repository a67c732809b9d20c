"""Bulk-synchronous best-fit packing of tokenized documents into sequences.

A superstep deals the unplaced pieces and the gaps of the open sequences to ranges of size, sorts each range and sweeps
it: every piece finds its successor, the smallest gap that holds it; pieces with one successor are ranked, longer ones
first, and claim the gaps from there up to the next successor by rank, the k-th claim the k-th gap; the gaps are
updated, and who came too late asks again until the range has no claim left. What a range leaves over meets the
neighbouring range in the next superstep, where ranges are twice as wide, until there is one range. Where no gap holds
the longest piece left, sequences open and a superstep follows.

Pieces of one length are alike, and so are neighbouring sequences with one gap, so both relations are run-length
encoded: the cluster counts the pieces of each length (at most ``max_tokens`` rows whatever the corpus), and a run is
``n`` sequences from ``first`` on. A task sweeps a few thousand runs at most, and every superstep is written to the
shared folder, so a lost executor costs one superstep; the driver reads one row a superstep, to see whether sequences
have to open. The documents stay distributed: each piece finds its rank within its length by a salted two-level count
(a length that a third of all pieces share is counted in many tasks) and looks its sequence up in the placements of its
length.
"""

from __future__ import annotations

import itertools
import re
import sys
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.llm._shared import TEXT_ROWS, scratch_path, written

MAX_TOKENS = 2048
END_ID = 0
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: Bytes of encoded words that a Python worker remembers, in two generations of half as much.
MEMO_BYTES = 96 << 20


@lru_cache(maxsize=2)
def _tokenizer(definition: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(definition)
    made.encode_special_tokens = True  # a special token's name inside a text is ordinary text
    return made


_memo: dict[bytes, bytes] = {}
_older: dict[bytes, bytes] = {}
_memo_bytes = 0
_TAIL = re.compile(rb"[A-Za-z0-9]([.,!?:;%*&$|#]+)$")


def _stem_and_tail(word: bytes) -> tuple[bytes, bytes]:
    """A word and the punctuation behind its last ASCII letter or digit: the tokenizer always splits there. It also
    folds A-Z, so a stem in ASCII stands for all its spellings."""
    tail = m[1] if (m := _TAIL.search(word)) else b""
    stem = word[: len(word) - len(tail)]
    return (stem.lower() if stem.isascii() else stem), tail


def word_ids(tokenizer, text: str | None) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers, without the end id.

    The tokenizer never merges across ASCII blanks, so words between them are encoded once and remembered, up to
    about ``MEMO_BYTES`` of memory in a Python worker. A word met again moves to the younger generation, so the
    frequent ones stay however many rare ones pass.
    """
    global _memo, _older, _memo_bytes
    words = (text or "").encode().split()
    try:
        return b"".join([_memo[w] for w in words])
    except KeyError:
        if _memo_bytes > MEMO_BYTES // 2:
            _memo, _older, _memo_bytes = {}, _memo, 0
        missing = set(words).difference(_memo)
        new = {w: _stem_and_tail(w) for w in missing if w not in _older}
        parts = {p for pair in new.values() for p in pair}.difference(_memo)
        fresh = [p for p in parts if p not in _older]
        added = {w: _older[w] for w in (missing | parts) if w in _older}
        for p, e in zip(fresh, tokenizer.encode_batch_fast([p.decode() for p in fresh], add_special_tokens=False), strict=True):
            added[p] = array("I", e.ids).tobytes() if _LITTLE else b"".join([i.to_bytes(4, "little") for i in e.ids])
        _memo.update(added)
        for w, (stem, tail) in new.items():
            added[w] = _memo[w] = _memo[stem] + _memo[tail]
        _memo_bytes += sum(len(w) + len(ids) for w, ids in added.items()) + 200 * len(added)
        return b"".join([_memo[w] for w in words])


def token_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids`` as little-endian uint32 bytes): each document's ids
    plus the end id, cut into pieces of ``max_tokens`` where longer."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())  # a fixed vocabulary file, 1.7 MB

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end, step = _tokenizer(definition.value), END_ID.to_bytes(4, "little"), 4 * max_tokens
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = word_ids(tokenizer, text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    cut_rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    )
    return cut_rows if with_ids else cut_rows.drop("ids")


PIECE, GAP, PLACED = 0, 1, 2
#: A row of the supersteps' tables. Pieces: n of length size are left, the next has rank first. Gaps: n sequences from
#: first with size tokens free. Placements: the n pieces of length size from rank first go to the sequences from seq,
#: each of them takes ``each``, at offset and behind.
_RUN = "kind int, size long, first long, n long, each long, seq long, offset long"
_RUN_SCHEMA = pa.schema([(f.split()[0], pa.int32() if f.endswith("int") else pa.int64()) for f in _RUN.split(", ")])
#: Ranges of size in the first superstep; half as many in each one after it.
RANGES = 8

Gap = tuple[int, int, int]  # size, first sequence, number of sequences


def claims(left: dict[int, list[int]], gaps: list[Gap]) -> list[tuple[int, int, int]]:
    """``start, end, length``: the places in the sorted ``gaps`` that the pieces of a length claim, in order, none twice.
    ``left`` has the number of unplaced pieces and the next rank for each length."""
    sizes = [g for g, _, _ in gaps]
    places = list(accumulate([n for _, _, n in gaps], initial=0))
    asking: dict[int, list[tuple[int, int]]] = {}
    for length in sorted(left, reverse=True):
        at = bisect_left(sizes, length)
        if at < len(gaps):
            asking.setdefault(places[at], []).append((length, sizes[at]))
    out = []
    for at, limit in itertools.pairwise([*sorted(asking), places[-1]]):
        for length, size in asking[at]:
            need = -(-left[length][0] // (size // length))
            if at < limit:
                out.append((at, min(at + need, limit), length))
            at += need
    return out


def place(left: dict[int, list[int]], gaps: list[Gap], claimed: list[tuple[int, int, int]]) -> tuple[list[tuple], list[Gap]]:
    """Sweep sorted gaps and claims by place: the placements (``_RUN`` without its kind, with the gap for the offset) and the
    gaps after them. A gap takes as many pieces of the length that claims it as it holds; ``left`` is updated."""
    placements, after, ahead, at = [], [], 0, 0
    for size, first, n in gaps:
        stop = at + n
        while at < stop:
            while ahead < len(claimed) and claimed[ahead][1] <= at:
                ahead += 1
            start, end, length = claimed[ahead] if ahead < len(claimed) else (stop, stop, 0)
            seq = first + n - (stop - at)
            if start > at:  # nobody claims these
                after.append((size, seq, min(start, stop) - at))
                at = min(start, stop)
                continue
            width, each = min(end, stop) - at, size // length
            own = left[length]
            placed = min(own[0], width * each)
            if placed:
                placements.append((length, own[1], placed, each, seq, size))
            own[:] = own[0] - placed, own[1] + placed
            full, over = divmod(placed, each)
            rest = ((size - each * length, seq, full), (size - over * length, seq + full, int(over > 0)), (size, seq + full + (over > 0), width - full - (over > 0)))
            after += [g for g in rest if g[0] and g[2]]
            at += width
    return placements, after


def sweeps(max_tokens: int):
    """A superstep within a range: sweep, resolve, update and repeat until no gap of the range is claimed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: dict[int, list[int]] = {}
        gaps: list[Gap] = []
        for batch in batches:
            for kind, size, first, n in zip(*(batch.column(c).to_pylist() for c in ("kind", "size", "first", "n")), strict=True):
                if kind == GAP:
                    gaps.append((size, first, n))
                else:
                    left[size] = [n, first]
        rows = []
        while claimed := claims({k: v for k, v in left.items() if v[0]}, sorted(gaps)):
            placements, gaps = place(left, sorted(gaps), claimed)
            rows += [(PLACED, *p[:5], max_tokens - p[5]) for p in placements]
        rows += [(PIECE, size, first, n, None, None, None) for size, (n, first) in left.items() if n]
        rows += [(GAP, *g, None, None, None) for g in gaps]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RUN_SCHEMA, strict=True)], schema=_RUN_SCHEMA)

    return run


def to_open(state: DataFrame, max_tokens: int = MAX_TOKENS) -> tuple[int, int]:
    """How many pieces are left, and how many sequences must open: none while a gap holds the longest piece. Else one
    for each piece over half a sequence that no gap holds, as no two of those share one, and at least as many as the
    tokens that no gap holds, or all tokens left less all gaps, would fill."""
    left = state.where(F.col("kind") == PIECE).groupBy("size").agg(F.sum("n").alias("n")).where("n > 0")
    gaps = state.where(F.col("kind") == GAP).agg(F.coalesce(F.max("size"), F.lit(0)).alias("largest"), F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).alias("free"))
    no_gap = F.col("size") > F.col("largest")
    tokens = F.col("size") * F.col("n")
    n, blocked, alone, rest = left.crossJoin(F.broadcast(gaps)).agg(  # gaps is one row
        F.sum("n"), F.sum(F.when(no_gap, tokens)), F.sum(F.when(no_gap & (2 * F.col("size") > max_tokens), F.col("n"))), F.sum(tokens) - F.max("free")
    ).first()
    if not n or not blocked:
        return n or 0, 0
    return n, max(alone or 0, -(-blocked // max_tokens), -(-rest // max_tokens))


def place_lengths(histogram: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """The placements ``size, first, n, each, seq, offset`` of a histogram ``length, count``, by supersteps until nothing is left."""
    spark = histogram.sparkSession
    base, step, opened, ranges = scratch_path(spark, "tables", "supersteps"), 0, 0, RANGES
    none = [F.lit(None).cast("long").alias(c) for c in ("each", "seq", "offset")]
    first = histogram.select(F.lit(PIECE).alias("kind"), F.col("length").alias("size"), F.lit(0).cast("long").alias("first"), F.col("count").alias("n"), *none)
    first.write.parquet(f"{base}/step=0")
    read = lambda: spark.read.schema(_RUN).parquet(f"{base}/step={step}").where(F.col("kind") != PLACED)
    left, fresh = to_open(read(), max_tokens)
    while left:
        runs = read().union(spark.createDataFrame([(GAP, max_tokens, opened, fresh, None, None, None)] if fresh else [], _RUN))
        opened, step = opened + fresh, step + 1
        dealt = runs.repartitionByRange(ranges, "size").sortWithinPartitions("size") if ranges > 1 else runs.coalesce(1)
        dealt.mapInArrow(sweeps(max_tokens), _RUN).write.parquet(f"{base}/step={step}")
        left, fresh = to_open(read(), max_tokens)
        # a wider range may hold what is left; sequences open once there is one range
        if ranges > 1:
            ranges, fresh = ranges // 2, 0
    return spark.read.schema(_RUN).parquet(*[f"{base}/step={k}" for k in range(step + 1)]).where(F.col("kind") == PLACED).drop("kind")


def ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """``pieces`` with ``rank``, gapless from 0 within each length: local in a salt, plus the counts of lower salts."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = salted.groupBy("length", "salt").count().select(
        "length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift")
    )
    local = Window.partitionBy("salt", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    return (
        salted.withColumn("local", F.row_number().over(local) - 1)
        .join(shift, ["salt", "length"])
        .withColumn("rank", F.col("local") + F.col("shift"))
        .drop("salt", "local", "shift")
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``) per piece of ``docs(doc_id, text)``.

    A null or empty text is the end id alone. Rows that repeat a doc_id are packed one by one. An empty table
    gives an empty result. Offsets of a sequence are gapless from 0.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, tokenizer_path, max_tokens, with_ids), "pieces", TEXT_ROWS)
    rows = place_lengths(pieces.groupBy("length").count(), max_tokens)
    # a few placements a length and superstep: bounded by the sequence size, not by the corpus
    by_length = rows.groupBy(F.col("size").alias("length")).agg(
        F.array_sort(F.collect_list(F.struct("first", "n", "each", "seq", F.col("offset").alias("off")))).alias("plan")
    )
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hit = F.element_at(F.filter("plan", lambda p: (p["first"] <= F.col("rank")) & (F.col("rank") < p["first"] + p["n"])), 1)
    placed = ranked(pieces, salts).join(F.broadcast(by_length), "length").withColumn("hit", hit)
    index = F.col("rank") - F.col("hit.first")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("hit.seq") + F.floor(index / F.col("hit.each"))).cast("long").alias("sequence_id"),
        (F.col("hit.off") + F.pmod(index, F.col("hit.each")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
