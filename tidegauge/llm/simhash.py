"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints at most four bits apart leave at least one of five blocks of bits untouched, so the index has one
table for every choice of blocks; a table's top nodes are the shared masked bit patterns (mask = the chosen
blocks, pattern = the fingerprint's bits there) and are dealt over the cluster. Below a top node the members are
sorted by Gray rank, which puts codes that differ in few bits side by side; neighbouring codes are factored into
nodes that hold the bits their members share, level by level, for all top nodes of a task at once. A search walks
down with the differences gathered on the shared bits so far, drops a whole node once they pass four, and drops a
node whose members are all in the searcher's component already. A top node gives out one link per member (to its
local root), never all pairs.

Equal fingerprints are one member, so thousands of exact copies cost nothing here. A top node with more members
than ``CELL_ROWS`` is split by further bits: its other bits are cut into five blocks again, of which one at least is
untouched, and so on until no node is larger.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm._shared import TEXT_ROWS, broadcast_if_small, checkpointed, written
from tidegauge.llm.components import roots

BITS = 64
MAX_DIFFERENCES = 4
SHINGLE_WORDS = 4
SEED = 42
CELL_ROWS = 32_768
FAN_OUT = 16
NODE_ROWS = 512
#: Members that a task solves at once, if no top node alone has more.
BATCH_ROWS = 65_536
#: Seeds of the word-set fingerprints that propose links in ``drop_near_duplicates``.
WORD_SEEDS = (42, 43, 44, 45)
#: Words in a shingle of the fingerprint that confirms them, and its bits that may differ: a similarity of 0.8 differs in
#: 9.7 of 64 bits on average, with a standard deviation of 2.9.
CONFIRM_WORDS = 5
CONFIRM_DIFFERENCES = 14
_MEMO_BYTES = 16 << 20


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # on bytes: only A-Z change, only \x20 \x09-\x0D separate


def shingle_fingerprint(words: list[bytes], n_words: int) -> int:
    """64 bits: a bit is set if it is in over half of the XXH64 values of the word shingles."""
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= n_words:
        return int.from_bytes(digest(line, SEED), "big")
    starts = list(accumulate([len(w) + 1 for w in words], initial=0))
    spans = zip(starts, starts[n_words:])
    n, counts = len(words) - n_words + 1, np.zeros(BITS, np.int64)
    while part := b"".join([digest(line[a : b - 1], SEED) for a, b in itertools.islice(spans, 65_536)]):
        counts += np.unpackbits(np.frombuffer(part, np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: str | None) -> int:
    return shingle_fingerprint(_words(text), SHINGLE_WORDS)


_memo: dict[bytes, bytes] = {}
_memo_bytes = 0


def _word_digest(word: bytes) -> bytes:
    """The word's XXH64 under every seed of ``WORD_SEEDS``; remembered, up to ``_MEMO_BYTES`` of words."""
    global _memo_bytes
    made = b"".join([xxhash.xxh64_digest(word, s) for s in WORD_SEEDS])
    if _memo_bytes > _MEMO_BYTES:
        _memo.clear()
        _memo_bytes = 0
    _memo[word] = made
    _memo_bytes += len(word) + 128
    return made


def word_fingerprints(words: list[bytes]) -> np.ndarray:
    """A fingerprint of the set of words for every seed, as unsigned 64-bit integers; zeros without words."""
    if not words:
        return np.zeros(len(WORD_SEEDS), np.uint64)
    own = set(words)
    joined = b"".join([_memo.get(w) or _word_digest(w) for w in own])
    counts = np.zeros(BITS * len(WORD_SEEDS), np.int64)
    for at in range(0, len(joined), 1 << 20):  # a slice holds whole digests
        counts += np.unpackbits(np.frombuffer(joined[at : at + (1 << 20)], np.uint8)).reshape(-1, len(counts)).sum(axis=0, dtype=np.uint32)
    return np.frombuffer(np.packbits(2 * counts > len(own)).tobytes(), ">u8").astype(np.uint64)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes)], ["doc_id", "code"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, code`` (the fingerprint as a signed long) per row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, code long")


def block_masks(blocks: int) -> list[int]:
    """A mask for every choice of ``blocks - MAX_DIFFERENCES`` of the blocks: four differences leave one whole."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(each, blocks - MAX_DIFFERENCES)]


def deeper_masks(mask: int) -> list[int]:
    """``mask`` with each of five blocks of the bits outside it."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    edges = [len(free) * i // (MAX_DIFFERENCES + 1) for i in range(MAX_DIFFERENCES + 2)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in itertools.pairwise(edges)]


def blocks_for(n: int) -> int:
    """The fewest blocks whose top nodes hold ``NODE_ROWS`` of ``n`` fingerprints or fewer on average."""
    return next((b for b in range(5, 8) if n >> (b - MAX_DIFFERENCES) * (BITS // b) <= NODE_ROWS), 8)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hook the roots of linked members, larger under smaller, until nothing moves."""
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        moved = low != high
        if not moved.any():
            return
        np.minimum.at(parent, high[moved], low[moved])
        while not np.array_equal(jumped := parent[parent], parent):
            parent[:] = jumped


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...`` (``n[i]`` of them), one range after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class GrayIndex:
    """The nodes of several top nodes (cells) at once. ``codes`` lie cell by cell, in Gray order within each; ``starts``
    are the cells' first members."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        # per level, the members first: bits that all members of a node share, their values, and the node's children
        self.masks, self.patterns, self.first, self.count = [np.full(len(codes), ~np.uint64(0))], [codes], [], []
        while len(self.masks[-1]) > len(starts):
            sizes = np.diff(np.append(starts, len(self.masks[-1])))
            nodes = -(-sizes // FAN_OUT)
            cuts = np.repeat(starts, nodes) + _ranges(np.zeros_like(nodes), nodes) * FAN_OUT
            ones = np.bitwise_and.reduceat(self.patterns[-1] | ~self.masks[-1], cuts)
            zeros = np.bitwise_or.reduceat(self.patterns[-1] & self.masks[-1], cuts)
            mask = np.bitwise_and.reduceat(self.masks[-1], cuts) & ~(ones ^ zeros)
            self.first.append(cuts)
            self.count.append(np.diff(np.append(cuts, len(self.masks[-1]))))
            self.masks.append(mask)
            self.patterns.append(zeros & mask)
            starts = np.cumsum(nodes) - nodes
        # the bits that a node adds to those of the node above
        above = [np.repeat(mask, n) for mask, n in zip(self.masks[1:], self.count, strict=True)]
        self.fresh = [mask & ~up for mask, up in zip(self.masks, above, strict=False)] + [self.masks[-1]]

    def components(self, parent: np.ndarray) -> list[np.ndarray]:
        """Per level, each node's component, or -1 if its members are in several."""
        parts = [parent]
        for cuts in self.first:
            low, high = np.minimum.reduceat(parts[-1], cuts), np.maximum.reduceat(parts[-1], cuts)
            parts.append(np.where(low == high, low, -1))
        return parts

    def near(self, asked: np.ndarray, root: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a member of ``asked`` and one within four bits that is not in its component; ``root`` is the top node
        of each of ``asked``."""
        parts, codes = self.components(parent), self.patterns[0]
        who, node, gathered = asked, root, np.zeros(len(asked), np.int64)
        for level in range(len(self.masks) - 1, -1, -1):
            if level < len(self.masks) - 1:
                n = self.count[level][node]
                who, gathered, node = np.repeat(who, n), np.repeat(gathered, n), _ranges(self.first[level][node], n)
            gathered = gathered + np.bitwise_count((codes[who] ^ self.patterns[level][node]) & self.fresh[level][node])
            live = (gathered <= MAX_DIFFERENCES) & (parts[level][node] != parent[who])
            who, gathered, node = who[live], gathered[live], node[live]
        return who, node


def link_members(cell: np.ndarray, codes: np.ndarray, checks: np.ndarray, max_check: int = BITS) -> np.ndarray:
    """Each member's root (an index) under links of four bits or fewer within a cell, whose ``checks`` differ in
    ``max_check`` bits or fewer. Members lie cell by cell, in Gray order within each."""
    m = len(codes)
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.append(starts, m))
    own = np.repeat(np.arange(len(starts)), sizes)  # a cell's top node has the cell's number
    place = np.arange(m) - starts[own]
    index, parent, at, step = GrayIndex(codes, starts), np.arange(m), 0, 64
    while at < sizes.max():
        asked = np.flatnonzero((place >= at) & (place < at + step))
        who, node = index.near(asked, own[asked], parent)
        fits = np.bitwise_count(checks[who] ^ checks[node]) <= max_check
        _unite(parent, who[fits], node[fits])
        at, step = at + step, min(2 * step, 2048)
    return parent


def _cell_links(max_check: int):
    """Links of a partition sorted by cell; one batch and the open cell are held at a time."""

    def solve(cell, ids, codes, checks) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        several = np.repeat(np.diff(np.append(cuts, len(cell))) > 1, np.diff(np.append(cuts, len(cell))))
        if several.any():
            cell, ids, codes, checks = (x[several] for x in (cell, ids, codes, checks))
            order = np.lexsort((gray_rank(codes), cell))
            cell, ids, codes, checks = (x[order] for x in (cell, ids, codes, checks))
            parent = link_members(cell, codes, checks, max_check)
            moved = np.flatnonzero(parent != np.arange(len(parent)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[parent[moved]])], ["u", "v"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, ids, codes, checks = (batch.column(c).to_numpy() for c in ("cell", "id", "code", "check"))
            held.append((cell, ids, codes.view(np.uint64), checks.view(np.uint64)))
            n += len(cell)
            if n >= BATCH_ROWS:
                cell, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
                last = int(np.searchsorted(cell, cell[-1]))  # cells are sorted; the last may go on
                if last:
                    yield from solve(cell[:last], *(x[:last] for x in rest))
                held, n = [(cell[last:], *(x[last:] for x in rest))], len(cell) - last
        if n:
            yield from solve(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return links


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask).cast("long")


def _dealt(codes: DataFrame, masks: dict[int, int]) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(i).alias("table"), F.col("code").bitwiseAND(_signed(m)).alias("key")) for i, m in masks.items()])
    return codes.select("id", "print", "code", "check", F.explode(keys).alias("k")).select("id", "print", "code", "check", "k.table", "k.key")


def top_nodes(codes: DataFrame, blocks: int, cell_rows: int) -> DataFrame:
    """``cell, id, code, check``: every code in its top nodes, none of more than ``cell_rows`` members as long as over
    five bits are left to split by. (Below that, members differ in hardly more than their checks and soon are one
    component, at which a search does not look again.)"""
    masks = dict(enumerate(block_masks(blocks)))
    level, done = _dealt(codes, masks), []
    while True:
        open_tables = [t for t, m in masks.items() if BITS - m.bit_count() > MAX_DIFFERENCES + 1]
        over_rows = F.col("table").isin(open_tables) & (F.col("count") > cell_rows)
        sizes = checkpointed(level.groupBy("print", "table", "key").count().where(over_rows).drop("count"))
        hot = [r["table"] for r in sizes.select("table").distinct().collect()]  # numbers of tables, 350 at most a level
        if not hot:
            done.append(level)
            break
        small = broadcast_if_small(sizes, 32)
        done.append(level.join(small, ["print", "table", "key"], "left_anti"))
        over = level.join(small, ["print", "table", "key"], "left_semi")
        number, deeper = itertools.count(max(masks) + 1), {}
        parts = []
        for t in hot:
            own = {next(number): m for m in deeper_masks(masks[t])}
            parts.append(_dealt(over.where(F.col("table") == t), own))
            deeper |= own
        masks, level = deeper, written(parts[0] if len(parts) == 1 else _union(parts), "split")
    return _union(done).select(F.xxhash64("print", "table", "key").alias("cell"), "id", "code", "check")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def near_links(codes: DataFrame, blocks: int = 5, cell_rows: int = CELL_ROWS, max_check: int = BITS) -> DataFrame:
    """``u, v``: links between ids that connect all rows of ``codes(id, print, code, check)`` of one ``print`` whose codes are at
    most four bits apart and whose checks at most ``max_check``.

    ``blocks`` trades tables for smaller top nodes (5 blocks: 5 tables keyed by 12 bits, 6: 15 by 21,
    7: 35 by 27, 8: 70 by 32); every choice finds the same components. ``blocks_for`` chooses by the number of codes.
    """
    nodes = top_nodes(codes, blocks, max(cell_rows, 2 * FAN_OUT))
    return nodes.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_links(max_check), "u long, v long")


def near_duplicates(docs: DataFrame, blocks: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``doc_id, code, component_id`` per row of ``docs(doc_id, text)``; other columns are not read.

    Lower case means A-Z to a-z; words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer than four words is one shingle,
    one without words (null, empty, blank) has fingerprint zero and links like any other. ``component_id`` is the
    smallest doc_id that links lead to; null ids are passed over, unless a component has no other. Repeated
    rows give repeated results. ``blocks`` defaults to ``blocks_for`` the number of distinct fingerprints.
    """
    prints = written(fingerprints(docs), "fingerprints", TEXT_ROWS)
    distinct = checkpointed(prints.groupBy("code").agg(F.min("doc_id").alias("first_id")))
    codes = distinct.select(F.col("code").alias("id"), F.lit(0).alias("print"), "code", F.lit(0).cast("long").alias("check"))
    link = roots(near_links(codes, blocks or blocks_for(distinct.count()), cell_rows))
    member = checkpointed(
        distinct.join(link.withColumnsRenamed({"u": "code", "v": "root"}), "code", "left").select(
            "code", "first_id", F.coalesce("root", "code").alias("root")
        )
    )
    # stored before they are joined: the members of a hot root can then be split over tasks
    least = checkpointed(member.groupBy("root").agg(F.min("first_id").alias("component_id")))
    labelled = member.join(least, "root").select("code", "component_id")
    return prints.join(labelled, "code").select("doc_id", "code", "component_id")


_KEY = ["no_id", "id", "a", "b"]


def _row_key() -> list[Column]:
    """A row's place in the order by which a group's document is chosen: doc_id (null last), then two hashes of its text."""
    doc_id = F.col("doc_id").cast("long")
    hashes = [F.xxhash64(F.lit(k), F.col("text").isNull(), "text").alias(n) for k, n in enumerate("ab")]
    return [doc_id.isNull().alias("no_id"), F.coalesce(doc_id, F.lit(0)).alias("id"), *hashes]


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, checks = [], []
        for t in batch.column("text"):
            words = _words(t.as_py())
            codes.append(word_fingerprints(words))
            checks.append(shingle_fingerprint(words, CONFIRM_WORDS))
        flat = pa.array(np.concatenate(codes).view(np.int64) if codes else np.array([], np.int64))
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * len(WORD_SEEDS)), flat)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in _KEY), listed, pa.array(np.array(checks, np.uint64).view(np.int64))], [*_KEY, "codes", "check"]
        )


def similar_groups(docs: DataFrame, blocks: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``no_id, id, a, b, copies, chosen``: the key of every different row of ``docs(doc_id, text)``, how many rows have it, and
    whether its group keeps it.

    Four SimHash fingerprints of a text's set of words propose links (four bits or fewer in one of them), and the
    fingerprint of its five-word shingles confirms them (14 bits or fewer, a similarity of about 0.8). Each group keeps
    its first key: the smallest doc_id, null after all others, then the smallest hashes of the text.
    """
    rows = docs.select(*_row_key(), "text").mapInArrow(_print_batches, "no_id boolean, id long, a long, b long, codes array<long>, check long")
    prints = written(rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("copies"), F.first("codes").alias("codes"), F.first("check").alias("check")), "prints", TEXT_ROWS)
    first = F.min(F.struct(*_KEY)).alias("first")
    members = written(prints.groupBy("codes", "check").agg(first).withColumn("member", F.monotonically_increasing_id()), "members")
    codes = members.select(F.col("member").alias("id"), F.posexplode("codes").alias("print", "code"), "check")
    link = roots(near_links(codes, blocks or blocks_for(members.count()), cell_rows, CONFIRM_DIFFERENCES))
    rooted = members.join(link.withColumnsRenamed({"u": "member", "v": "root"}), "member", "left").withColumn("root", F.coalesce("root", "member"))
    rooted = written(rooted, "rooted")
    least = checkpointed(rooted.groupBy("root").agg(F.min("first").alias("least")))
    chosen = rooted.join(least, "root").select("codes", "check", "least")
    return prints.join(chosen, ["codes", "check"]).select(*_KEY, "copies", (F.struct(*_KEY) == F.col("least")).alias("chosen"))


def drop_near_duplicates(docs: DataFrame, blocks: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One document of each group of ``similar_groups`` stays, with the columns it came with: exactly one row, the one
    with the group's first key. Rows with one doc_id but other texts are judged apart, and so are rows with a null doc_id;
    of rows alike in doc_id and text the one with the smallest hash of all its columns stays. A null text counts as empty in similarity.

    Texts are not shuffled while the keys of rows to drop fit ``broadcast_if_small``; beyond that they meet the rows by a
    sort-merge join on the key, which is spread evenly.
    """
    groups = written(similar_groups(docs, blocks, cell_rows), "groups")
    verdicts = written(groups.where("not chosen or copies > 1").select(*[F.col(k).alias(f"_{k}") for k in _KEY], "chosen"), "verdicts")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    same = [F.col(k) == F.col(f"_{k}") for k in _KEY]
    marked = docs.select(row, *_row_key()).join(broadcast_if_small(verdicts, 32), same[0] & same[1] & same[2] & same[3], "left")
    single = marked.where("chosen is null").select("row.*")
    if verdicts.where("chosen").isEmpty():
        return single
    alike = marked.where("chosen").groupBy(*_KEY).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return single.union(alike.select("row.*"))
