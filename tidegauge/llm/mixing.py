"""Online logistic context mixing: language-model scores of whole texts.

A text's bytes and its end are coded as bits by a Huffman code of the corpus. Predictors with hashed contexts (orders
three and five, and the word so far) say for every bit what followed their context in the training documents; a mixer
adds their log-odds by weights that a gate selects (which predictors know the context), and a correction by ranges of
the mixed log-odds refines the sum. Weights and corrections are learned online, block by block, within each document,
from the same start in each: a score depends on the corpus and the text alone, never on partitions or neighbours.

The corpus side is counted by Spark: tokens for the base, bytes for the code, and for each predictor the zeros and ones
behind each context in tables of a fixed size. Tables and the most frequent tokens have proven bounds and are broadcast;
all other tokens are joined by a shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm._shared import TEXT_ROWS, written

END = 256
ORDERS = (3, 5)
#: Slots of a predictor's table, two counts each while training, a byte each in the model (all three: 12 MB).
TABLE_BITS = 22
#: Slots from one decision of a context to the next. Without gaps, frequent decisions of two contexts meet more often in full tables
#: (2.3695 bits a byte on held-out rows of sf0.1 with 2^19 slots; 2.3637 with gaps, or with decisions anywhere).
NEAR = 3
BLOCK_BITS = 14
#: Bytes of the word so far that its predictor sees.
WORD_BYTES = 32
#: Symbols of a window: a longer text is scored in windows, and so many symbols at once train.
WINDOW, TRAIN_WINDOW = 1 << 15, 1 << 20
#: Symbols of texts that are scored side by side, and that get their contexts at once in training; no result depends on them.
GROUP, TRAIN_GROUP = 1 << 15, 1 << 14
#: Symbols whose inputs are looked up at once, so that what lies between stays in a core's cache.
CHUNK = 1 << 12
#: Tokens that are broadcast, and the bytes of the longest: longer ones are named by a digest. At most 2^18 * 49 bytes.
HEAD_TOKENS, TOKEN_BYTES = 1 << 18, 40
#: Tokens that a task counts before it hands them on.
TASK_TOKENS = 400_000
SCALE = 12.0  # log-odds are stored in twelfths
FIRST_BLOCK, LAST_BLOCK, RATE = 1024, 8192, 3e-6
#: Weights of a document's first block, by gate: neither the fifth order nor the word knows the context, the one, the other, both.
START_WEIGHTS = ((0.85, 0.1, 0.1), (0.45, 0.6, 0.1), (0.6, 0.1, 0.3), (0.27, 0.62, 0.28))
_MIX, _SPREAD = np.uint32(0x2C1B3C6D), np.uint32(0x85EBCA6B)
#: ``_SPREAD`` times this moves a slot by one: the decisions that follow a context lie close together, the most frequent first.
_STIR = np.uint32(pow(0x85EBCA6B, -1, 1 << 32) << (32 - TABLE_BITS) & 0xFFFFFFFF)
_END_TOKEN = b""
_RADIX = 0x01000193 | 0x9E370000  # odd, so it has an inverse


def held_out(doc_id) -> bool:
    """A tenth of all ids; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def tokens_of(raw: bytes) -> list[bytes]:
    """Lower-cased words; long ones as a blank and a digest, which no word can be."""
    words = raw.lower().split()
    if words and max(map(len, words)) > TOKEN_BYTES:
        words = [w if len(w) <= TOKEN_BYTES else b" " + hashlib.blake2b(w, digest_size=32).digest() for w in words]
    return words


class Code:
    """Huffman code of 256 bytes and the end: per symbol the inner nodes on its path and the turns taken."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        below: list[tuple[int, int]] = []
        while len(heap) > 1:
            (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
            below.append((left, right))
            heapq.heappush(heap, (a + b, END + len(below)))
        paths: dict[int, list[tuple[int, int]]] = {}
        todo = [(heap[0][1], [])]
        while todo:
            v, path = todo.pop()
            if v <= END:
                paths[v] = path
            else:
                todo += [(below[v - END - 1][turn], [*path, (v, turn)]) for turn in (0, 1)]
        self.length = np.array([len(paths[s]) for s in range(END + 1)], np.int32)
        self.length = self.length.astype(np.intp)
        self.offset = np.cumsum(self.length) - self.length
        steps = [step for s in range(END + 1) for step in paths[s]]
        self.near = np.array([NEAR * (2 * END - v) for v, _ in steps], np.intp)  # the root is 0, as it is the last node made
        with np.errstate(over="ignore"):
            self.stir = self.near.astype(np.uint32) * _STIR
        self.turn = np.array([t for _, t in steps], np.uint8)
        self.sign = 2 * self.turn.astype(np.float32) - 1

    def expand(self, lengths: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For all bits in order: the place of their symbol, and of their step in ``near`` and ``turn``."""
        place = np.repeat(np.arange(len(lengths)), lengths)
        step = (offsets - (np.cumsum(lengths) - lengths)).take(place)
        step += np.arange(len(place))
        return place, step


_BLANK = np.zeros(END + 1, bool)
_BLANK[[9, 10, 11, 12, 13, 32, END]] = True


def symbols_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts with ends around and between them, as many as any order looks back; the place of each
    text's own end; and which symbols are no such padding."""
    pad = bytes(max(ORDERS))
    sym = np.frombuffer(pad + pad.join(texts) + pad, np.uint8).astype(np.int32)
    ends = len(pad) - 1 + np.cumsum([len(t) + len(pad) for t in texts]) - (len(pad) - 1)
    own = np.ones(len(sym), bool)
    own[: len(pad)] = False
    sym[: len(pad)] = END
    for k in range(len(pad)):
        sym[ends + k] = END
        if k:
            own[ends + k] = False
    return sym, ends, own


@functools.cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of ``_RADIX`` and of its inverse; ``n`` is a power of two itself, so few are ever made."""
    both = np.full((2, n), _RADIX, np.uint32)
    both[1] = pow(_RADIX, -1, 1 << 32)
    both[:, 0] = 1
    up, down = np.multiply.accumulate(both, axis=1, dtype=np.uint32)
    return up, down


def contexts(sym: np.ndarray) -> list[np.ndarray]:
    """Hashes of what stands before each symbol, for each predictor. The first symbols must be ends."""
    n, look = len(sym), max(ORDERS)
    s = sym.astype(np.uint32) + np.uint32(1)
    behind = np.concatenate([np.full(look, END + 1, np.uint32), s])
    out = []
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint32)
        for j in range(1, look + 1):
            h = (h + behind[look - j : look - j + n]) * _MIX
            h ^= h >> np.uint32(15)
            if j in ORDERS:
                out.append(h + np.uint32(j))
        up, down = powers(1 << (n - 1).bit_length())
        total = np.cumsum(s * up[:n], dtype=np.uint32)
        before = np.concatenate([np.zeros(1, np.uint32), total[:-1]])
        at = np.arange(n)
        begins = np.zeros(n, np.intp)
        np.multiply(at[1:], _BLANK.take(sym[:-1]), out=begins[1:])
        begins = np.maximum(np.maximum.accumulate(begins), at - WORD_BYTES)
        word = (before - before.take(begins)) * down.take(begins)
        word = (word ^ (word >> np.uint32(16))) * _MIX
        out.append(word ^ (word >> np.uint32(15)))
    return out


def slots(context: np.ndarray) -> np.ndarray:
    """The slot of each context's first decision; that of step ``i`` of the code is ``near[i]`` further, in a ring.

    It is ``(context + stir) * _SPREAD >> 32 - TABLE_BITS`` for each step; ``stir`` moves it within a few cache lines."""
    return ((context * _SPREAD) >> np.uint32(32 - TABLE_BITS)).astype(np.intp)


N_PREDICTORS = len(ORDERS) + 1


class Tables:
    """Zeros and ones behind each context of the texts added so far, one dense table for each predictor."""

    def __init__(self, code: Code):
        self.code, self.held, self.size = code, [], 0
        self.keys, self.waiting = [[] for _ in range(N_PREDICTORS)], 0
        self.counts = [np.zeros(2 << TABLE_BITS, np.int32) for _ in range(N_PREDICTORS)]

    def add(self, text: bytes) -> None:
        for at in range(0, len(text) or 1, TRAIN_WINDOW):  # a longer text counts as several
            self.held.append(text[at : at + TRAIN_WINDOW])
            self.size += len(self.held[-1]) + max(ORDERS)
            if self.size >= TRAIN_GROUP:
                self.pair()
                if self.waiting >= TRAIN_WINDOW:
                    self.fold()

    def pair(self) -> None:
        """Pairs of a context's first slot and a symbol, of the held texts: 22 and 9 bits."""
        if not self.held:
            return
        sym, _, own = symbols_of(self.held)
        low = sym[own].astype(np.uint32)
        for keys, h in zip(self.keys, contexts(sym), strict=True):
            own_keys = slots(h[own]).astype(np.uint32)
            own_keys <<= np.uint32(9)
            own_keys |= low
            keys.append(own_keys)
        self.held, self.size, self.waiting = [], 0, self.waiting + len(low)

    def fold(self) -> None:
        """Different pairs of slot and symbol first, then the bits of each, in the order of the table."""
        self.pair()
        if not self.waiting:
            return
        for counts, parts in zip(self.counts, self.keys, strict=True):
            keys = np.concatenate(parts)
            parts.clear()
            keys.sort()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            times = np.diff(np.append(first, len(keys))).astype(np.int32)
            keys = keys[first]
            for a in range(0, len(keys), TRAIN_GROUP):
                some = keys[a : a + TRAIN_GROUP]
                pair_sym = (some & np.uint32(511)).astype(np.intp)
                place, step = self.code.expand(self.code.length.take(pair_sym), self.code.offset.take(pair_sym))
                at = (some >> np.uint32(9)).astype(np.intp).take(place)
                at += self.code.near.take(step)
                at &= (1 << TABLE_BITS) - 1
                at <<= 1
                at |= self.code.turn.take(step)
                np.add.at(counts, at, times[a : a + TRAIN_GROUP].take(place))
        self.waiting = 0

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """Blocks of the tables that are not empty, packed."""
        self.fold()
        width, per = 2 << BLOCK_BITS, 1 << (TABLE_BITS - BLOCK_BITS)
        for k, counts in enumerate(self.counts):
            for b in np.flatnonzero(counts.reshape(per, width).any(axis=1)).tolist():
                yield k * per + b, pack(counts[b * width : (b + 1) * width])


def pack(counts: np.ndarray) -> bytes:
    """Places and values of what is not zero, values in as few bytes as the largest takes."""
    at = np.flatnonzero(counts)
    values = counts[at]
    size = 1 if values.max() < 1 << 8 else 2 if values.max() < 1 << 16 else 4
    return bytes([size]) + at.astype("<u2").tobytes() + values.astype(f"<u{size}").tobytes()


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, n = raw[0], (len(raw) - 1) // (2 + raw[0])
    return np.frombuffer(raw, "<u2", n, 1), np.frombuffer(raw, f"<u{size}", n, 1 + 2 * n)


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Table bytes from counts of zeros and ones; a context never seen says nothing (0)."""
    zeros, ones = counts.reshape(-1, 2).T.astype(np.float64)
    return np.clip(np.round(np.log((ones + 0.4) / (zeros + 0.4)) * SCALE), -127, 127).astype(np.int8)


class Model:
    def __init__(self, counts: np.ndarray, tables: list[np.ndarray]):
        self.code, self.tables = Code(counts), tables
        self.rings = np.empty((N_PREDICTORS, (1 << TABLE_BITS) + NEAR * END), np.int8)  # a context at the end goes on at the start
        for ring, t in zip(self.rings, tables, strict=True):
            np.concatenate([t, t[: NEAR * END]], out=ring)

    def bits(self, texts: list[bytes]) -> list[float]:
        """Bits of each text, its end included. Texts of a group are alike in length, so that most end in the same block."""
        out = np.empty(len(texts))
        group: list[int] = []
        size = 0
        for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
            if len(texts[i]) > WINDOW:
                out[i] = self._long(texts[i])
                continue
            if group and size + len(texts[i]) > GROUP:
                out[group] = self._group([texts[j] for j in group])
                group, size = [], 0
            size += len(texts[i])
            group.append(i)
        if group:
            out[group] = self._group([texts[j] for j in group])
        return out.tolist()

    def _inputs(self, sym: np.ndarray, lengths: np.ndarray, pieces: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds of the predictors, gate and sign of every bit, or of the ``pieces`` of bits in their order."""
        first = [slots(h) for h in contexts(sym)]
        offsets, chosen = self.code.offset.take(sym), None
        if pieces is not None:
            chosen, offsets, lengths = cut(*pieces, offsets, lengths)
        stops = np.cumsum(lengths)
        x = np.empty((N_PREDICTORS, stops[-1]), np.float32)
        gate, sign = np.zeros(stops[-1], np.uint8), np.empty(stops[-1], np.float32)
        done = 0
        for a in range(0, len(lengths), CHUNK):
            some = slice(a, a + CHUNK)
            place, step = self.code.expand(lengths[some], offsets[some])
            near, part = self.code.near.take(step), slice(done, done + len(place))
            sign[part] = self.code.sign.take(step)
            for k in reversed(range(N_PREDICTORS)):
                at, ring = first[k][some] if chosen is None else first[k].take(chosen[some]), self.rings[k]
                ring.take(at)  # these lines come into the cache at once, where decision by decision would wait for each
                at = at.take(place)
                at += near
                v = ring.take(at)
                x[k, part] = v
                if k:
                    gate[part] += gate[part]
                    gate[part] += v != 0
            done += len(place)
        return x, gate, sign

    def _group(self, texts: list[bytes]) -> list[float]:
        """Texts are mixed side by side, longest first: the first blocks of all, then the second ones."""
        sym, ends, own = symbols_of(texts)
        lengths = np.where(own, self.code.length.take(sym), 0)
        upto = np.cumsum(lengths)[ends]
        n_bits = np.diff(upto, prepend=0)
        longest = np.argsort(-n_bits, kind="stable")
        mixer = Mixer(len(texts))
        mixer.run(*self._inputs(sym, lengths, block_pieces(n_bits[longest], (upto - n_bits)[longest])), n_bits[longest])
        out = np.empty(len(texts))
        out[longest] = mixer.bits
        return out.tolist()

    def _long(self, text: bytes) -> float:
        """Windows from the text's own start, each with what its contexts look back at."""
        sym, _, own = symbols_of([text])
        mixer, look = Mixer(), WORD_BYTES + max(ORDERS)
        for at in range(0, len(sym), WINDOW):
            low = max(0, at - look)
            use = own[low : at + WINDOW].copy()
            use[: at - low] = False
            part = sym[low : at + WINDOW]
            mixer.run(*self._inputs(part, np.where(use, self.code.length.take(part), 0)))
        return float(mixer.bits[0])


def block_pieces(n_bits: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Starts and sizes of the blocks of texts (longest first): the first ones of all texts, then the second ones."""
    if len(n_bits) == 1:
        return None
    done, block, starts, sizes = 0, FIRST_BLOCK, [], []
    while done < n_bits[0]:
        left = n_bits[n_bits > done] - done
        starts.append(begins[: len(left)] + done)
        sizes.append(np.minimum(left, block))
        done, block = done + block, min(2 * block, LAST_BLOCK)
    return np.concatenate(starts), np.concatenate(sizes)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    out = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    out += np.arange(len(out))
    return out


def blocks_first(n_bits: np.ndarray, begins: np.ndarray) -> np.ndarray | None:
    """The bits of texts (longest first) in the order of their blocks."""
    pieces = block_pieces(n_bits, begins)
    return None if pieces is None else ranges(*pieces)


def cut(starts: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of bits as symbols: places, offsets and lengths. A symbol that a piece's edge divides stands in both pieces,
    with its own steps in each."""
    upto, ends = np.cumsum(lengths), starts + sizes
    head, tail = upto.searchsorted(starts, "right"), upto.searchsorted(ends)
    n = tail - head + 1
    chosen = ranges(head, n)
    offsets, lengths, stop = offsets.take(chosen), lengths.take(chosen), np.cumsum(n)
    before = starts - (upto - np.diff(upto, prepend=0))[head]
    offsets[stop - n] += before
    lengths[stop - n] -= before
    lengths[stop - 1] -= upto[tail] - ends
    return chosen, offsets, lengths


class Mixer:
    """For each of some texts: weights of the predictors for each gate, corrections for each gate and range of log-odds; both
    learn from block to block, and blocks double in size. No text sees another's."""

    GATES, RANGES = 1 << (N_PREDICTORS - 1), 32

    def __init__(self, texts: int = 1):
        cells = texts * self.GATES * self.RANGES
        self.weights = np.tile(np.array(START_WEIGHTS, np.float32) / np.float32(SCALE), (texts, 1, 1))
        self.shift = np.zeros(cells, np.float32)
        self.seen = np.full(cells, 20.0, np.float32)
        self.block, self.bits = FIRST_BLOCK, np.zeros(texts)

    def run(self, x: np.ndarray, gate: np.ndarray, sign: np.ndarray, n_bits: np.ndarray | None = None) -> None:
        """The bits of one text, or of all (longest first) as ``blocks_first`` orders them. Most bits have the last gate, so all
        are mixed by it first and the others anew."""
        n_bits = np.array([x.shape[1]]) if n_bits is None else n_bits
        last, per = self.GATES - 1, self.GATES * self.RANGES
        rounds, full, done = [], [], 0
        while done < n_bits[0]:
            sizes = np.minimum(n_bits[n_bits > done] - done, self.block)
            rounds.append(sizes)
            full.append(int(np.count_nonzero(sizes == self.block)))
            done, self.block = done + self.block, min(2 * self.block, LAST_BLOCK)
        if not rounds:
            return
        cells = np.repeat(np.concatenate([np.arange(len(sizes)) for sizes in rounds]) * per, np.concatenate(rounds))
        cells += gate * np.uint8(self.RANGES)
        few = np.flatnonzero(gate != last)
        few_gates = cells.take(few) // self.RANGES
        few_at = few_gates * N_PREDICTORS + np.arange(N_PREDICTORS)[:, None]
        few_x = x.take(few, axis=1)
        stops = np.cumsum([sizes.sum() for sizes in rounds])
        minus, low, a = -sign, 0, 0
        for sizes, whole, b, high in zip(rounds, full, stops.tolist(), few.searchsorted(stops).tolist(), strict=True):
            texts, ends = len(sizes), np.cumsum(sizes)
            part, weights = x[:, a:b], self.weights[:texts]
            mixed = np.empty(b - a, np.float32)
            slope = np.empty((texts, N_PREDICTORS), np.float32)
            square, even = self._whole(part, ends, whole)
            own = list(zip(range(whole, texts), (ends - sizes)[whole:].tolist(), ends[whole:].tolist(), strict=True))
            if whole:
                np.matmul(weights[:whole, None, last], square, out=mixed[:even].reshape(whole, 1, -1))
            for t, s, e in own:
                np.matmul(weights[t, last], part[:, s:e], out=mixed[s:e])
            some, some_at, some_x = few[low:high] - a, few_at[:, low:high], few_x[:, low:high]
            mixed[some] = (weights.ravel().take(some_at) * some_x).sum(axis=0)
            cell = mixed * 2
            cell += self.RANGES / 2
            cell.clip(0, self.RANGES - 1, out=cell)
            cell = cell.astype(np.intp)
            cell += cells[a:b]
            mixed += self.shift.take(cell)
            mixed *= minus[a:b]
            np.minimum(mixed, 20, out=mixed)
            wrong = np.exp(mixed, out=mixed)
            odds = wrong + 1
            miss = np.divide(wrong, odds, out=wrong)
            miss *= sign[a:b]
            if whole:  # four odds multiply to 6e34 at most
                four = odds[:even].reshape(whole, 4, -1).prod(axis=1)
                self.bits[:whole] += np.log(four, out=four).sum(axis=1, dtype=np.float64) / math.log(2)
            if own:
                rest = np.log(odds[even:], out=odds[even:])
                self.bits[whole:texts] += np.add.reduceat(rest, (ends - sizes)[whole:] - even, dtype=np.float64) / math.log(2)
            if whole:
                np.matmul(square, miss[:even].reshape(whole, -1, 1), out=slope[:whole, :, None])
            for t, s, e in own:
                np.matmul(part[:, s:e], miss[s:e], out=slope[t])
            slopes = np.bincount(some_at.ravel(), (some_x * miss.take(some)).ravel(), weights.size).astype(np.float32).reshape(weights.shape)
            slopes[:, last] = slope - slopes.sum(axis=1)
            slopes *= np.float32(RATE)
            weights += slopes
            moved, seen = self.shift[: texts * per], self.seen[: texts * per]
            moved += np.bincount(cell, miss, len(moved)) / seen
            seen += 0.25 * np.bincount(cell, minlength=len(moved))
            a, low = b, high

    @staticmethod
    def _whole(part: np.ndarray, ends: np.ndarray, whole: int) -> tuple[np.ndarray, int]:
        """The inputs of the first texts, whose blocks are whole, text by text; and the bits of all their blocks."""
        even = int(ends[whole - 1]) if whole else 0
        return part[:, :even].reshape(N_PREDICTORS, whole, -1 if whole else 0).transpose(1, 0, 2), even


def raw_texts(rows: pa.RecordBatch) -> list[bytes]:
    """The texts of a batch in UTF-8; a null is empty."""
    return [t or b"" for t in rows.column("text").cast(pa.binary()).to_pylist()]


_BATCH = pa.schema([("kind", pa.int32()), ("token", pa.binary()), ("n", pa.int64())])


def corpus_counts(docs: DataFrame) -> DataFrame:
    """``kind, token, n`` over the training rows of ``docs(doc_id, text)``: tokens (kind 0), bytes (kind 1). Tasks count
    first and hand on ``TASK_TOKENS`` at a time, so that no frequent token gathers its occurrences anywhere."""

    def batch(kind: int, counts: Counter) -> pa.RecordBatch:
        n = len(counts)
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], schema=_BATCH)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chars, texts = Counter(), np.zeros(256, np.int64), 0
        for rows in batches:
            for doc_id, raw in zip(rows.column("doc_id").to_pylist(), raw_texts(rows), strict=True):
                if not held_out(doc_id):
                    words.update(tokens_of(raw))
                    chars += np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
                    texts += 1
                    if len(words) >= TASK_TOKENS:
                        yield batch(0, words)
                        words = Counter()
        if texts:
            words[_END_TOKEN] += texts
            yield batch(0, words)
            yield batch(1, Counter({bytes([b]): int(chars[b]) for b in np.flatnonzero(chars)}))

    return docs.select("doc_id", "text").mapInArrow(count, "kind int, token binary, n long").groupBy("kind", "token").agg(F.sum("n").alias("n"))


def head_bound(words: DataFrame) -> int:
    """The least count of the tokens that are broadcast: all with that count or more, ``HEAD_TOKENS`` at most. Counts are
    grouped by eighths of a power of two, so some hundred rows decide."""
    grade = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("long")
    held, least = 0, 2**63 - 1
    for r in sorted(words.groupBy(grade.alias("grade")).agg(F.count("*").alias("tokens"), F.min("n").alias("least")).collect(), key=lambda r: -r["grade"]):
        held += r["tokens"]
        if held > HEAD_TOKENS:
            break
        least = r["least"]
    return least


def context_tables(docs: DataFrame, code: Code) -> list[np.ndarray]:
    """The predictors' tables over the training rows. What tasks send grows with the input; what arrives is 12 MB."""
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(code)
        for rows in batches:
            for doc_id, raw in zip(rows.column("doc_id").to_pylist(), raw_texts(rows), strict=True):
                if not held_out(doc_id):
                    tables.add(raw)
        for block, raw in tables.blocks():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([raw], pa.binary())], ["block", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for rows in batches:
            for block, raw in zip(rows.column("block").to_pylist(), rows.column("part"), strict=True):
                own = sums.setdefault(block, np.zeros(2 << BLOCK_BITS, np.int64))
                at, values = unpack(raw.as_py())
                own[at] += values
        for block, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([log_odds(own).tobytes()], pa.binary())], ["block", "part"])

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = docs.select("doc_id", "text").mapInArrow(count, "block int, part binary")
    done = parts.repartition(n_parts, "block").mapInArrow(add, "block int, part binary").collect()
    tables = [np.zeros(1 << TABLE_BITS, np.int8) for _ in range(N_PREDICTORS)]
    per, width = 1 << (TABLE_BITS - BLOCK_BITS), 1 << BLOCK_BITS
    for block, part in done:
        k, b = divmod(block, per)
        tables[k][b * width : (b + 1) * width] = np.frombuffer(part, np.int8)
    return tables


_SCORED = pa.schema(
    [
        ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()),
        ("score", pa.float64()), ("n_bytes", pa.int64()), ("rare", pa.list_(pa.binary())),
    ]
)


def score_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` per row of
    ``docs(doc_id, text)``: log10 of the text's probability under the unigram base and under the mixed model, and the
    model's bits for a byte (the end included; an empty text's over one byte).

    Rows whose crc32 of the id leaves no rest by ten are held out, all others train. A null text is empty, a null id is
    held out; repeated rows are scored one by one; other columns are not read; an empty table gives an empty result. With
    no training row every predictor is silent and the base is 0.1 / 0.1. Four scans: two to count, one to fill the
    tables, one to score; texts are never shuffled.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = written(corpus_counts(source), "lm-counts", TEXT_ROWS)
    words = counts.where("kind = 0").select("token", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("token") == _END_TOKEN, F.col("n"))), F.lit(0)).alias("ends")).first()
    bottom = total.n + 0.1 * (total.v + 1)
    alphabet = np.zeros(END + 1, np.int64)
    for r in counts.where("kind = 1").collect():  # 256 rows at most
        alphabet[r["token"][0]] = r["n"]
    alphabet[END] = total.ends
    least = head_bound(words)
    head = {bytes(r["token"]): r["n"] for r in words.where(F.col("n") >= least).collect()}  # HEAD_TOKENS at most
    tables = context_tables(source, Code(alphabet))
    sent = spark.sparkContext.broadcast((alphabet, tables, head))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, tables, known = sent.value
        model = Model(alphabet, tables)
        odds = {w: math.log10((n + 0.1) / bottom) for w, n in known.items()}
        end = math.log10((alphabet[END] + 0.1) / bottom)
        for rows in batches:
            texts = raw_texts(rows)
            ids = rows.column("doc_id").to_pylist()
            out = []
            for row, doc_id, raw, bits in zip(rows.column("row").to_pylist(), ids, texts, model.bits(texts), strict=True):
                own = tokens_of(raw)
                found = list(map(odds.get, own))
                rare = [w for w, v in zip(own, found, strict=True) if v is None] if None in found else []
                base = math.fsum(filter(None, found)) + end
                n_known = len(own) - len(rare) + int(alphabet[END] > 0)
                out.append((row, doc_id, held_out(doc_id), len(own) + 1, n_known, base, -bits * math.log10(2), len(raw), rare))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SCORED.types, strict=True)], schema=_SCORED)

    plain = source.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
        scored, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, n_bytes long, rare array<binary>"
    )
    stored = written(plain, "lm-scores", TEXT_ROWS)
    rest = words.where(F.col("n") < least)
    log_p: Column = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(bottom))
    tail = (
        stored.select("row", F.explode("rare").alias("token"))
        .join(rest, "token", "left")
        .groupBy("row")
        .agg(F.sum(log_p).alias("rare_base"), F.count("n").alias("rare_known"))
    )
    return stored.drop("rare").join(tail, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
        (-F.col("score") / math.log10(2) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
