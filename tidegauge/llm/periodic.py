"""Runs of repeated words by the tandem-repeat method of Gusfield and Stoye.

A run of at least ``max(24, 3 * period)`` words repeats a stretch of 16 words at the distance of its period, so only
stretches of a text that such repeats cover can hold one: hashed windows find them, and most texts end there. A covered
stretch gets a suffix tree. Its Lempel-Ziv blocks give squares that cover every square's leftmost place (phase one);
walks along suffix links from their ends in the tree find all rotations, and so the vocabulary of squares (phase two);
the leaves below a square's end are its places, and places in a row merge into runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MIN_POWER = 24, 3
#: Words that a run repeats at the distance of its period, at least: all of a run but its first period.
WINDOW = MIN_WORDS - MIN_WORDS // MIN_POWER


class Substrings:
    """Names of all substrings of 2^j words, level by level, and longest common extensions by descending levels.

    Positions behind the end count as one word that is smaller than all others; ``order`` is the suffix array.
    """

    def __init__(self, ids: np.ndarray):
        n = self.n = len(ids)
        names = np.append(ids.astype(np.int64) + 1, 0)
        self.levels = [names]
        size = 1
        while True:
            ahead = np.zeros(n + 1, np.int64)
            if size <= n:
                ahead[: n + 1 - size] = names[size:]
            values, names = np.unique(names * (n + 2) + ahead, return_inverse=True)
            if len(values) == n + 1:
                break
            self.levels.append(names)
            size *= 2
        self.rank = names[:n] - 1  # the empty suffix is first
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that begins at ``a`` and ``b`` (a != b; at most ``n``)."""
        a, b, start = a.copy(), b.copy(), a
        for j in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[j][a] == self.levels[j][b]).astype(np.int64) << j
            a += step
            b += step
        return a - start

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that ends at ``a`` and ``b``, both included (-1: nothing stands there)."""
        a, b, start = a.copy(), b.copy(), a
        for j in range(len(self.levels) - 1, -1, -1):
            back = (1 << j) - 1
            inside = np.minimum(a, b) >= back
            same = inside & (self.levels[j][np.where(inside, a - back, 0)] == self.levels[j][np.where(inside, b - back, 0)])
            step = same.astype(np.int64) << j
            a -= step
            b -= step
        return start - a


class SuffixTree:
    """Inner nodes first (0 is the root), then the leaves by rank; intervals of ranks, parents, suffix links, children."""

    def __init__(self, text: np.ndarray):
        self.text, self.sub = text, Substrings(text)
        n = self.n = len(text)
        order = self.order = self.sub.order
        shared = np.append(np.append(0, self.sub.ahead(order[:-1], order[1:])), -1).tolist()
        depth, left, right, parent, stack, above = [0], [0], [n - 1], [0], [0], [0] * n
        for i in range(1, n + 1):
            now, low = shared[i], i - 1
            while depth[stack[-1]] > max(now, 0):
                v = stack.pop()
                right[v], low = i - 1, left[v]
                if depth[stack[-1]] < now:
                    stack.append(len(depth))
                    depth.append(now)
                    left.append(low)
                    right.append(0)
                    parent.append(0)
                parent[v] = stack[-1]
            if depth[stack[-1]] < now:
                stack.append(len(depth))
                depth.append(now)
                left.append(i - 1)
                right.append(0)
                parent.append(0)
                above[i - 1] = stack[-1]
            if i < n:
                above[i] = stack[-1]
        self.inner = len(depth)
        self.depth = np.append(depth, n - order)
        self.left, self.right = np.append(left, np.arange(n)), np.append(right, np.arange(n))
        self.up = [np.append(parent, above).astype(np.int64)]
        while self.up[-1].any():
            self.up.append(self.up[-1][self.up[-1]])
        first = order[self.left]
        # the least place below a node: children have higher depth than their parents
        least = np.append(np.full(self.inner, n), order)
        for v in np.argsort(-self.depth, kind="stable").tolist():
            p = self.up[0][v]
            if least[v] < least[p]:
                least[p] = least[v]
        self.least = least
        links = self.place(np.minimum(first + 1, n - 1), self.depth - 1)
        self.link = np.where(self.depth > 1, links, 0)
        at = first + self.depth[self.up[0]]
        keyed = (at < n) & (np.arange(len(first)) > 0)
        keys = self.up[0] * (int(text.max()) + 1) + text[np.minimum(at, n - 1)]
        self.child = dict(zip(keys[keyed].tolist(), np.flatnonzero(keyed).tolist(), strict=True))

    def climb(self, v: np.ndarray, keep: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The highest node above each ``v`` (or itself) for which ``keep`` holds; it must hold from there down to ``v``."""
        for up in reversed(self.up):
            higher = up[v]
            v = np.where(keep(higher), higher, v)
        return v

    def place(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The highest node whose path begins with the ``length`` words at ``start``."""
        return self.climb(self.inner + self.sub.rank[start], lambda v: self.depth[v] >= length)

    def blocks(self) -> np.ndarray:
        """Starts of Lempel-Ziv blocks, and the end: each the longest stretch that also begins further left, or one word."""
        at = np.arange(self.n)
        top = self.climb(self.inner + self.sub.rank, lambda v: self.least[v] == at)
        longest = np.maximum(1, self.depth[self.up[0][top]] * (top > 0)).tolist()
        starts, i = [], 0
        while i < self.n:
            starts.append(i)
            i += longest[i]
        return np.array([*starts, self.n])

    def covering_squares(self) -> tuple[np.ndarray, np.ndarray]:
        """Phase one: starts and half lengths of squares; each square's leftmost place is one of them or a shift of one."""
        b = self.blocks()
        h, h1, h2 = b[:-1], b[1:], np.append(b[2:], self.n)
        one = np.repeat(np.arange(len(h)), h1 - h)  # the second half begins in the block
        k = np.arange(len(one)) - np.repeat(np.cumsum(h1 - h) - (h1 - h), h1 - h) + 1
        q, end = h1[one] - k, h1[one]
        k1, k2 = self.sub.ahead(end, q), self.sub.behind(end - 1, q - 1)
        start = np.maximum(q - k2, q - k + 1)
        ok = (k1 + k2 >= k) & (k1 > 0)
        found = [(start[ok], k[ok])]
        two = np.repeat(np.arange(len(h)), h2 - h)  # the square begins before the block, its middle does not lie behind it
        k = np.arange(len(two)) - np.repeat(np.cumsum(h2 - h) - (h2 - h), h2 - h) + 1
        at = h[two]
        inside = (at + k < self.n) & (at > 0)
        two, k, at = two[inside], k[inside], at[inside]
        k1, k2 = self.sub.ahead(at, at + k), self.sub.behind(at - 1, at + k - 1)
        start = np.maximum(at - k2, at - k + 1)
        ok = (k1 + k2 >= k) & (k1 > 0) & (k2 > 0) & (start + k <= h1[two])
        found.append((start[ok], k[ok]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def vocabulary(self) -> tuple[np.ndarray, np.ndarray]:
        """Phase two: nodes and half lengths of all different squares."""
        starts, halves = self.covering_squares()
        nodes = self.place(starts, 2 * halves)
        depth, parent, link, child = self.depth.tolist(), self.up[0].tolist(), self.link.tolist(), self.child
        first, text, n, letters = self.order[self.left].tolist(), self.text.tolist(), self.n, int(self.text.max()) + 1
        seen = set()
        for v, half in zip(nodes.tolist(), halves.tolist(), strict=True):
            size = 2 * half
            while (v, half) not in seen:
                seen.add((v, half))
                at = first[v]
                if depth[v] > size:  # the end lies on an edge: one word can follow
                    below = v if text[at + size] == text[at] else None
                else:
                    below = child.get(v * letters + text[at])
                if below is None:
                    break
                v = link[below]
                while depth[parent[v]] >= size:
                    v = parent[v]
        found = np.array(sorted(seen), np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]


@lru_cache(maxsize=4096)
def prime_divisors(n: int) -> tuple[int, ...]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return (*out, n) if n > 1 else tuple(out)


def runs_of(ids: np.ndarray, min_words: int = MIN_WORDS, min_power: int = MIN_POWER) -> list[tuple[int, int, int]]:
    """``start, length, period`` of every run of ``ids`` (numbers from 0) with that many words and that power at least."""
    if len(ids) < 2:
        return []
    tree = SuffixTree(ids)
    nodes, halves = tree.vocabulary()
    at = tree.order[tree.left[nodes]]
    divided = [(i, k // r) for i, k in enumerate(halves.tolist()) for r in prime_divisors(k)]
    if divided:  # a half that is itself a power has a smaller period, which gives the run
        which, part = (np.array(x) for x in zip(*divided, strict=True))
        power = tree.sub.ahead(at[which], at[which] + part) >= halves[which] - part
        whole = np.ones(len(nodes), bool)
        whole[which[power]] = False
        nodes, halves = nodes[whole], halves[whole]
    if not len(nodes):
        return []
    counts = tree.right[nodes] - tree.left[nodes] + 1
    ranks = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - tree.left[nodes], counts)
    places = np.sort(np.repeat(halves, counts) * (tree.n + 1) + tree.order[ranks])
    cut = np.flatnonzero(np.diff(places) != 1)
    half, start = np.divmod(places[np.append(0, cut + 1)], tree.n + 1)
    length = places[np.append(cut, len(places) - 1)] % (tree.n + 1) - start + 2 * half
    long = length >= np.maximum(min_words, min_power * half)
    return sorted(zip(start[long].tolist(), length[long].tolist(), half[long].tolist(), strict=True), key=lambda r: (r[0], r[2]))


def repeated_stretches(words: list[bytes]) -> list[tuple[int, int]]:
    """Stretches (start, end) that windows of ``WINDOW`` words occurring twice or more cover: all runs lie in them."""
    g = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    for j in (1, 2, 4, 8):
        g = g[:-j] * np.uint64(0x9E3779B97F4A7C15 + 2 * j) + (g[j:] ^ (g[j:] >> np.uint64(31)))
    values = np.sort(g)
    twice = values[1:][values[1:] == values[:-1]]
    if not len(twice):
        return []
    hit = np.zeros(len(words) + 1, np.int64)
    begins = np.flatnonzero(np.isin(g, twice))
    np.add.at(hit, begins, 1)
    np.add.at(hit, begins + WINDOW, -1)
    edges = np.diff((np.cumsum(hit) > 0).astype(np.int8), prepend=0)
    return [(a, b) for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True) if b - a >= MIN_WORDS]


def find_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """``start, length, period`` of every run of ``words`` in the order of start and period."""
    if len(words) < MIN_WORDS:
        return []
    out = []
    for a, b in repeated_stretches(words):
        names: dict[bytes, int] = {}
        ids = np.array([names.setdefault(w, len(names)) for w in words[a:b]], np.int64)
        out += [(a + s, n, q) for s, n, q in runs_of(ids)]
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that a run holds behind its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words), bool)
    for start, length, period in runs:
        drop[start + period : start + length] = True
    return [words[i] for i in np.flatnonzero(~drop).tolist()]


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
        ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", pa.string()), ("collapsed", pa.string()),
    ]
)


def periodic_runs(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None, with_text: bool = False) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` per row of
    ``docs(doc_id, text)``: the run with the greatest power (ties: least start, then period), digests of all runs
    (``start,length,period`` and a line feed each) and of the words without the repeats, joined by one space. With
    ``with_text`` also these two as ``runs`` and ``collapsed``. ``edit`` may change a document's words first.

    Words are what ASCII blanks part. A null, empty or blank text has no run and collapses to an empty one. Repeated rows
    are treated one by one, a null doc_id like any other; other columns are not read; an empty table gives an empty
    result. One scan, no shuffle; a repeated stretch of n words takes about n * log2(longest repeat) * 8 bytes.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = (text.as_py() or "").encode().split()
                words = edit(doc_id, words) if edit else words
                runs = find_runs(words)
                listed = "".join([f"{s},{n},{q}\n" for s, n, q in runs])
                kept = b" ".join(collapse(words, runs))
                best = None
                for s, n, q in runs:
                    if best is None or n * best[2] > best[1] * q:
                        best = (s, n, q)
                start, length, period = best or (None, None, None)
                milli = 1000 * length // period if best else None
                digests = hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()
                rows.append((doc_id, len(runs), start, length, period, milli, *digests, *((listed, kept.decode()) if with_text else (None, None))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OUT.types, strict=True)], schema=_OUT)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        scan,
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs string, collapsed string",
    )
    return out if with_text else out.drop("runs", "collapsed")
