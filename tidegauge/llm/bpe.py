"""Byte-level BPE with two tiers of lookup.

Tier one is a minimal perfect hash over the vocabulary (hash and displace: as many slots as entries, one
displacement per bucket): a pre-token whose slot holds its own bytes is that entry. Tier two takes the rest:
the pre-token's bytes become a linked list and a heap offers the adjacent pair with the lowest rank, the leftmost
on ties, until no pair is an entry. Decoding joins the entries' bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that remembered pre-tokens may take in a worker, with ``ENTRY_BYTES`` for each besides its letters and ids.
MEMO_BYTES, ENTRY_BYTES = 96 << 20, 180
_MASK = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash from the byte strings of a vocabulary to their ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = len(ranks)
        buckets: list[list[bytes]] = [[] for _ in range(self.size // 3 + 1)]
        for key in ranks:
            buckets[xxhash.xxh64_intdigest(key) % len(buckets)].append(key)
        self.displacement = [0] * len(buckets)
        self.keys: list[bytes | None] = [None] * self.size
        for at in sorted(range(len(buckets)), key=lambda i: -len(buckets[i])):
            if len(buckets[at]) < 2:
                break
            hashes = [xxhash.xxh64_intdigest(k) for k in buckets[at]]
            shift = 1
            while True:
                slots = {self._slot(h, shift) for h in hashes}
                if len(slots) == len(hashes) and all(self.keys[s] is None for s in slots):
                    break
                shift += 1
            self.displacement[at] = shift
            for key, h in zip(buckets[at], hashes, strict=True):
                self.keys[self._slot(h, shift)] = key
        free = iter([i for i, k in enumerate(self.keys) if k is None])
        for at, own in enumerate(buckets):
            if len(own) == 1:  # a bucket of one names its slot outright
                slot = next(free)
                self.keys[slot], self.displacement[at] = own[0], -slot - 1
        self.rank = [ranks[k] for k in self.keys]

    def _slot(self, h: int, shift: int) -> int:
        return (((h ^ (shift * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 & _MASK) >> 20) % self.size

    def get(self, key: bytes) -> int | None:
        h = xxhash.xxh64_intdigest(key)
        d = self.displacement[h % len(self.displacement)]
        slot = -d - 1 if d < 0 else self._slot(h, d)
        return self.rank[slot] if self.keys[slot] == key else None


def merge_bytes(piece: bytes, rank) -> list[int]:
    """Ids of a pre-token by heap merges over a doubly linked list of byte spans; ``rank(bytes)`` is its rank or None."""
    n = len(piece)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        j = right[i]
        if end[i] != middle or j < 0 or end[j] != stop:
            continue  # a part of the pair has changed since
        k = right[j]
        end[i], right[i], end[j] = stop, k, -1
        if k >= 0:
            left[k] = i
            if (r := rank(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[k]))
        p = left[i]
        if p >= 0 and (r := rank(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, i, stop))
    out, i = [], 0
    while i >= 0 and n:
        out.append(rank(piece[i : end[i]]))
        i = right[i]
    return out


class Codec:
    def __init__(self, rank_file: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.pattern, self.table, self.pair_rank = regex.compile(pattern), PerfectHash(ranks), ranks.get
        self.entry = [b""] * (max(ranks.values()) + 1)
        for key, r in ranks.items():
            self.entry[r] = key
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def _encode_token(self, token: str) -> bytes:
        raw = token.encode()
        whole = self.table.get(raw)
        ids = [whole] if whole is not None else merge_bytes(raw, self.pair_rank)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. Encoded pre-tokens are remembered, ``MEMO_BYTES`` at most."""
        tokens = self.pattern.findall(text)
        missing = set(tokens).difference(self.memo)
        fresh = {t: self._encode_token(t) for t in missing}
        size = sum(ENTRY_BYTES + 4 * len(t) + len(ids) for t, ids in fresh.items())
        if self.held + size > MEMO_BYTES:
            fresh = {t: self.memo.get(t) or self._encode_token(t) for t in set(tokens)} if self.memo else fresh
            self.memo, self.held = {}, 0
            size = sum(ENTRY_BYTES + 4 * len(t) + len(ids) for t, ids in fresh.items())
        memo = fresh
        if size <= MEMO_BYTES:  # a single text may have more different pre-tokens than that; it keeps them for itself
            self.memo.update(fresh)
            self.held += size
            memo = self.memo
        return b"".join([memo[t] for t in tokens])

    def decode(self, ids: bytes) -> bytes:
        return b"".join([self.entry[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def codec(rank_file: bytes, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def bpe_encode(docs: DataFrame, rank_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row of ``docs(doc_id, text)``; with ``with_ids`` also ``ids``
    (little-endian uint32 bytes) and ``decoded`` (bytes). A null text is empty; repeated rows are encoded one by one.

    One scan without a shuffle. The rank file (0.8 MB, fixed) is broadcast; a worker builds its tables once.
    """
    with open(rank_path, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file.value, pattern)
        for batch in batches:
            n, ids_sha, text_sha, all_ids, all_text = [], [], [], [], []
            for t in batch.column("text"):
                ids = own.encode(t.as_py() or "")
                decoded = own.decode(ids)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoded).hexdigest())
                all_ids.append(ids if with_ids else None)
                all_text.append(decoded if with_ids else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(all_ids, pa.binary()), pa.array(all_text, pa.binary())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"],
            )

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded binary"
    )
    return out if with_ids else out.drop("ids", "decoded")
