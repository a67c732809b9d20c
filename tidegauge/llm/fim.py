"""Fill-in-the-middle rearrangement by bit-parallel integers.

``bytes.translate`` turns a UTF-8 text into masks of a bit per byte, held in one big integer each (the first byte is the
most significant bit). Shifted boolean operations on the masks mark where tokens ``[A-Za-z]+|[^A-Za-z]`` begin,
``bit_count`` counts them, and recursive halving finds the byte where the token of a given rank begins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: Shares in hundredths: documents that stay plain, and rearranged ones whose suffix comes first.
PLAIN_SHARE, SPM_SHARE = 10, 20

_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_IS_LETTER = bytes(0x31 if b in _LETTERS else 0x30 for b in range(256))
_IS_HEAD = bytes(0x30 if 0x80 <= b < 0xC0 else 0x31 for b in range(256))  # not a continuation byte


def masks(raw: bytes) -> tuple[int, int]:
    """Bits of the bytes that begin a code point, and of those that begin a token."""
    if not raw:
        return 0, 0
    heads, letters = int(raw.translate(_IS_HEAD), 2), int(raw.translate(_IS_LETTER), 2)
    return heads, heads ^ (letters & (letters >> 1))


def select(bits: int, width: int, rank: int) -> int:
    """Place, from the most significant of ``width`` bits, of the set bit with ``rank`` (from 0) before it; ``width`` if
    there are no more than ``rank``. Each step keeps the half that holds it."""
    if rank >= bits.bit_count():
        return width
    at = 0
    while width > 1:
        low = width >> 1
        high = bits >> low
        n = high.bit_count()
        if rank < n:
            bits, width = high, width - low
        else:
            rank, at = rank - n, at + width - low
            bits, width = bits ^ (high << low), low
    return at


def draws(doc_id, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers of a document; a null id is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4]) for i in (0, 4, 8, 12)]


def rearrange(raw: bytes, h: list[int]) -> tuple[bytes, str, int, int | None, int | None]:
    """Output, form, tokens, and code points of prefix and middle (None if the text stays plain)."""
    heads, starts = masks(raw)
    n = starts.bit_count()
    if not raw or h[2] % 100 >= 100 - PLAIN_SHARE or any(m in raw for m in MARKERS):
        return raw, "plain", n, None, None
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = select(starts, len(raw), first), select(starts, len(raw), last)
    before_a, before_b = (heads >> (len(raw) - a)).bit_count(), (heads >> (len(raw) - b)).bit_count()
    if h[3] % 100 < SPM_SHARE:
        out, form = b"".join((SUFFIX, raw[b:], PREFIX, raw[:a], MIDDLE, raw[a:b])), "spm"
    else:
        out, form = b"".join((PREFIX, raw[:a], SUFFIX, raw[b:], MIDDLE, raw[a:b])), "psm"
    return out, form, n, before_a, before_b - before_a


def restore(output: bytes, form: str) -> bytes:
    """The text that ``rearrange`` was given: rearranged texts hold no marker of their own, and no marker overlaps itself."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE, 1)
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, two = head[len(first) :].split(second, 1)
    return one + middle + two if form == "psm" else two + middle + one


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
        ("output_sha256", pa.string()), ("restored_sha256", pa.string()), ("output", pa.string()),
    ]
)


def fill_in_middle(docs: DataFrame, seed: int = 1, with_output: bool = False) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` per row of ``docs(doc_id, text)``;
    with ``with_output`` also the training text ``output``. ``restored_sha256`` is of the text rebuilt from the output.

    The cuts depend on ``seed`` and doc_id alone, so repeated ids are cut by the same draws and equal rows alike. A null
    or empty text stays plain, and so does one that holds a marker. A null doc_id draws as an empty one. Other columns
    are not read; an empty table gives an empty result. One scan, no shuffle; memory is a few times the longest text.
    """

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                output, form, n, prefix, middle = rearrange((text.as_py() or "").encode(), draws(doc_id, seed))
                again = hashlib.sha256(restore(output, form)).hexdigest()
                rows.append((doc_id, n, form, prefix, middle, hashlib.sha256(output).hexdigest(), again, output.decode() if with_output else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OUT.types, strict=True)], schema=_OUT)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        transform,
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, output string",
    )
    return out if with_output else out.drop("output")
