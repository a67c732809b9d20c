"""WARC archives and their globally ordered capture index.

Writing: equal payloads of at least ``REVISIT_BYTES`` are grouped by SHA-1, one record of a group is the response
and the others revisit it. Spark's text writer ends every row with the two line ends that end a WARC record, so
the archives are plain WARC/1.1 files in any store that Spark can write to.

Reading: each archive is parsed by Content-Length and leaves a run, its captures sorted by URL key and timestamp.
The runs are stored; then each task takes one range of keys out of all runs and merges its slices with a loser
tree, so that the ranges in order are the capture history of every URL. A hot URL is split by timestamp and
record like any other stretch of keys.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm._shared import broadcast_if_small, scratch_path, written
from tidegauge.llm.url_rules import host_key, url_host

REVISIT_BYTES = 1000
#: Records of an archive, and index rows of a range that a task merges, at most about.
ARCHIVE_RECORDS, RANGE_ROWS, BATCH_ROWS = 50_000, 200_000, 10_000
EPOCH = "2020-01-01 00:00:00"
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "url_key string, stamp string, page_id long, record_id string, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, position long"


def capture_records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``value``: one WARC record (without its two closing line ends) per row of ``pages(page_id, url, html)``.

    Of equal payloads of at least ``revisit_bytes``, the one with the largest page_id is the response and the
    others revisit it; rows that share that page_id are all responses, and a null page_id is below any other.
    A null html is an empty payload; a null url is written as an empty target. Line ends in a url become blanks.
    """
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).select("*", F.octet_length("html").cast("long").alias("bytes"), F.sha1(F.col("html").cast("binary")).alias("digest"))
    # digests that repeat, pre-aggregated on the map side and stored; payloads stay where they are while these can be
    # broadcast, and meet them by a join that AQE splits beyond that
    repeated = written(
        page.where(F.col("bytes") >= revisit_bytes)
        .groupBy(F.col("digest").alias("repeated"))
        .agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and holder is not null")
        .select("repeated", "holder"),
        "repeated",
    )
    key = F.when(F.col("bytes") >= revisit_bytes, F.col("digest"))
    joined = page.join(broadcast_if_small(repeated, 64), key == F.col("repeated"), "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("holder")), F.col("holder"))
    is_revisit = F.col("refers").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    stamp = F.date_format(F.timestamp_add("SECOND", F.coalesce(F.pmod("page_id", F.lit(10**9)), F.lit(0)), F.lit(EPOCH).cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    row_id = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1" + END),
        line("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", row_id),
        line("WARC-Date", stamp),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(
            is_revisit,
            F.concat(
                line("WARC-Profile", F.lit(PROFILE)),
                line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers").cast("string"), F.lit(">"))),
                line("X-Payload-Length", F.col("bytes").cast("string")),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(is_revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(END),
    )
    return joined.select("*", refers.alias("refers")).select(F.concat(header, F.when(is_revisit, "").otherwise(F.col("html"))).alias("value"))


def write_archives(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Archives in folder ``path``: Spark part files of at most ``ARCHIVE_RECORDS`` WARC records (gzip on the whole file)."""
    writer = capture_records(pages).write.option("lineSep", END + END).option("compression", compression)
    writer.option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def parse_archive(data: bytes | io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Headers, payload and position of each record, one record in memory at a time; a broken record raises ``ValueError``."""
    source, at = io.BytesIO(data) if isinstance(data, bytes) else data, 0
    while line := source.readline():
        n, headers = len(line), {}
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        while (line := source.readline()) != b"\r\n":
            if not line:
                raise ValueError(f"no WARC record at byte {at}")
            name, value = line.decode().removesuffix(END).split(": ", 1)
            headers[name], n = value, n + len(line)
        size = int(headers["Content-Length"])
        payload = source.read(size)
        if len(payload) < size or source.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has no end")
        yield headers, payload, at
        at += n + 2 + size + 4


def _page(record_id: str | None) -> int | None:
    value = (record_id or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value not in ("", "none") else None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The captures of each archive, in its order; an archive is unpacked record by record."""
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            file, data = path.as_py(), io.BytesIO(content.as_py())
            rows = []
            for h, payload, at in parse_archive(gzip.open(data) if file.endswith(".gz") else data):
                revisit = h["WARC-Type"] == "revisit"
                size = int(h["X-Payload-Length"]) if revisit else len(payload)
                digest = h["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest()
                rows.append((h["WARC-Target-URI"], h["WARC-Date"], _page(h["WARC-Record-ID"]), h["WARC-Record-ID"], h["WARC-Type"], _page(h.get("WARC-Refers-To")), size, digest, file, at))
                if len(rows) == BATCH_ROWS:
                    yield _index_batch(rows)
                    rows = []
            if rows:
                yield _index_batch(rows)


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], _NAMES)


_NAMES = ["url_key", "stamp", "page_id", "record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "file", "position"]
_SCHEMA = pa.schema([(n, pa.int64() if n in ("page_id", "refers_to", "payload_bytes", "position") else pa.string()) for n in _NAMES])


class LoserTree:
    """K-way merge: inner nodes keep the loser of each match, the root the overall winner."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in self.runs] + [None] * (self.k - len(runs))
        self.losers = [-1] * self.k
        for i in range(self.k - 1, -1, -1):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head comes first; -1 beats all while the tree fills, an ended run loses."""
        if a < 0 or b < 0:
            return a < 0
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, run: int) -> None:
        at = (run + self.k) // 2
        while at > 0:
            if self._before(self.losers[at], run):
                self.losers[at], run = run, self.losers[at]
            at //= 2
        self.losers[0] = run

    def __iter__(self):
        while (head := self.heads[self.losers[0]]) is not None:
            yield head
            run = self.losers[0]
            self.heads[run] = next(self.runs[run], None)
            self._play(run)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the slices of a range: rows sorted by run, and within a run by key. Index rows only, no payloads."""
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in _NAMES]
        for row in zip(*columns, strict=True):
            page = row[2] if row[2] is not None else -(2**63)
            runs.setdefault(row[8], []).append(((row[0], row[1], page, row[8], row[9]), row))
    out = []
    for _, row in LoserTree([iter(r) for r in runs.values()]) if runs else ():
        out.append(row)
        if len(out) == BATCH_ROWS:
            yield _index_batch(out)
            out = []
    if out:
        yield _index_batch(out)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The stored runs of the archives in ``path``: captures with their URL keys, sorted within each archive."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    captures = files.mapInArrow(_runs, INDEX)
    key = F.concat(host_key(url_host(F.col("url_key"))), F.lit(")"), F.regexp_extract("url_key", r"^[^:]*://[^/?#]*(.*)$", 1))
    return written(captures.withColumn("url_key", key).sortWithinPartitions("file", "url_key", "stamp", "page_id", "position"), "runs")


def merged_index(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives in ``path``, range by range in order of URL key, timestamp and page_id. Ranges grow in
    number with the captures, not in size."""
    by = ["url_key", "stamp", "page_id", "file", "position"]
    runs = read_runs(spark, path)
    ranges = max(spark.sparkContext.defaultParallelism, -(-runs.count() // RANGE_ROWS))
    return runs.repartitionByRange(ranges, *by).sortWithinPartitions("file", *by).mapInArrow(_merge, INDEX)


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives (to ``path``, default a folder of their own in the scratch folder), read them
    back and return the merged index (columns ``INDEX``). An empty table gives an empty index."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc", "archives")
    write_archives(pages, path)
    return merged_index(spark, path)
