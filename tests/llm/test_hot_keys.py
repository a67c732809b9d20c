"""Repeated and null ids, clashing columns and deep trees, against plain versions."""

import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from tidegauge.llm import chat, lzprint, warc


def signed(text):
    return 42 if text is None else (xxhash.xxh64_intdigest(text.encode(), 42) ^ 1 << 63) - (1 << 63)


def test_lz_order_of_repeated_and_null_ids(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choices("abcd ", k=draw.randrange(60))) for _ in range(40)] + ["same text " * 4] * 30 + [None, "", None]
    ids = [None if i % 7 == 0 else 5 if i % 2 else i for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, range(len(texts)), strict=True)), "doc_id long, text string, id int")
    docs = docs.select("*", F.lit("x").alias("hash"), F.lit("y").alias("row"), F.lit(1).alias("edge")).repartition(5)
    rows = sorted(zip(ids, texts, strict=True), key=lambda r: (-(2**63) if r[0] is None else r[0], signed(r[1])))
    want = []
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1], strict=True):
        a, b = a or "", b or ""
        n = len(a) // 4
        want.append((str(i), len(a), hashlib.sha256((a[: len(a) - n] + b[:n]).encode()).hexdigest()))
    for range_rows in (4, 1000):
        got = lzprint.lz_fingerprints(docs, range_rows).collect()
        assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)


def test_warc_passes_over_other_columns(spark, tmp_path):
    rows = [(1, "http://a.org/x", "p" * 1200, "d", 1, None), (2, "http://a.org/x", "p" * 1200, "e", 2, None), (None, None, None, None, 3, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, bytes int, holder string")
    got = warc.archive_pages(pages, f"file://{tmp_path}/w").collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got) == [
        (0, "response", None, 0), (1, "revisit", 2, 1200), (2, "response", None, 1200)]


def test_warc_records_with_blank_lines_and_broken_ends():
    whole = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 6\r\n\r\na\r\n\r\nb\r\n\r\n"
    assert [(h["WARC-Type"], p, at) for h, p, at in warc.parse_archive(whole * 2)] == [
        ("response", b"a\r\n\r\nb", 0), ("response", b"a\r\n\r\nb", len(whole))]
    for broken in (whole[:-1], whole[:-6], whole[2:], whole[:20]):
        try:
            list(warc.parse_archive(broken))
        except ValueError:
            continue
        raise AssertionError(broken)


def test_chat_null_ids_and_clashing_columns(spark):
    rows = [(None, 1, "user", "q"), (None, 2, "assistant", "a"), (7, None, None, None), (7, 1, "assistant", "b")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select(
        "*", F.lit(1).alias("tree_id"), F.lit(2).alias("node"), F.lit(3).alias("depth"), F.lit(4).alias("score"))
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.read_back(chat.format_conversations(talks)).collect()}
    assert got == {None: (2, 1), 7: (2, 1)}


def test_paths_of_random_trees(spark):
    draw, rows = random.Random(5), []
    for tree in range(6):
        for node in range(1, 40):
            rows.append((tree, node, draw.randrange(max(1, node - 4), node) if node > 1 else None, float(draw.randrange(9))))
    messages = spark.createDataFrame(rows, "tree_id long, node long, parent long, score double")
    up = {(t, n): p for t, n, p, _ in rows}
    score = {(t, n): s for t, n, _, s in rows}
    want = set()
    for t, n in set(up) - {(t, p) for (t, _), p in up.items()}:
        path = [n]
        while up[t, path[0]] is not None:
            path.insert(0, up[t, path[0]])
        want.add((t, n, tuple(path), sum(score[t, x] for x in path)))
    assert {(r["tree_id"], r["leaf"], tuple(r["path"]), r["score"]) for r in chat.tree_paths(messages).collect()} == want


def test_rows_alike_in_id_and_text_leave_the_same_one(spark):
    """Eight rows of one doc_id and text, told apart by another column: one and the same stays, however they are dealt."""
    from tidegauge.llm.simhash import drop_near_duplicates

    rows = [(1, "a text of some words that repeats", i) for i in range(8)] + [(2, "quite another text", 9)]
    kept = set()
    for n in (1, 3, 8):
        df = spark.createDataFrame(rows, "doc_id long, text string, other long").repartition(n)
        kept.add(tuple(sorted((r["doc_id"], r["other"]) for r in drop_near_duplicates(df).collect())))
    assert len(kept) == 1 and len(kept.pop()) == 2


def test_stored_steps_leave_the_session_as_it_was(spark):
    from tidegauge.llm._shared import written

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    sizes = lambda batches: (b.from_arrays([b.column(0).take([0])], ["id"]) for b in batches)
    assert written(spark.range(0, 40, 1, 1).mapInArrow(sizes, "id long"), "x", 10).count() == 4
    assert spark.conf.get(name) == was
    spark.conf.set(name, "7")
    try:
        assert written(spark.range(0, 14, 1, 1).mapInArrow(sizes, "id long"), "x", 10).count() == 2  # a user's own size stays
        assert spark.conf.get(name) == "7"
    finally:
        spark.conf.set(name, was)


def test_bpe_memo_is_bounded_by_bytes(monkeypatch):
    import public_tokenizers

    from tidegauge.llm import bpe, queries

    own = bpe.Codec(open(queries.RANKS, "rb").read(), public_tokenizers.PATTERN)
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(20)] + ["long" * 2000]
    want = [own.encode(t) for t in texts]
    monkeypatch.setattr(bpe, "MEMO_BYTES", 20_000)
    own.memo, own.held = {}, 0
    for t, w in zip(texts, want, strict=True):
        assert own.encode(t) == w and own.held <= 20_000
        assert own.held == sum(bpe.ENTRY_BYTES + 4 * len(k) + len(v) for k, v in own.memo.items())
