"""Operators that SQL cannot express, against plain versions over whole small tables."""

import base64
import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as tok
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from tidegauge.llm import bpe, lzprint, packing, pii, quality, queries, simhash, warc
from tidegauge.llm.license_scan import license_scan, words_of
from tidegauge.llm.oracle import QUALITY_SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(codes):
    ids = sorted(codes)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if (codes[a] ^ codes[b]).bit_count() <= 4:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, texts):
    codes = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(codes)
    got = queries.op2_simhash_neardup(spark, SF).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{codes[i]:016x}", want[i]) for i in codes}


@pytest.mark.parametrize("blocks, cell_rows", [(5, 32_768), (6, 32_768), (7, 32_768), (5, 40)])
def test_near_links_finds_every_component(spark, blocks, cell_rows):
    """Dense balls of near copies, far-off singles, and cells split into parts."""
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    codes = {int(x) for x in rng.integers(0, 1 << 63, 60, dtype=np.uint64)}
    for c in centres:
        for _ in range(70):
            x = int(c)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            codes.add(x)
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    from tidegauge.llm.components import roots

    rows = spark.createDataFrame(signed, "code long").selectExpr("code as id", "0 as print", "code", "0L as check")
    link = roots(simhash.near_links(rows, blocks, cell_rows)).collect()
    root = {r["u"]: r["v"] for r in link}
    got = {}
    for (c,) in signed:
        got.setdefault(root.get(c, c), set()).add(c % (1 << 64))
    want = {}
    for i, r in plain_components({c: c for c in codes}).items():
        want.setdefault(r, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def plain_groups(texts):
    """Links of different texts: word sets alike in four bits or fewer under one seed, five-word shingles in 14 or fewer."""
    lowered = {t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) for t in texts}

    def bits(features, seed):
        h = [xxhash.xxh64_intdigest(f.encode(), seed) for f in features]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    shingles = lambda w: [" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    made = {t: ([bits(sorted(set(w)), seed) for seed in (42, 43, 44, 45)], bits(shingles(w), 42)) for t, w in lowered.items()}
    group = {t: t for t in made}

    def find(t):
        while group[t] != t:
            t = group[t]
        return t

    for a, b in itertools.combinations(made, 2):
        if (made[a][1] ^ made[b][1]).bit_count() <= 14 and any((x ^ y).bit_count() <= 4 for x, y in zip(made[a][0], made[b][0], strict=True)):
            group[find(a)] = find(b)
    return {t: find(t) for t in made}


@pytest.mark.parametrize("broadcast", [True, False])
def test_one_row_of_each_group_stays(spark, texts, monkeypatch, broadcast):
    """Repeated and null ids, repeated rows, and every document of the smallest table; with and without a broadcast."""
    if not broadcast:
        monkeypatch.setattr(simhash, "broadcast_if_small", lambda df, row_bytes: df)
    own = list(texts.items())
    rows = [*own, *own[:3], (own[4][0], own[9][1] + " x1"), (None, own[5][1]), (None, "p q r s t u v w"), (None, "only here once"), (7, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, codes string, `_id` int")
    kept = [(r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(docs).collect()]
    group = plain_groups({t or "" for _, t in rows})
    first = {}
    for i, t in rows:
        g = group[t or ""]
        first[g] = min(first.get(g, (True, 0)), (i is None, i or 0))
    assert len(kept) == len(first) == len({group[t or ""] for _, t in kept})
    assert all((i is None, i or 0) == first[group[t or ""]] for i, t in kept)


def test_every_link_comes_from_the_index(spark, monkeypatch):
    """With an index that finds nothing, nothing is linked, however small the top nodes are."""
    codes = np.array([0, 1, 3, 1 << 40], np.uint64)
    cell, checks = np.zeros(4, np.int64), np.zeros(4, np.uint64)
    order = np.argsort(simhash.gray_rank(codes))
    assert (simhash.link_members(cell, codes[order], checks) == 0).all()
    monkeypatch.setattr(simhash.GrayIndex, "near", lambda self, asked, root, parent: (asked[:0], asked[:0]))
    assert (simhash.link_members(cell, codes[order], checks) == np.arange(4)).all()


def test_near_copies_are_caught(spark):
    """Recall of the pipeline's stage: copies with a similarity of 0.8 to 0.9 on five-word shingles to texts of their own."""
    rng = np.random.default_rng(5)
    read = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400").select("text").distinct().collect()
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows = []
    for words in ((r["text"] or "").split() for r in read):
        if not 60 <= len(words) <= 1000:
            continue
        made, own = list(words), shingles(words)
        for at in rng.permutation(len(words)):
            changed = [*made[:at], f"edit{len(rows)}", *made[at + 1 :]]
            if 10 * len(own & shingles(changed)) < 8 * len(own | shingles(changed)):
                break
            made = changed
        if made != words:
            rows.append((2 * len(rows), " ".join(words)))
            rows.append((rows[-1][0] + 1, " ".join(made)))
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = sum(i + 1 not in kept for i, _ in rows[::2])
    assert len(rows) > 300 and caught >= 0.9 * len(rows) / 2, (caught, len(rows) / 2)


def test_blocks_follow_the_number_of_fingerprints():
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**8, 10**10, 10**12)] == [5, 5, 6, 7, 8]


def test_packing(spark, texts):
    t = Tokenizer.from_file(tok.path("word_bpe_49k.json"))
    want = {}
    for i, e in zip(texts, t.encode_batch(list(texts.values()), add_special_tokens=False), strict=True):
        ids = [*e.ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            want[i, k] = (at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes()))
    rows = queries.op4_best_fit_packing(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 2048 and len(at) <= 1.02 * sum(at.values()) / 2048 + 1


def test_bpe(spark, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in queries.op10_byte_bpe(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = np.array(enc.encode_ordinary(text), "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    table = bpe.PerfectHash(ranks)
    assert all(table.get(k) == r for k, r in ranks.items()) and table.get(b"no such entry") is None
    assert sorted(table.rank) == sorted(ranks.values())
    for piece in ("ααααααα", "Thththereable", "你好世界", "\x00\x00", "aaaaaaaaaaaaaaaaaaaaaaaa"):
        assert bpe.merge_bytes(piece.encode(), table.get) == enc._core_bpe.encode_single_piece(piece.encode())


def plain_phrases(text):
    seen, held = set(), ""
    for c in text:
        held += c
        if held not in seen:
            seen.add(held)
            held = ""
    return seen | ({held} if held else set())


@pytest.mark.parametrize("range_rows", [10**6, 16])
def test_lz(spark, texts, range_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in lzprint.lz_fingerprints(docs, range_rows).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids and len(got) == len(ids)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        text, n = texts[i], len(texts[i]) // 4
        edited = text[: len(text) - n] + texts[j][:n]
        row = got[i]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        sigs = [lzprint.signature(plain_phrases(t), "") for t in (text, edited, texts[j])]
        assert [row["fingerprint"], row["edited_fingerprint"]] == [lzprint.as_text(s) for s in sigs[:2]]
        assert row["near_edited"] == lzprint.likeness(sigs[0], sigs[1]) and row["near_next"] == lzprint.likeness(sigs[0], sigs[2])
    # an estimate of the Jaccard index of the phrase sets
    off = [abs(got[i]["near_edited"] - len(a & b) / len(a | b)) for i, j in zip(ids, ids[1:], strict=False)
           for a, b in [(plain_phrases(texts[i]), plain_phrases(texts[i][: len(texts[i]) - len(texts[i]) // 4] + texts[j][: len(texts[i]) // 4]))] if len(a) > 200]
    assert np.mean(off) < 0.1


def test_warc_files_are_read_by_content_length(spark, tmp_path):
    path = f"{tmp_path}/w"
    warc.write_archives(spark.read.parquet(f"{SF}/pages.parquet"), f"file://{path}", "none")
    found = []
    for file in tmp_path.glob("w/part-*"):
        found += [h["WARC-Record-ID"] for h, _, _ in warc.parse_archive(file.read_bytes())]
    assert len(found) == len(set(found)) == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_quality_exact_path_agrees(spark, texts, monkeypatch):
    """A hash that always collides sends every text down the exact path."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fast = {r["doc_id"]: r["quality"]["n_repeat_words"] for r in quality.assess_documents(docs).collect()}
    from pyspark.sql import functions as F

    monkeypatch.setattr(quality, "_window_hash", lambda i: F.xxhash64(F.lit(1)))
    slow = {r["doc_id"]: r["quality"]["n_repeat_words"] for r in quality.assess_documents(docs).collect()}
    assert fast == slow and any(fast.values())


def test_license_words():
    assert words_of("MIT-License é\x80K") == ["mit", "license", "é\x80k"]


def test_license_words_everywhere(spark):
    """Long texts of little but anchor words: work must not grow with the square of the hits."""
    n = 30_000
    rows = [(1, "MIT license " * n), (2, "license " * n), (3, "licensed under the \u212aernel mit licen\u017fe"), (4, "Apache License, " * n)]
    got = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i]["n_base"], got[i]["first_word"], got[i]["last_word"]) for i in got] == [(n, 0, 2 * n - 2), (0, None, None), (0, None, None), (n, 0, 2 * n - 2)]
    assert got[1]["base_labels"] == "mit" and got[4]["base_labels"] == "apache" and got[3]["labels"] == ""


def test_pipeline(spark, texts):
    """Stages against plain versions on the rows that the stage before has left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, SF)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert ids == {i for i, k in c.execute(f"SELECT doc_id, kept FROM ({QUALITY_SQL})").fetchall() if k} and ids
    single = stages["simhash_dedup"](spark, kept, SF)
    group = plain_groups({texts[i] for i in ids})
    first = {}
    for i in sorted(ids):
        first.setdefault(group[texts[i]], i)
    left = set(first.values())
    assert {r["doc_id"] for r in single.collect()} == left and single.columns == docs.columns
    hidden = stages["pii_surrogates"](spark, single, SF)
    assert hidden.columns == docs.columns and hidden.count() == single.count()
    pattern = re.compile(r"[\w.]+@\w+\.example\.com|AKIA[A-Z0-9]{16}|password=\w+")
    before = {m for i in left for m in pattern.findall(texts[i])}
    assert before and not before & {m for r in hidden.collect() for m in pattern.findall(r["text"])}
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.collect()} == left
    assert pii.KINDS and packing.MAX_TOKENS == 2048
