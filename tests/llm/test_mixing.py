"""Scores of the context-mixing model against a plain version bit by bit, and of its base against plain counts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidegauge.llm import mixing, queries

SF = "/root/testdata/sf0.001"
U32 = 0xFFFFFFFF


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def scored(spark):
    return {r["doc_id"]: r for r in queries.op13_context_mixing(spark, SF).collect()}


def out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_base(texts, scored):
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None] for i, t in texts.items()}
    counts = Counter(w for i, ws in split.items() if not out(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert set(scored) == set(texts)
    for i, ws in split.items():
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = scored[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(i), len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)


def test_base_by_shuffle(spark, scored, monkeypatch):
    """A head of forty tokens leaves all others to the join."""
    monkeypatch.setattr(mixing, "HEAD_TOKENS", 40)
    for r in queries.op13_context_mixing(spark, SF).collect():
        own = scored[r["doc_id"]]
        assert (r["n_known"], r["score"]) == (own["n_known"], own["score"])
        assert r["base_score"] == pytest.approx(own["base_score"], abs=1e-6)


def test_scores_do_not_depend_on_partitions(spark, scored):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    for r in mixing.score_documents(docs).collect():
        own = scored[r["doc_id"]]
        assert r["score"] == pytest.approx(own["score"], rel=1e-6) and r["n_known"] == own["n_known"]


def plain_contexts(symbols, i):
    """Contexts of symbol ``i`` of one text from the definition: five ends stand before it."""
    behind = ([mixing.END] * 5 + symbols[:i])[::-1]
    h, found = 0, []
    for j in range(1, 6):
        h = (h + behind[j - 1] + 1) * 0x2C1B3C6D & U32
        h ^= h >> 15
        if j in mixing.ORDERS:
            found.append((h + j) & U32)
    begin = i
    while begin > 0 and i - begin < mixing.WORD_BYTES and symbols[begin - 1] not in b" \t\n\x0b\f\r":
        begin -= 1
    return (*found, bytes(symbols[begin:i]))


def test_contexts_from_the_definition():
    """Hashes agree where the definition says so, wherever the text stands among others."""
    words = [b"one two one two", b"", b"two " + b"x" * 80 + b" one", "é 你好 one".encode()]
    sym, ends, own = mixing.symbols_of(words)
    first, second, word = mixing.contexts(sym)
    assert [int(x) for x in np.flatnonzero(sym == mixing.END) if own[x]] == ends.tolist() and own.sum() == sum(len(w) + 1 for w in words)
    seen = {}
    for text, end in zip(words, ends.tolist(), strict=True):
        symbols = [*text, mixing.END]
        for i in range(len(symbols)):
            at = end - len(text) + i
            a, b, w = plain_contexts(symbols, i)
            assert (int(first[at]), int(second[at])) == (a, b)
            assert seen.setdefault(w, int(word[at])) == int(word[at])
    assert len(set(seen.values())) == len(seen)


def plain_bits(model, text):
    """One bit after the other; weights and corrections change at the end of each block."""
    symbols = [*text, mixing.END]
    sym, ends, _ = mixing.symbols_of([text])
    hashes = mixing.contexts(sym)
    base = int(ends[0]) - len(text)
    steps = []
    for i, s in enumerate(symbols):
        for k in range(int(model.code.length[s])):
            step = int(model.code.offset[s]) + k
            stir, turn = int(model.code.stir[step]), int(model.code.turn[step])
            slot = [((int(h[base + i]) + stir & U32) * 0x85EBCA6B & U32) >> (32 - mixing.TABLE_BITS) for h in hashes]
            steps.append(([int(t[x]) for t, x in zip(model.tables, slot, strict=True)], turn))
    weights = [[w / mixing.SCALE for w in row] for row in mixing.START_WEIGHTS]
    shift, seen = np.zeros(128), np.full(128, 20.0)
    at, block, bits = 0, mixing.FIRST_BLOCK, 0.0
    while at < len(steps):
        slopes, moves, hits = np.zeros((4, 3)), np.zeros(128), np.zeros(128)
        for x, turn in steps[at : at + block]:
            gate = (x[1] != 0) + 2 * (x[2] != 0)
            mixed = sum(w * v for w, v in zip(weights[gate], x, strict=True))
            cell = 32 * gate + int(min(31, max(0, mixed * 2 + 16)))
            p = 1 / (1 + math.exp(-(mixed + shift[cell])))
            bits -= math.log2(p if turn else 1 - p)
            slopes[gate] += (turn - p) * np.array(x)
            moves[cell] += turn - p
            hits[cell] += 1
        weights = [[w + mixing.RATE * g for w, g in zip(row, own, strict=True)] for row, own in zip(weights, slopes, strict=True)]
        shift, seen = shift + moves / seen, seen + 0.25 * hits
        at, block = at + block, min(2 * block, mixing.LAST_BLOCK)
    return bits


@pytest.fixture(scope="module")
def model(texts):
    counts = np.zeros(257, np.int64)
    train = [t.encode() for i, t in texts.items() if not out(i)]
    for t in train:
        counts[:256] += np.bincount(np.frombuffer(t, np.uint8), minlength=256)
    counts[256] = len(train)
    tables = mixing.Tables(mixing.Code(counts))
    for t in train:
        tables.add(t)
    tables.fold()
    return mixing.Model(counts, [mixing.log_odds(c) for c in tables.counts])


def test_score_bit_by_bit(texts, scored, model):
    """The distributed tables give what one pass over all training texts gives, and blocks what single bits give."""
    for i in sorted(texts)[::9]:
        if len(texts[i]) < 3000:  # two blocks and more
            want = plain_bits(model, texts[i].encode())
            assert scored[i]["score"] == pytest.approx(-want * math.log10(2), rel=1e-4), i


def test_tables_from_the_definition(texts, model):
    """Zeros and ones behind a context, counted symbol by symbol, for a few texts alone."""
    code, few = model.code, [texts[i].encode()[:300] for i in sorted(texts)[:5]]
    tables = mixing.Tables(code)
    for t in few:
        tables.add(t)
    tables.fold()
    want = [Counter() for _ in range(3)]
    for t in few:
        sym, ends, _ = mixing.symbols_of([t])
        hashes = mixing.contexts(sym)
        for i, s in enumerate([*t, mixing.END]):
            for k in range(int(code.length[s])):
                step = int(code.offset[s]) + k
                for own, h in zip(want, hashes, strict=True):
                    x = ((int(h[int(ends[0]) - len(t) + i]) + int(code.stir[step]) & U32) * 0x85EBCA6B & U32) >> (32 - mixing.TABLE_BITS)
                    own[2 * x + int(code.turn[step])] += 1
    for counts, own in zip(tables.counts, want, strict=True):
        assert {int(x): int(counts[x]) for x in np.flatnonzero(counts)} == own


def test_probabilities_of_all_continuations_sum_to_one(model):
    """The code's turns are a binary tree: the chances of all 257 next symbols sum to one."""
    mixed = 0.0
    for s in range(257):
        chance = 1.0
        for k in range(int(model.code.length[s])):
            step = int(model.code.offset[s]) + k
            odds = (int(model.code.stir[step]) % 97 - 48) / 16  # any odds that depend on the node alone
            chance *= 1 / (1 + math.exp(-odds if model.code.turn[step] else odds))
        mixed += chance
    assert mixed == pytest.approx(1.0)


def test_windows_of_long_texts(model, monkeypatch):
    """The mixer is given the same bits and inputs whether a text comes whole or in windows."""
    text = ("The word and the words, " * 40 + "é你" * 30 + "x" * 100).encode()
    given = []
    monkeypatch.setattr(mixing.Mixer, "run", lambda self, *parts: given.append(parts))
    model.bits([text])
    whole, given[:] = given[0], []
    monkeypatch.setattr(mixing, "WINDOW", 100)
    model.bits([text])
    assert len(given) > 10 and all((np.concatenate([g[k] for g in given], axis=-1) == whole[k]).all() for k in range(3))


def test_held_out_texts_are_predicted(texts, scored):
    """Better than the code alone and than four bits for a byte, though two hundred documents train it."""
    bits = n = 0
    for i, t in texts.items():
        if out(i):
            bits -= scored[i]["score"] / math.log10(2)
            n += len(t.encode())
    assert n > 10_000 and bits / n < 3.6
    assert all(r["bits_per_byte"] > 0 for r in scored.values())


def test_head_bound(spark):
    words = spark.createDataFrame([(bytes([i]), n) for i, n in enumerate([1, 1, 1, 2, 3, 50, 51, 900])], "token binary, n long")
    assert mixing.head_bound(words.limit(0)) == 2**63 - 1
    for most in (1, 2, 3, 5, 8):
        held = words.where(f"n >= {(b := _with_head(words, most))}").count()
        assert held <= most and (held == most or b > 1)


def _with_head(words, most):
    was, mixing.HEAD_TOKENS = mixing.HEAD_TOKENS, most
    try:
        return mixing.head_bound(words)
    finally:
        mixing.HEAD_TOKENS = was


def test_long_tokens_and_edges(spark):
    rows = [(i, t) for i, t in enumerate(["a b", None, "", "q" * 100 + " a", "q" * 100, "Q" * 100 + " zz", "a b"] * 3)] + [(None, "a b"), (3, "a")]
    got = mixing.score_documents(spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, score double, token string")).collect()
    assert len(got) == len(rows) and all(r["score"] < 0 and r["base_score"] < 0 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[None][0]["held_out"] and [len(by[3]), by[3][0]["train_tokens"]] == [2, by[0][0]["train_tokens"]]
    assert {r["n_tokens"] for r in got} == {1, 2, 3} and by[0][0]["score"] == by[6][0]["score"]
    assert by[4][0]["n_known"] == 2  # the long token is known under its digest
