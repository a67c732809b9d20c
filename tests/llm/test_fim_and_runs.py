"""Fill-in-the-middle and periodic runs against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.llm import fim, periodic, queries

SF = "/root/testdata/sf0.001"


def plain_fim(doc_id, text):
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab Zé你\U0001f600<PSM>\n\x00_1", max_size=60), st.integers(-3, 400))
def test_fim_text(text, doc_id):
    raw = text.encode()
    out, form, n, prefix, middle = fim.rearrange(raw, fim.draws(doc_id, 1))
    assert (n, form, prefix, middle, out.decode()) == plain_fim(doc_id, text)
    assert fim.restore(out, form) == raw


def test_select():
    rng = random.Random(3)
    for width in (1, 2, 3, 64, 1000):
        bits = rng.getrandbits(width)
        ones = [i for i in range(width) if bits >> (width - 1 - i) & 1]
        assert [fim.select(bits, width, r) for r in range(len(ones) + 1)] == [*ones, width]


def test_fim_on_every_document(spark):
    got = {r["doc_id"]: r for r in fim.fill_in_middle(spark.read.parquet(f"{SF}/documents.parquet"), with_output=True).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        own, text = got[r["doc_id"]], r["text"] or ""
        want = plain_fim(r["doc_id"], text)
        assert (own["n"], own["form"], own["prefix_chars"], own["middle_chars"], own["output"]) == want
        assert own["output_sha256"] == hashlib.sha256(want[4].encode()).hexdigest() and own["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}


def test_fim_edges(spark):
    rows = [(None, "a b c"), (1, None), (2, ""), (3, "x<P>y"), (4, "\U0001f600" * 50), (4, "\U0001f600" * 50), (5, "word " * 100_000)]
    got = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), with_output=True).collect()
    assert len(got) == len(rows) and [r["form"] for r in got if r["doc_id"] in (1, 2, 3)] == ["plain"] * 3
    assert len({r["output"] for r in got if r["doc_id"] == 4}) == 1
    assert all(r["restored_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for r, (_, t) in zip(sorted(got, key=lambda r: r["doc_id"] or 0), rows, strict=True))


def plain_runs(w, min_words, min_power):
    """Every period and every stretch that keeps it; a stretch with a smaller period falls."""
    n, out = len(w), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            if w[i] == w[i + q]:
                j = i
                while j + q < n and w[j] == w[j + q]:
                    j += 1
                length = j - i + q
                if length >= max(min_words, min_power * q) and not any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                    out.append((i, length, q))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_every_period(seed):
    rng = random.Random(seed)
    for _ in range(400):
        n, k = rng.randint(0, 70), rng.randint(1, 4)
        w = [rng.randrange(k) for _ in range(n)]
        if n > 5 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 9)
            w = [w[i] if i < a else w[a + (i - a) % min(p, n - a)] for i in range(n)]
        names = {}
        ids = np.array([names.setdefault(x, len(names)) for x in w], np.int64)
        assert periodic.runs_of(ids, 2, 2) == plain_runs(w, 2, 2)
        assert periodic.find_runs([b"%d" % x for x in w]) == plain_runs(w, 24, 3)


def test_vocabulary_is_complete():
    """Phase one and the walks find every different square."""
    rng = random.Random(9)
    for _ in range(200):
        w = np.array([rng.randrange(2) for _ in range(rng.randint(2, 40))], np.int64)
        tree = periodic.SuffixTree(w)
        nodes, halves = tree.vocabulary()
        got = {tuple(w[tree.order[tree.left[v]] :][: 2 * k]) for v, k in zip(nodes, halves, strict=True)}
        want = {tuple(w[i : i + 2 * k]) for k in range(1, len(w)) for i in range(len(w) - 2 * k + 1) if (w[i : i + k] == w[i + k : i + 2 * k]).all()}
        assert got == want and len(nodes) == len(want)


def test_long_texts_of_one_word():
    words = [b"a"] * 20_000 + [b"b"] + [b"x", b"y", b"z"] * 10_000
    assert periodic.find_runs(words) == [(0, 20_000, 1), (20_001, 30_000, 3)]
    assert periodic.collapse(words, periodic.find_runs(words)) == [b"a", b"b", b"x", b"y", b"z"]


def test_op12_on_every_document(spark):
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    found = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        h = zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if len(words) > 1500 and h % 10:
            continue  # the plain version takes the square of the words
        runs = plain_runs(words, 24, 3)
        drop = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        own = got[r["doc_id"]]
        assert (own["n_runs"], own["start"], own["length"], own["period"]) == (len(runs), *best), r["doc_id"]
        assert own["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert own["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert own["collapsed_sha256"] == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in drop).encode()).hexdigest()
        found += bool(runs)
    assert found > 3


def test_runs_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a\u00a0b " * 30), (4, "a\u00a0b " * 30), (None, "x y " * 12)]
    got = sorted(periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect(), key=lambda r: r["doc_id"] or 0)
    assert [(r["n_runs"], r["collapsed"]) for r in got] == [(1, "x y"), (0, ""), (0, ""), (0, ""), (1, "a\u00a0b"), (1, "a\u00a0b")]
    assert [(r["start"], r["length"], r["period"], r["exponent_milli"]) for r in got[-1:]] == [(0, 30, 1, 30_000)]
