"""Queries of the training-data operators against their SQL, and op9 against a plain version, on the smallest tables."""

import duckdb
import pytest
import regex

from tidegauge.llm import oracle, pii, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", oracle.ORACLE)
def test_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    cursor = duck.execute(oracle.ORACLE[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(columns) == names
    want = [tuple(r[columns.index(c)] for c in names) for r in cursor.fetchall()]
    got = [tuple(r[c] for c in names) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def plain_entities(text):
    """Entities and what stands around them: the operator's patterns, its check of cards and addresses written anew."""
    pattern = "|".join(f"(?:{p})" for p in pii.KINDS.values()).replace(r"\d", "[0-9]").replace(r"\s", "[ \t\n\x0b\f\r]")
    around, found, at = [], [], 0
    for m in regex.finditer(pattern, text):
        s = m[0]
        digits = [int(c) for c in s if c in "0123456789"]
        if regex.fullmatch(r"[0-9]{4}(?:[ -]?[0-9]{4}){3}", s):
            luhn = sum(sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(digits))
            if digits[0] not in range(2, 7) or luhn % 10:
                continue
        elif regex.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", s) and max(map(int, s.split("."))) > 255:
            continue
        around.append(text[at : m.start()])
        found.append(s)
        at = m.end()
    return [*around, text[at:]], found


def test_op9_on_every_document(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    key = pii.session_key(spark)
    assert key == pii.session_key(spark) and len(key) == 64
    rows = queries.op9_pii_surrogates(spark, SF).collect()
    plain = {i: plain_entities(t or "") for i, t in texts.items()}
    real = {e for _, found in plain.values() for e in found}
    made = {r["entity"]: r["surrogate"] for r in pii.surrogate_map(spark.createDataFrame([(e,) for e in real], "entity string"), key).collect()}
    assert set(made) == real and len(set(made.values())) == len(real) and not real & set(made.values())
    assert len(rows) == len(texts) and sum(r["n_replaced"] for r in rows) > 0
    for r in rows:
        around, found = plain[r["doc_id"]]
        want = around[0] + "".join(made[e] + rest for e, rest in zip(found, around[1:], strict=True))
        assert (r["text"] or "", r["n_replaced"]) == (want, len(found)), r["doc_id"]
