"""The hosts' verdicts on soft failures, and op6 against its SQL."""

import duckdb
import pytest

from tidegauge.llm import oracle, quality, queries

SF = "/root/testdata/sf0.001"
PROSE = " ".join(f"w{i}" for i in range(100))


def with_symbols(n):
    return PROSE + " " + "#" * n


def test_soft_failures_fall_by_degree_and_host(spark):
    """Mixed hosts far under MAX_HOST_RATE: gross failures fall everywhere, lesser ones by the host's rate."""
    rows = []
    for host, bad in (("good", 2), ("poor", 70)):
        rows += [(len(rows) + i, with_symbols(90) if i < bad else PROSE, host) for i in range(200)]
        rows += [(len(rows) + 1000, with_symbols(45), host), (len(rows) + 2000, with_symbols(32), host)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    judged = {r["doc_id"]: r["quality"] for r in quality.assess_documents(docs).collect()}
    assert max(q["rate"] for q in judged.values()) < quality.MAX_HOST_RATE
    fell = {(host, text.count("#")) for i, text, host in rows if not judged[i]["kept"]}
    assert fell == {("good", 90), ("poor", 90), ("poor", 45)}
    assert {r["doc_id"] for r in quality.quality_filter(docs).collect()} == {i for i, _, _ in rows if judged[i]["kept"]}


@pytest.mark.parametrize("bad", [0, 20])
def test_one_host_and_no_failure(spark, bad):
    rows = [(i, with_symbols(90) if i < bad else PROSE, None) for i in range(20)]
    judged = quality.assess_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sum(not r["quality"]["kept"] for r in judged) == bad


def test_verdict_on_the_smallest_table(spark):
    judged = [r["quality"] for r in quality.assess_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()]
    assert all(q["kept"] for q in judged if not q["base_failed"] and not q["soft_failed"])
    assert not any(q["kept"] for q in judged if q["n_symbols"] > 0.6 * q["n_words"])


def test_op6_matches_its_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.op6_quality_rules(spark, SF)
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle.QUALITY_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
