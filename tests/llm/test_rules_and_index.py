"""Path rules of one host and of nested hosts, and the licence index, against plain versions."""

import random

from pyspark.sql import functions as F

from tidegauge.llm import license_scan, url_rules


def plain_verdict(host, path, rules):
    fits = [
        (-len(h) - len(p), -len(h), h + p, v)
        for v, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return min(fits)[2:] if fits else (None, "allow")


def test_nested_hosts_and_paths(spark):
    draw = random.Random(11)
    hosts = ["org", "a.org", "b.a.org", "c.b.a.org", "ab.org", "com", "a.com", "é.com"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/é/", "/b/c/d"]
    rules = [(draw.choice(["allow", "block"]), draw.choice(hosts), draw.choice(paths)) for _ in range(40)]
    rules += [("block", "a.org", f"/x/{i}") for i in range(300)]
    urls = ["x://" + draw.choice(["", "w.", "x.y."]) + draw.choice([*hosts, "net", ""]) + draw.choice(paths) + draw.choice(["", "z", "?q", "/é"]) for _ in range(400)]
    urls += [f"x://w.a.org/x/{i}" for i in range(0, 400, 7)] + ["x://a.org/" + "a/b" * 5000, None, "none"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").select(
        "*", *[F.lit("c").alias(c) for c in ("bucket", "key", "kind", "stack", "top", "chain", "hosts", "best")]
    )
    table = spark.createDataFrame(rules, "verdict string, host string, path string").select("*", F.lit(1).alias("at"))
    got = url_rules.judge_urls(pages, table).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["rule"], r["verdict"]) == plain_verdict(r["host"], r["path"], rules), r
    assert {r["verdict"] for r in url_rules.judge_urls(pages, table.limit(0), "block").collect()} == {"block"}


def test_index_does_not_decide_what_is_found(spark):
    whole = {label: text for label, text, _ in license_scan.TEMPLATES}
    rows = [(label, f"Notes.\n * {text.upper()}. End") for label, text in whole.items()]
    rows += [("cut", " ".join(whole["mit-text"].split()[3:])), ("head", " ".join(whole["mit-text"].split()[:20]) + " else"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    held = license_scan.document_counts(docs)
    assert held["mit"] == 1 and held["license"] == sum("license" in t.split() for t in whole.values())
    opposite = {w: 1000 - n for w, n in held.items()}
    assert license_scan.build_index(held) != license_scan.build_index(opposite)
    both = [
        sorted(license_scan.license_scan(docs, license_scan.build_index(h)).collect(), key=repr) for h in (held, opposite)
    ]
    assert both[0] == both[1]
    got = {r["doc_id"]: (r["labels"].split(","), r["score"]) for r in both[0]}
    assert all(label in got[label][0] and got[label][1] == 1.0 for label in whole)
    assert got["cut"] == ([""], 0.0) and got["head"][0] == ["mit-text"] and 0 < got["head"][1] < 0.2
    assert got[None] == ([""], 0.0)
    assert license_scan.document_counts(docs.limit(0)) == {}
