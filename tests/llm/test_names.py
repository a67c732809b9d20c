"""Names behind titles are replaced whole, never in part."""

import re

from tidegauge.llm import pii

NAMES = ["Mr. McDonald", "Mrs. Jean-Luc Picard", "Mr. O'Brien", "Mr. D’Angelo", "Mr. SMITH", "Dr. John Smith", "Prof. Müller-Lüdenscheidt", "г-н Иванов-Петров", "Mrs. Anna Schmidt"]


def test_whole_names(spark):
    rows = [(i, f"then {m} write to them") for i, m in enumerate(NAMES)] + [(99, "Mr. smith and the Dr. stay")]
    got = {r["doc_id"]: r["text"] for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert got[99] == rows[-1][1]
    for i, mention in enumerate(NAMES):
        title, *names = mention.split(" ")
        made = re.fullmatch(rf"then {re.escape(title)} (.+) write to them", got[i])[1].split(" ")
        assert len(made) == len(names)
        for old, new in zip(names, made, strict=True):
            assert re.fullmatch(r"\w+", new) and not any(part in new for part in re.split("['’-]", old) if len(part) > 2)
