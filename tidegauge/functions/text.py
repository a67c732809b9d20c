"""Header matching, numeric coercion and small text parsers."""

from __future__ import annotations

import math
import re
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_header(name: str) -> str:
    return re.sub(r"[\s_\-./()\[\]]+", "", name.replace(" ", " ")).lower()


def match_headers(columns: list[str], rules: dict[str, list[str]]) -> dict[str, str]:
    """Actual column for each canonical name: equal after normalisation, else the first that holds a rule's text."""
    out: dict[str, str] = {}
    for canonical, needles in rules.items():
        wanted = [normal_header(n) for n in [canonical, *needles]]
        free = [c for c in columns if c not in out.values()]
        exact = [c for c in free if normal_header(c) in wanted]
        within = [c for c in free if any(w in normal_header(c) for w in wanted)]
        if found := exact or within:
            out[canonical] = found[0]
    return out


def numeric(text: Column) -> Column:
    """DOUBLE from text with blanks, thousands commas or comparison signs; NULL where it is no number, or NaN."""
    value = F.regexp_replace(text.cast("string"), r"[\s ,<>]", "").try_cast("double")
    return F.when(~F.isnan(value), value)


def tag_root(name: str) -> str:
    """A sensor tag without its suffix: upper case, punctuation removed."""
    return re.sub(r"[^A-Z0-9]", "", re.sub(r"(?i)[._](pv|sp|op)$", "", name.strip()).upper())


def feature_parts(name: str) -> dict[str, str | None]:
    """Sensor, statistic, lag and window out of a feature's name ``[w{W}_lag{L}__]sensor__stat``."""
    m = re.match(r"^(?:w(?P<window>\d+)_)?(?:lag(?P<lag>\d+)__)?(?P<sensor>.+?)__(?P<stat>[^_]+(?:_[^_]+)*)$", name)
    return m.groupdict() if m else {"window": None, "lag": None, "sensor": name, "stat": None}


def parse_numbers(text: str) -> list[int]:
    return [int(x) for x in re.split(r"[,;\s]+", text.strip()) if x]


def parse_weights(text: str) -> list[dict[int, float]]:
    """``"15:0.5,60:0.5;30:1"``: groups of window weights, each normalised to sum 1."""
    groups = []
    for part in filter(None, text.split(";")):
        group = {int(k): float(v) for k, v in (x.split(":") for x in part.split(","))}
        groups.append({k: v / sum(group.values()) for k, v in group.items()})
    return groups


def json_ready(value):
    """Plain JSON types: no NaN or infinity, ISO timestamps, lists for arrays."""
    if isinstance(value, dict):
        return {str(k): json_ready(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [json_ready(v) for v in value]
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value.isoformat() if isinstance(value, (date, datetime)) else value
