"""Probability algebra, decision rules and conformal sets over arrays of class probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions.labels import clip


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def monotone(cumulative: Sequence[Column]) -> list[Column]:
    """Running maximum over ordered thresholds, clipped to [0, 1]."""
    return [clip(F.greatest(*cumulative[: i + 1]) if i else cumulative[0]) for i in range(len(cumulative))]


def interval_probabilities(cumulative: Sequence[Column]) -> Column:
    """Bin probabilities from P(y < cut): adjacent differences, negatives to 0, normalised (a zero sum stays zero)."""
    edges = [F.lit(0.0), *cumulative, F.lit(1.0)]
    raw = F.array(*[F.greatest(b - a, F.lit(0.0)) for a, b in zip(edges, edges[1:], strict=False)])
    return normalised(raw)


def normalised(p: Column) -> Column:
    """Shares of the sum; a sum that is 1 up to rounding divides nothing, as it would shift what ties with a threshold."""
    total = _sum(p)
    return F.transform(p, lambda v: F.when(F.abs(total - 1) <= 1e-12, v).when(total > 0, v / total).otherwise(0.0))


def merged_classes(bins: Column, groups: Sequence[Sequence[int]]) -> list[Column]:
    """Class probabilities as sums of 0-based bins."""
    return [sum((F.get(bins, F.lit(i)) for i in g[1:]), F.get(bins, F.lit(g[0]))) for g in groups]


def first_max(p: Column, labels: Sequence[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(p, F.array_max(p)).cast("int"))


def boundary_policy(p: Sequence[Column], labels: Sequence[str], warn: int, floor: float, margin: float) -> Column:
    """The warning class where its probability reaches ``floor`` and is within ``margin`` of the best, else the first max."""
    best = F.greatest(*p)
    return F.when((p[warn] >= floor) & (best - p[warn] <= margin), labels[warn]).otherwise(first_max(F.array(*p), labels))


def normalised_entropy(p: Column, eps: float = 1e-12) -> Column:
    entropy = -_sum(F.transform(p, lambda v: clip(v, eps, 1.0) * F.log(clip(v, eps, 1.0))))
    return F.try_divide(entropy, F.log(F.size(p)))


def reject_rule(p: Column, labels: Sequence[str], min_top: float, max_entropy: float) -> Column:
    return F.when((F.array_max(p) < min_top) | (normalised_entropy(p) > max_entropy), "retest").otherwise(first_max(p, labels))


def cascade(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """The first rule that holds decides."""
    out = F.lit(default)
    for condition, name in reversed(rules):
        out = F.when(condition, name).otherwise(out)
    return out


def low_risk_guardrail(fused: Column, a: Column, b: Column, tau_low: float, a_ceiling: float, b_ceiling: float) -> Column:
    """A fused risk below ``tau_low`` is lifted to it when a component is over its ceiling."""
    return F.when((fused < tau_low) & ((a > a_ceiling) | (b > b_ceiling)), tau_low).otherwise(fused)


def mid_rank(fused: Column, rank: Column, tau_low: float, tau_high: float) -> Column:
    """Inside [tau_low, tau_high) the order comes from a second score's rank in [0, 1]."""
    return F.when(fused.between(tau_low, tau_high) & (fused < tau_high), tau_low + (tau_high - tau_low - 1e-6) * rank).otherwise(fused)


def dynamic_route(share_now: Column, share_old: Column, drift: Column, hard_min: float, blend_min: float, old_max: float) -> tuple[Column, Column]:
    """(route, blend weight): local on enough current support, static on drift or old support, linear blend between."""
    weight = clip((share_now - blend_min) / (hard_min - blend_min))
    route = cascade([(drift | (share_old > old_max), "static"), (share_now >= hard_min, "local"), (share_now >= blend_min, "blend")], "static")
    return route, F.when(route == "local", 1.0).when(route == "blend", weight).otherwise(0.0)


def drift_label(score: Column, p90: Column, p95: Column, known_bad: Column) -> Column:
    return cascade([(known_bad, "quality_anomaly"), (score >= p95, "high"), (score >= p90, "medium")], "low")


def _ordered(p: Column) -> Column:
    """Classes as (probability, index), most probable first, the first index on ties."""
    return F.array_sort(F.transform(p, lambda v, i: F.struct((-v).alias("m"), i.alias("i"))))


def aps_score(p: Column, truth: Column) -> Column:
    """Probability mass down to and including the true class (0-based) in descending order."""
    order = _ordered(p)
    upto = F.array_position(F.transform(order, lambda o: o["i"]), truth).cast("int")
    return -_sum(F.transform(F.slice(order, 1, F.greatest(upto, F.lit(1))), lambda o: o["m"]))


def aps_set(p: Column, qhat: Column) -> Column:
    """Smallest leading classes whose mass reaches ``qhat`` (0-based, most probable first)."""
    order = _ordered(p)
    before = lambda k: -_sum(F.transform(F.slice(order, 1, k), lambda o: o["m"]))
    return F.transform(F.filter(F.transform(order, lambda o, k: F.struct(o["i"].alias("i"), before(k).alias("b"))), lambda x: x["b"] < qhat), lambda x: x["i"])


def ordered_interval(p: Sequence[Column], qhat: Column) -> Column:
    """Contiguous interval of classes grown from the mode to the larger neighbour (the lower on ties) until ``qhat``."""
    array, n = F.array(*p), len(p)
    mode = (F.array_position(array, F.array_max(array)) - 1).cast("int")
    state = F.struct(mode.alias("a"), mode.alias("b"), F.array_max(array).alias("m"))
    at = lambda i: F.when((i >= 0) & (i < n), F.get(array, i)).otherwise(F.lit(-1.0))

    def grow(s: Column, _: Column) -> Column:
        low, high = at(s["a"] - 1), at(s["b"] + 1)
        more = (s["m"] < qhat) & ((low >= 0) | (high >= 0))
        down = more & (low >= high)
        up = more & ~down
        return F.struct(
            (s["a"] - down.cast("int")).alias("a"),
            (s["b"] + up.cast("int")).alias("b"),
            F.when(down, s["m"] + low).when(up, s["m"] + high).otherwise(s["m"]).alias("m"),
        )

    done = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), state, grow)
    return F.sequence(done["a"], done["b"])


def class_set(p: Column, thresholds: Column) -> Column:
    """Classes with 1 - p <= their own threshold; an empty set becomes the first maximum."""
    own = F.filter(F.transform(p, lambda v, i: F.when(1 - v <= F.get(thresholds, i), i)), lambda i: i.isNotNull())
    return F.when(F.size(own) > 0, own).otherwise(F.array((F.array_position(p, F.array_max(p)) - 1).cast("int")))


def business_set(bins: Column, names: Sequence[str]) -> Column:
    """Distinct class names of a set of bins, in order."""
    return F.array_distinct(F.transform(F.array_sort(bins), lambda i: F.get(F.array(*map(F.lit, names)), i)))


def operational_decision(classes: Column, guard: bool = False) -> Column:
    """A single class decides; otherwise retest, or with ``guard`` warning for neighbours of warning."""
    many = F.when((F.size(classes) == 2) & F.array_contains(classes, "warning"), "warning").otherwise("retest") if guard else F.lit("retest")
    return F.when(F.size(classes) == 1, F.get(classes, F.lit(0))).otherwise(many)
