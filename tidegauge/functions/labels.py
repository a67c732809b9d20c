"""Label and target expressions (one projection each, no shuffle)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def spec_flags(y: Column, center: float, tolerance: float) -> dict[str, Column]:
    """Above, below, out of and in the band ``center`` +/- ``tolerance``, bounds inclusive."""
    low, high = center - tolerance, center + tolerance
    return {"is_above": y > high, "is_below": y < low, "is_out": (y > high) | (y < low), "is_in": y.between(low, high)}


def target_range(payload_spec: tuple | None, payload_range: tuple | None, config: tuple) -> tuple[float, float]:
    """(low, high): a payload's (center, tolerance), else its (low, high), else the configured (center, tolerance)."""
    if payload_spec:
        return payload_spec[0] - payload_spec[1], payload_spec[0] + payload_spec[1]
    return tuple(payload_range) if payload_range else (config[0] - config[1], config[0] + config[1])


def band_label(y: Column, cuts: Sequence[float], names: Sequence[str]) -> Column:
    """Left-closed bands between ascending ``cuts``; ``names`` has one more entry."""
    out = F.lit(names[-1])
    for cut, name in zip(reversed(cuts), reversed(names[:-1]), strict=True):
        out = F.when(y < cut, name).otherwise(out)
    return F.when(y.isNotNull(), out)


def cut_label(y: Column, edges: Sequence[float]) -> Column:
    """Index of the right-closed bin between ``edges``; the first bin is closed on both sides, outside is NULL."""
    out = F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(zip(edges, edges[1:], strict=False)))):
        inside = (y >= a) if i == 0 else (y > a)
        out = F.when(inside & (y <= b), i).otherwise(out)
    return out


def cumulative_targets(y: Column, cuts: Sequence[float]) -> dict[str, Column]:
    return {f"target_lt_{i}": (y < c).cast("int") for i, c in enumerate(cuts)}


def boundary_flag(y: Column, cuts: Sequence[float], width: float) -> Column:
    """Whether a value lies within ``width`` of any cut."""
    return F.exists(F.array(*map(F.lit, cuts)), lambda c: F.abs(y - c) <= width)


def desirability(y: Column, center: float, tolerance: float) -> Column:
    return clip(1 - F.abs(y - center) / tolerance)


def _offsets(half_width: float, points: int) -> Column:
    step = 2 * half_width / (points - 1)
    return F.array(*[F.lit(-half_width + i * step) for i in range(points)])


def _sums(y: Column, half_width: float, points: int, score) -> Column:
    """Sum and sum of squares of a score over the error grid, in one pass over the grid."""
    values = F.transform(_offsets(half_width, points), lambda o: score(y + o))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"))
    return F.aggregate(values, start, lambda a, v: F.struct((a["s"] + v).alias("s"), (a["ss"] + v * v).alias("ss")))


def desirability_uncertain(y: Column, center: float, tolerance: float, half_width: float, points: int = 21) -> Column:
    """Mean desirability over an even grid of measurement errors."""
    return _sums(y, half_width, points, lambda v: desirability(v, center, tolerance))["s"] / points


def bell(y: Column, center: float, width: float, power: float) -> Column:
    return 1 / (1 + F.pow(F.abs(y - center) / width, F.lit(float(power))))


def bell_uncertain(y: Column, center: float, width: float, power: float, half_width: float, points: int = 21) -> tuple[Column, Column]:
    """Mean and population standard deviation of the bell score over the error grid."""
    sums = _sums(y, half_width, points, lambda v: bell(v, center, width, power))
    mean = sums["s"] / points
    return mean, F.sqrt(F.greatest(sums["ss"] / points - mean * mean, F.lit(0.0)))


def gaussian(y: Column, center: float, sigma: float) -> Column:
    return F.exp(-F.pow(y - center, F.lit(2.0)) / (2 * sigma * sigma))


def interval_pass(y: Column, low: float, high: float, half_width: float) -> Column:
    """Share of [y - e, y + e] inside [low, high]."""
    return F.greatest(F.lit(0.0), F.least(y + half_width, F.lit(high)) - F.greatest(y - half_width, F.lit(low))) / (2 * half_width)


def soft_membership(y: Column, center: float, tolerance: float, softness: float, rule: str) -> Column:
    """In-band membership of the signed margin ``tolerance - |y - center|``."""
    margin = F.lit(tolerance) - F.abs(y - center)
    unit = clip((margin / softness + 1) / 2)
    rules = {
        "logistic": 1 / (1 + F.exp(-margin / softness)),
        "tanh": (F.tanh(margin / softness) + 1) / 2,
        "linear": unit,
        "smoothstep": unit * unit * (3 - 2 * unit),
    }
    return rules[rule]


def soft_bins(y: Column, cuts: Sequence[float], half_width: float) -> Column:
    """Mass of each of ``len(cuts) + 1`` bins: linear between neighbours within ``half_width`` of a cut, else all in one."""
    above = [clip((y - c) / (2 * half_width) + 0.5) for c in cuts]
    return F.array(1 - above[0], *[a - b for a, b in zip(above, above[1:], strict=False)], above[-1])


def repeat_weight(spread: Column, tolerance: float, floor: float = 0.0) -> Column:
    """Consistency weight exp(-(sd / tol)^2) of repeated measurements; a missing spread weighs 1."""
    return F.greatest(F.lit(floor), F.exp(-F.pow(F.coalesce(spread, F.lit(0.0)) / tolerance, F.lit(2.0))))


def closeness_weight(y: Column, cuts: Sequence[float], radius: float, gain: float) -> Column:
    """1 + gain x triangular closeness to the nearest cut."""
    near = F.array_min(F.array(*[F.abs(y - c) for c in cuts]))
    return 1 + gain * clip(1 - near / radius)


def boundary_weight(y: Column, cuts: Sequence[float], width: float, factor: float, warn: Column | None = None, warn_factor: float = 1.0) -> Column:
    """``factor`` inside the boundary band, times ``warn_factor`` where ``warn``."""
    out = F.when(boundary_flag(y, cuts, width), factor).otherwise(1.0)
    return out if warn is None else out * F.when(warn, warn_factor).otherwise(1.0)


def status(y: Column, low: float, high: float) -> Column:
    return F.when(y < low, "below").when(y > high, "above").when(y.isNotNull(), "in")


def label_by_method(method: str, y: Column, center: float, tolerance: float, param: float, points: int = 21) -> Column:
    """Dispatch over the point, uncertain, Gaussian, bell and soft labels."""
    methods = {
        "point": lambda: desirability(y, center, tolerance),
        "uncertain": lambda: desirability_uncertain(y, center, tolerance, param, points),
        "gaussian": lambda: gaussian(y, center, param),
        "bell": lambda: bell(y, center, tolerance, param),
        "pass": lambda: interval_pass(y, center - tolerance, center + tolerance, param),
        **{r: lambda r=r: soft_membership(y, center, tolerance, param, r) for r in ("logistic", "tanh", "linear", "smoothstep")},
    }
    return methods[method]()


def noise_aware(y: Column, spread: Column, center: float, tolerance: float, half_width: float, boundary: float, factor: float, out_factor: float, limits: tuple[float, float] = (0.1, 5.0)) -> dict[str, Column]:
    """All labels of a measured value in one projection: desirability (point, low and high error, uncertain), pass score, distance to
    the nearer bound, band flags, and the clipped product weight."""
    low, high = center - tolerance, center + tolerance
    distance = F.least(F.abs(y - low), F.abs(y - high))
    weight = repeat_weight(spread, tolerance) * F.when(distance <= boundary, factor).otherwise(1.0) * F.when((y < low) | (y > high), out_factor).otherwise(1.0)
    return {
        "point": desirability(y, center, tolerance),
        "point_low": desirability(y - half_width, center, tolerance),
        "point_high": desirability(y + half_width, center, tolerance),
        "uncertain": desirability_uncertain(y, center, tolerance, half_width),
        "pass_score": interval_pass(y, low, high, half_width),
        "distance": distance,
        "is_boundary": distance <= boundary,
        "is_out": (y < low) | (y > high),
        "weight": clip(weight, *limits),
    }
