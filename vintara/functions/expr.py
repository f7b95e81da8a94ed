"""Column expressions: built-in functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from vintara.functions import fixed


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(x: Column | str) -> Column:
    """NaN and infinities become NULL, the only missing value of the engine."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def lookup(mapping: Mapping[str, str], key: Column | str) -> Column:
    pairs = [F.lit(v) for item in mapping.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), col(key))


def recode(code: Column | str, mapping: Mapping[str, str] = fixed.CODE_RECODES) -> Column:
    """B2: replace the codes of a constant map, keep the others."""
    return F.coalesce(lookup(mapping, code), col(code))


def cagr(start: Column | str, end: Column | str, periods: Column | int) -> Column:
    """Compound growth in % a period; NULL unless both levels and the span are positive."""
    start, end = col(start), col(end)
    n = F.lit(periods) if isinstance(periods, int) else periods
    return F.when((start > 0) & (end > 0) & (n > 0), (F.pow(end / start, F.lit(1.0) / n) - 1) * 100)


def per_capita(level: Column | str, population: Column | str) -> Column:
    """Level over population times 1000, for a positive population."""
    pop = col(population)
    return F.try_divide(col(level), F.when(pop > 0, pop)) * 1000


def source_gap_pct(level: Column | str, other: Column | str, is_forecast: Column | str) -> Column:
    """Distance of the second source in %, on observed rows only."""
    return F.when(~col(is_forecast), F.try_divide(col(other) - col(level), col(level)) * 100)


def edition_order(period: Column | str, season: Column | str) -> Column:
    """Chronological rank of an edition (spring S, then autumn F)."""
    return col(period) * 2 + (col(season) == "F").cast("int")


def step_label(horizon: Column | str, season: Column | str) -> Column:
    """Name of the revising edition's step."""
    name = F.when(col(season) == "S", "spring").otherwise("autumn")
    return F.when(col(horizon) < 0, F.concat(name, F.lit(", re-estimate"))).otherwise(
        F.concat(name, F.lit(", horizon "), col(horizon).cast("string"))
    )


def editions_around(period: int) -> list[str]:
    """Spring and autumn editions of the period before a shock, its own and the next."""
    return [f"{s}{p}" for p in (period - 1, period, period + 1) for s in "SF"]


def size_class(population: Column | str, threshold: float = fixed.SIZE_THRESHOLD) -> Column:
    """Large when strictly above the threshold."""
    return F.when(col(population) > threshold, "large").otherwise("small")


def interval_score(low: Column | str, high: Column | str, y: Column | str, alpha: float = 0.2) -> Column:
    """Width plus 2/alpha times whatever falls outside."""
    low, high, y = col(low), col(high), col(y)
    known = low.isNotNull() & high.isNotNull() & y.isNotNull()
    zero = F.lit(0.0)
    return F.when(
        known,
        (high - low) + 2 / alpha * F.greatest(low - y, zero) + 2 / alpha * F.greatest(y - high, zero),
    )


def covered(low: Column | str, high: Column | str, y: Column | str) -> Column:
    """1.0 inside the band, 0.0 outside, NULL without a band."""
    return col(y).between(col(low), col(high)).cast("double")


def brier(probability: Column | str, outcome: Column | str) -> Column:
    """Squared distance of a probability to the 0/1 outcome."""
    return F.pow(col(probability) - col(outcome), 2)


def inverted_bound(error_pct: Column | str) -> Column:
    """Relative bound of the outcome, in %, implied by a past error projected/realised - 1."""
    return (F.try_divide(F.lit(1.0), 1 + col(error_pct) / 100) - 1) * 100


def calibrated_ratio(ratio: Column | str, multiplier: Column | str) -> Column:
    """Log distance to the median times the multiplier."""
    return F.exp(col(multiplier) * F.ln(col(ratio)))


def log_ratio(growth_pct: Column | str) -> Column:
    """Logarithm of 1 + growth; NULL at or below -100 %."""
    return F.log1p(col(growth_pct) / 100)


def digitize(x: Column | str, edges: Column) -> Column:
    """Left-closed class 1 + #{edge <= x}; NULL for a NULL value.

    An edge often is one of the values: compared to nine decimals, so that the last bit of
    a value chained another way does not move it to the class below.
    """
    x = F.round(col(x), 9)
    return F.when(x.isNotNull(), F.size(F.filter(edges, lambda e: F.round(e, 9) <= x)) + 1)


def right_closed_bin(x: Column | str, edges: Sequence[float] | Column) -> Column:
    """Right-closed bins (a, b], the lowest edge included: index from 0."""
    x = col(x)
    array = edges if isinstance(edges, Column) else F.array(*[F.lit(float(e)) for e in edges])
    return F.greatest(F.size(F.filter(array, lambda e: e < x)) - 1, F.lit(0))


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """F5 as an aggregate: rows with a value and a positive weight, NULL if there is none."""
    value, weight = col(value), col(weight)
    keep = value.isNotNull() & (weight > 0)
    return F.try_divide(F.sum(F.when(keep, value * weight)), F.sum(F.when(keep, weight)))


def share_pct(predicate: Column) -> Column:
    """Share of rows (in %) for which a predicate is true; NULL predicates are left out."""
    return F.avg(predicate.cast("double")) * 100


def aggregate_code(code: Column | str) -> Column:
    """Aggregates are published under G followed by a digit."""
    return col(code).rlike(r"^G\d")


def known_text(value: Column | str) -> Column:
    """Trimmed text, NULL for the marker that says nothing."""
    return F.nullif(F.trim(col(value)), F.lit("Not applicable"))


def inverse_normal(p: Column | str) -> Column:
    """Quantile of the standard normal distribution; NULL outside the open interval from 0 to 1."""
    p = col(p)

    def ratio(part: int, r: Column) -> Column:
        above, below = fixed.INVERSE_NORMAL[part]
        value = [F.lit(above[0]), F.lit(below[0])]
        for a, b in zip(above[1:], below[1:]):
            value = [value[0] * r + a, value[1] * r + b]
        return value[0] / value[1]

    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.when(r <= 5, ratio(1, r - 1.6)).otherwise(ratio(2, r - 5)) * F.signum(q)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * ratio(0, F.lit(0.180625) - q * q)).otherwise(tail))
