"""Amount and date bands: the two tests, and the buckets that turn them into equi-joins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ReconConfig

# amounts past this bucket number share one bucket, which keeps bucket arithmetic in range; a step between
# doubles is more than half a tolerance there, for fine buckets
_EDGE = 9.1e15


def within_amount(a: Column, b: Column, cfg: ReconConfig) -> Column:
    return F.abs(a - b) <= F.lit(cfg.amount_tolerance)


def within_window(a: Column, b: Column, cfg: ReconConfig) -> Column:
    return F.abs(F.datediff(a, b)) <= F.lit(cfg.date_window_days)


def is_stale(day: Column, as_of: datetime, cfg: ReconConfig) -> Column:
    return F.datediff(F.lit(as_of.date()), day) > F.lit(cfg.stale_days)


def whole_days(later: Column, earlier: Column) -> Column:
    """Full days between two zone-free timestamps, whatever the session's time zone."""
    return F.extract(F.lit("DAY"), later.cast("timestamp_ntz") - earlier.cast("timestamp_ntz"))


def finite(amount: Column) -> Column:
    return amount.isNotNull() & ~F.isnan(amount) & (F.abs(amount) != F.lit(float("inf")))


def matchable(amount: Column, day: Column) -> Column:
    return finite(amount) & day.isNotNull()


def _amount_width(cfg: ReconConfig) -> float:
    return 2.0 * cfg.amount_tolerance if cfg.amount_tolerance > 0 else 0.01


def _slot(value: Column, width: float) -> Column:
    bounded = F.greatest(F.least(value / F.lit(width), F.lit(_EDGE)), F.lit(-_EDGE))
    return F.floor(bounded).cast("bigint")


def _slack(amount: Column) -> Column:
    # covers the rounding of the division and of the two sums below
    return F.abs(amount) * F.lit(1e-15)


def amount_bucket(amount: Column, cfg: ReconConfig) -> Column:
    return _slot(amount, _amount_width(cfg))


def amount_buckets(amount: Column, cfg: ReconConfig) -> Column:
    """All buckets that can hold an amount within tolerance of this one (two, mostly)."""
    reach, width = F.lit(cfg.amount_tolerance) + _slack(amount), _amount_width(cfg)
    return F.sequence(_slot(amount - reach, width), _slot(amount + reach, width))


def _fine_width(cfg: ReconConfig) -> float:
    return cfg.amount_tolerance / 2.0 if cfg.amount_tolerance > 0 else 0.01


def _past_edge(amount: Column, cfg: ReconConfig) -> Column:
    return F.abs(amount) / F.lit(_fine_width(cfg)) >= F.lit(_EDGE)


def fine_bucket(amount: Column, cfg: ReconConfig) -> Column:
    """A bucket of half the tolerance, so whatever shares it is within tolerance.

    Past the edge, and without a tolerance, the amount itself is the bucket.
    """
    exact = F.lit(True) if cfg.amount_tolerance <= 0 else _past_edge(amount, cfg)
    slot = F.when(~exact, _slot(amount, _fine_width(cfg)))
    return F.struct(F.coalesce(slot, F.lit(0)).alias("slot"), F.when(exact, amount).otherwise(0.0).alias("exact"))


def fine_buckets(amount: Column, cfg: ReconConfig) -> Column:
    """All fine buckets that can hold an amount within tolerance; null for a null amount."""
    if cfg.amount_tolerance <= 0:
        return F.array(fine_bucket(amount, cfg))
    reach, width = F.lit(cfg.amount_tolerance) + _slack(amount), _fine_width(cfg)
    slots = F.sequence(_slot(amount - reach, width), _slot(amount + reach, width))
    near = F.transform(slots, lambda s: F.struct(s.alias("slot"), F.lit(0.0).alias("exact")))
    # past the edge these are all the doubles within tolerance
    steps = [amount + F.lit(cfg.amount_tolerance * k / 2) for k in (-2, -1, 0, 1, 2)]
    far = F.array(*[F.struct(F.lit(0).cast("bigint").alias("slot"), s.alias("exact")) for s in steps])
    inside, outside = ~_past_edge(F.abs(amount) - reach, cfg) | (F.abs(amount) < reach), _past_edge(F.abs(amount) + reach, cfg)
    return F.when(inside & ~outside, near).when(outside & ~inside, F.array_distinct(far)).otherwise(F.concat(near, F.array_distinct(far)))


def _day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def date_bucket(day: Column, cfg: ReconConfig) -> Column:
    width = max(2 * cfg.date_window_days, 1)
    return F.floor(_day_number(day) / F.lit(width)).cast("int")


def date_buckets(day: Column, cfg: ReconConfig) -> Column:
    width, reach = max(2 * cfg.date_window_days, 1), cfg.date_window_days
    low = F.floor((_day_number(day) - reach) / F.lit(width)).cast("int")
    high = F.floor((_day_number(day) + reach) / F.lit(width)).cast("int")
    return F.sequence(low, high)
