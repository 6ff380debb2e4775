"""Decay weights, the blended score, rounding."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from keystride.params import ALPHA, HALF_LIFE_SECONDS

# Scores are compared by their logarithm, which keeps their order however old they are, and blended
# as shares of the highest one. Both are rounded before they are ranked, so that the order in which
# partial sums were added cannot swap two equal scores.
RANK_DIGITS = 12
LEVEL_DIGITS = 8


def micros_of(moment: dt.datetime | str) -> int:
    """Microseconds since the epoch of a UTC moment."""
    if isinstance(moment, str):
        moment = dt.datetime.fromisoformat(moment)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=dt.timezone.utc)
    return (moment - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


def as_micros(moment: Column | dt.datetime | str) -> Column:
    """Microseconds since the epoch of a timestamp column or of a UTC moment."""
    if isinstance(moment, Column):
        return F.unix_micros(moment)
    return F.lit(micros_of(moment)).cast("bigint")


def decay(age_seconds: Column, half_life: float = HALF_LIFE_SECONDS) -> Column:
    """Weight of an event of that age: 1 when new, a half after each half-life."""
    tau = half_life / math.log(2.0)
    return F.exp(-age_seconds / F.lit(tau))


def age_seconds(at_micros: Column, as_of_micros: Column) -> Column:
    return (as_of_micros - at_micros) / F.lit(1e6)


def settled(score: Column) -> Column:
    return F.round(score, RANK_DIGITS)


def settled_level(level: Column) -> Column:
    return F.round(level, LEVEL_DIGITS)


def share_of(level: Column, top_level: Column) -> Column:
    """Score over the highest score, from their binary logarithms; 0 where there is no score."""
    return F.coalesce(F.round(F.pow(F.lit(2.0), level - top_level), RANK_DIGITS), F.lit(0.0))


def blend(count: Column, max_count: Column, score: Column, max_score: Column,
          alpha: float = ALPHA) -> Column:
    """alpha * count / max_count + (1 - alpha) * score / max_score, with safe denominators."""
    top_count = F.greatest(F.lit(1).cast("bigint"), max_count)
    top_score = F.when(max_score == 0, F.lit(1.0)).otherwise(max_score)
    popularity = count.cast("double") / top_count.cast("double")
    return F.lit(alpha) * popularity + F.lit(1.0 - alpha) * (score / top_score)


def half_up(value: Column, digits: int = 4) -> Column:
    """Round to ``digits`` places, ties upwards (towards plus infinity)."""
    unit = float(10 ** digits)
    return F.floor(value * F.lit(unit) + F.lit(0.5)).cast("double") / F.lit(unit)
