"""Time and season expressions. Times are UTC; a result counts only strictly before its use."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours after kickoff at which a result without an exact completion time counts as available.
AVAILABILITY_HOURS = 3


def parsed(text: Column) -> Column:
    """Timestamp of a text; null where it can't be read."""
    return F.try_to_timestamp(text)


def available_time(kickoff: Column, completed: Column | None = None, hours: int = AVAILABILITY_HOURS) -> Column:
    """When a result may first be used: its completion time if known, else ``hours`` after kickoff."""
    later = kickoff + F.expr(f"INTERVAL {hours} HOURS")
    return later if completed is None else F.coalesce(completed, later)


def season_label(start_year: Column) -> Column:
    """``2024`` to ``2024-25``."""
    return F.concat(start_year.cast("string"), F.lit("-"), F.lpad(((start_year + 1) % 100).cast("string"), 2, "0"))


def season_start(label: Column) -> Column:
    """The start year of a label; an error where it is malformed."""
    text = label.cast("string")
    good = F.regexp_like(text, F.lit(r"^\d{4}-\d{2}$")) & (F.try_to_number(F.substring(text, 6, 2), F.lit("99")) == (F.try_to_number(F.substring(text, 1, 4), F.lit("9999")) + 1) % 100)
    return F.when(good, F.substring(text, 1, 4).cast("long")).otherwise(F.raise_error(F.concat(F.lit("malformed season: "), F.coalesce(text, F.lit("null")))).cast("long"))


def season_of(moment: Column, first_month: int = 6) -> Column:
    """The label of the season that a moment belongs to; seasons begin in June."""
    return season_label(F.year(moment) - F.when(F.month(moment) < first_month, 1).otherwise(0))


def parse_seasons(text: str) -> list[str]:
    """Labels of a comma-joined list, checked and in order."""
    labels = [s.strip() for s in text.split(",") if s.strip()]
    for label in labels:
        found = re.fullmatch(r"(\d{4})-(\d{2})", label)
        if not found or (int(found[1]) + 1) % 100 != int(found[2]):
            raise ValueError(f"malformed season: {label}")
    if not labels:
        raise ValueError("no season given")
    return labels


def age_days(moment: Column, since: Column) -> Column:
    """Days from ``since`` to ``moment`` as a fraction."""
    micros = [F.unix_micros(c.cast("timestamp")) for c in (moment, since)]
    return (micros[0] - micros[1]) / F.lit(86400e6)


def recency_weight(moment: Column, cutoff: Column, half_life_days: float) -> Column:
    """Halves with every half-life of age; 1 for what is not older than the cutoff."""
    return F.pow(F.lit(0.5), F.greatest(age_days(cutoff, moment), F.lit(0.0)) / half_life_days)


def latest_in_map(times: Column) -> Column:
    """The latest readable moment among a map's values; null where there is none."""
    return F.array_max(F.transform(F.map_values(times), lambda t: F.try_to_timestamp(t)))
