"""String and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_name(name: Column) -> Column:
    """Lower case, ``&`` as ``and``, runs of other characters than letters and digits as one space, ends trimmed."""
    spoken = F.replace(F.lower(F.trim(name)), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(spoken, "[^a-z0-9]+", " "))


def slug_uid(prefix: str, name: Column) -> Column:
    """``prefix_`` and the normalized name with underscores."""
    return F.concat(F.lit(prefix + "_"), F.replace(normalized_name(name), F.lit(" "), F.lit("_")))


def short_club_name(name: Column) -> Column:
    """The normalized name without a closing ``town`` or ``city``."""
    return F.regexp_replace(normalized_name(name), " (town|city)$", "")


def composite_key(*parts: Column, separator: str = ":") -> Column:
    """The parts as text, joined; null if any part is null."""
    return F.concat(*[p for i, part in enumerate(parts) for p in ((F.lit(separator), part.cast("string")) if i else (part.cast("string"),))])


def fold_label(season: Column, block: Column) -> Column:
    """``season_gwNN`` with the block number padded to two digits."""
    return F.concat(season, F.lit("_gw"), F.lpad(block.cast("string"), 2, "0"))


def split_ids(text: Column) -> Column:
    """Comma-joined ids as an array; blanks around ids and empty ids go."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def contains_text(query: str, *columns: Column) -> Column:
    """Case-insensitive substring search over the columns read as one text; an empty query matches all."""
    needle = query.strip().lower()
    return F.lit(True) if not needle else F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(needle))


def stable_seed(*parts: Column) -> Column:
    """The first eight bytes of SHA-256 over the parts (unit-separated), as an unsigned decimal(20)."""
    digest = F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def without_local_paths(text: Column) -> Column:
    """Absolute user paths replaced, so that published text names no machine."""
    return F.regexp_replace(text, r"(/Users/|/home/|[A-Za-z]:\\Users\\)\S*", "[path]")


def number_or_null(value: Column, kind: str = "double") -> Column:
    """The value as a number; null where it is no number (as text may be). NaN counts as no number."""
    found = value.try_cast(kind)
    return F.when(~F.isnan(found), found) if kind == "double" else found


def number(value: Column, otherwise: float = 0.0) -> Column:
    """The value as a number; ``otherwise`` where it is none."""
    return F.coalesce(number_or_null(value), F.lit(otherwise))
