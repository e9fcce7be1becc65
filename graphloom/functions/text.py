"""Column functions for labels, sizes and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def shortened(text: Column, size: int) -> Column:
    """The first characters, with an ellipsis if there are more."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


def byte_size(n: Column) -> Column:
    """A byte count as text: B, KB, MB, GB by 1024, one decimal from KB on."""
    unit = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    value = F.round(n / F.pow(F.lit(1024.0), unit), 1)
    return F.when(unit == 0, F.concat(n.cast("string"), F.lit(" B"))).otherwise(
        F.concat(F.format_number(value, 1), F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), unit + 1))
    )


def time_ago(ms: Column, as_of: int) -> Column:
    """How long ago, in the largest whole unit of minutes, hours or days."""
    m = F.floor((F.lit(as_of) - ms) / 60_000)
    return (
        F.when(m < 1, "just now").when(m < 60, F.concat(m.cast("string"), F.lit("m ago")))
        .when(m < 1440, F.concat(F.floor(m / 60).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(m / 1440).cast("string"), F.lit("d ago")))
    )


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")
