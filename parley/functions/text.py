"""Scalar expressions over text, JSON and time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Role names and what they stand for; other names stay as they are.
ROLES = {"user": "user", "human": "user", "customer": "user", "assistant": "assistant", "ai": "assistant", "model": "assistant", "bot": "assistant", "system": "system"}
EPOCH = "1970-01-01T00:00:00Z"


def strip(c: Column) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def role_of(c: Column) -> Column:
    """A role name in its standard form; null if there is none."""
    name = F.lower(strip(c))
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.when(name != "", F.coalesce(known[name], name))


def epoch_of(number: Column) -> Column:
    """A timestamp from a number of seconds, or of milliseconds from 1e12 on."""
    return F.timestamp_millis(F.when(number >= F.lit(1e12), number).otherwise(number * 1000).cast("long"))


def time_of(c: Column) -> tuple[Column, Column]:
    """(timestamp, missing) of an ISO string or a number as text; what can't be read is the epoch and missing."""
    number = c.try_cast("double")
    found = F.when(number.isNotNull(), epoch_of(number)).otherwise(c.try_cast("timestamp"))
    return F.coalesce(found, F.to_timestamp(F.lit(EPOCH))), found.isNull()


def synthetic_id(line: Column) -> Column:
    return F.concat(F.lit("synth-"), F.substring(F.sha2(strip(line), 256), 1, 16))


def preview(c: Column, width: int = 120) -> Column:
    """At most ``width`` characters, the last three dots if it was cut."""
    return F.when(F.length(c) <= width, c).otherwise(F.concat(F.substring(c, 1, width - 3), F.lit("...")))


def slug(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(strip(c), r"\s+", "_"), "[^A-Za-z0-9._-]", ""), 1, 64)


def share(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def percent(done: Column, total: Column) -> Column:
    """A percentage between 0 and 100 with one decimal, halves up."""
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * share(done, total))), 1)


def duration(seconds: Column) -> Column:
    """mm:ss, or h:mm:ss from an hour on."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("int")
    short = F.format_string("%02d:%02d", (s / 60).cast("int"), s % 60)
    return F.when(s < 3600, short).otherwise(F.format_string("%d:%02d:%02d", (s / 3600).cast("int"), (s % 3600 / 60).cast("int"), s % 60))


def matches(query: str, *columns: Column) -> Column:
    """Whether the query stands in the columns, joined by blanks, whatever the case."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower()))


def clamped(c: Column, low: float, high: float, default: float) -> Column:
    """A number from text, between ``low`` and ``high``; ``default`` if there is none or it is not finite."""
    number = c.try_cast("double")
    sound = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    return F.when(sound, F.greatest(F.lit(low), F.least(F.lit(high), number))).otherwise(F.lit(default))


def ago(seconds: Column) -> Column:
    """Seconds, minutes, hours or days since: ``5s ago``, ``3m ago``, ``2h ago``, ``4d ago``."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    steps = [(60, 1, "s"), (3600, 60, "m"), (86400, 3600, "h")]
    out = F.concat(F.floor(s / 86400).cast("string"), F.lit("d ago"))
    for end, unit, name in reversed(steps):
        out = F.when(s < end, F.concat(F.floor(s / unit).cast("string"), F.lit(f"{name} ago"))).otherwise(out)
    return out


def compact(c: Column) -> Column:
    """A number with at most one decimal and K, M, B or T from a thousand on; ``n/a`` if it is not finite."""
    out = F.regexp_replace(F.regexp_replace(c.cast("double").cast("decimal(38,6)").cast("string"), r"0+$", ""), r"\.$", "")
    for k, name in enumerate(("K", "M", "B", "T"), 1):
        scaled = F.round(c / F.lit(1000.0**k), 1)
        text = F.regexp_replace(F.format_string("%.1f", scaled), r"\.0$", "")
        out = F.when(F.round(c / F.lit(1000.0 ** (k - 1)), 1) >= 1000, F.concat(text, F.lit(name))).otherwise(out)
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit("n/a")).otherwise(out)
