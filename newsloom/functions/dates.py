"""Time and number functions. The clock is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def round3(x: Column) -> Column:
    """Three places, halves up."""
    return F.floor(x * 1000 + 0.5) / 1000


def hours_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / 3.6e9


def recency(published: Column, now: Column, max_age_hours: float) -> Column:
    """1 when new, falling to 0 at the age limit; 0 for what is missing, older or in the future."""
    age = hours_between(now, published)
    return F.when((age >= 0) & (age <= max_age_hours), 1 - age / max_age_hours).otherwise(F.lit(0.0))


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(a, b)


def masthead_date(d: Column) -> Column:
    return F.date_format(d, "EEEE, d MMMM yyyy")


def short_date(d: Column) -> Column:
    return F.date_format(d, "d MMM yyyy")


def normalize_date(raw: Column) -> Column:
    """ISO or RFC 822 text to a UTC timestamp, else null."""
    text = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), "<[^>]+>", " "))
    mail = F.regexp_extract(text, r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}(:\d{2})?)", 1)
    full = F.when(F.regexp_extract(text, r"\d{2}:\d{2}(:\d{2})", 1) == "", F.concat(mail, F.lit(":00"))).otherwise(mail)
    zone = F.regexp_extract(text, r"([+-]\d{2}):?(\d{2})\s*(\([A-Z]+\))?$", 1)
    minutes = F.regexp_extract(text, r"([+-]\d{2}):?(\d{2})\s*(\([A-Z]+\))?$", 2)
    shift = F.when(zone == "", F.lit(0)).otherwise(zone.cast("int") * 60 + F.when(zone.startswith("-"), -minutes.cast("int")).otherwise(minutes.cast("int")))
    at = F.try_to_timestamp(F.when(mail != "", full), F.lit("d MMM yyyy HH:mm:ss"))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))
    return F.coalesce(F.timestamp_add("MINUTE", -shift, at), iso)


def relative_time(published: Column, now: Column) -> Column:
    """just now, minutes, hours or days ago."""
    m = F.floor(hours_between(now, published) * 60).cast("long")
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")), F.lit(" ago"))
    return F.when(m < 1, F.lit("just now")).when(m < 60, say(m, "minute")).when(m < 1440, say(F.floor(m / 60), "hour")).otherwise(say(F.floor(m / 1440), "day"))


def staleness(harvested: Column, generated: Column, banner_hours: int = 36) -> Column:
    """Hours an edition is behind the harvest, whole days, and whether that calls for a banner."""
    hours = F.greatest(F.lit(0.0), hours_between(harvested, generated))
    return F.struct(hours.alias("hours"), F.floor(hours / 24).cast("long").alias("days"), (hours >= banner_hours).alias("banner"))
