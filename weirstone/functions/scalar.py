"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves toward plus infinity."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def duration_label(seconds: Column) -> Column:
    """3h, 10 min or 45s."""
    whole = lambda c: round_half_up(c).cast("bigint").cast("string")
    return F.when(seconds >= 3600, F.concat(whole(seconds / 3600), F.lit("h"))).when(seconds >= 60, F.concat(whole(seconds / 60), F.lit(" min"))).otherwise(F.concat(seconds.cast("bigint").cast("string"), F.lit("s")))


def time_label(seconds: Column) -> Column:
    """45s, 2m or 2m 5s."""
    m, s = F.floor(seconds / 60).cast("string"), F.pmod(seconds, F.lit(60)).cast("string")
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).when(F.pmod(seconds, F.lit(60)) == 0, F.concat(m, F.lit("m"))).otherwise(F.concat(m, F.lit("m "), s, F.lit("s")))


def backoff(base: Column, failures: Column) -> Column:
    """base * 2^(failures - 1), the exponent at most 16."""
    return base * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(16)))


def base64_plain(content: Column) -> Column:
    """Standard base64 without line breaks."""
    return F.regexp_replace(F.base64(content), "[\r\n]", "")


def last_part(path: Column) -> Column:
    """The last component of a path, 'unknown' without one."""
    name = F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)
    return F.when(name == "", F.lit("unknown")).otherwise(F.coalesce(name, F.lit("unknown")))


def nearest(values: Column, target: Column, step: Column) -> Column:
    """Of evenly spaced values the one nearest to target."""
    i = F.greatest(F.lit(0), F.least(F.size(values) - 1, round_half_up(target / step).cast("int")))
    return F.get(values, i)


def rfc3339(ts: Column) -> Column:
    """A timestamp without zone as text in UTC."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def linear_scale(x: Column, domain: tuple[float, float], to: tuple[float, float]) -> Column:
    """x of the domain carried to the other range."""
    return to[0] + (x - domain[0]) * ((to[1] - to[0]) / (domain[1] - domain[0]))


def spare_ratio(peak: Column) -> Column:
    """How many whole times a percentage fits a hundred; 0 for 0."""
    return F.when(peak == 0, F.lit(0)).otherwise(F.floor(F.lit(100) / peak))
