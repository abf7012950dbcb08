"""Samples as they arrive, brought to one spelling of the station and one clock.

`normalised` is shared by every operator on readings. Results for odd input:
a station that no row of `stations` has, a null station, a timestamp that is no instant: the row has no
station or no `t_us`, and stays out of what is computed by station and time. Extra columns are ignored,
whatever they are called. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirstone.shared import dimension

_WIDE = "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F))
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F))
_PLAIN_STATION = "^[A-Z]+[1-9][0-9]*$"
_LOOSE = r"^(\d{4})-?(\d\d)-?(\d\d)[T ](\d\d):?(\d\d):?(\d\d)([.]\d+)? ?(Z|[+-]\d\d(:?\d\d)?)?$"
_ZONED = r"^(\d{4})-?(\d\d)-?(\d\d)[T ](\d\d):?(\d\d):?(\d\d)([.]\d+)? ?([+-]\d\d):?(\d\d)$"


def station_key(station: Column) -> Column:
    """One key for all spellings: case, width, blanks, punctuation and leading zeros of the number don't count."""
    bare = F.regexp_replace(F.upper(F.translate(station, _WIDE, _NARROW)), "[^A-Z0-9]", "")
    key = F.regexp_replace(bare, "^([A-Z]*)0+([0-9])", "$1$2")
    return F.when(station.rlike(_PLAIN_STATION), station).otherwise(key)


def instant_us(text: Column, utc_offset: Column) -> Column:
    """Microseconds since 1970 UTC of a timestamp text, null where it is no instant.

    ISO 8601 in extended or basic form, `T` or a blank, any case, fractions, `Z` or an offset; without an
    offset the time is local to `utc_offset` (UTC where that is null). Up to 11 digits count seconds, 12 to 14
    milliseconds.
    """
    at = lambda i: F.substring(text, i, 1)
    shaped = (at(11) == "T") & F.length(text).between(20, 35) & (at(5) == "-") & (at(8) == "-") & (at(14) == ":") & (at(17) == ":")
    zoned = text.endswith("Z") | ((at(-3) == ":") & at(-6).isin("+", "-"))
    t = F.upper(F.trim(text))
    number = t.try_cast("bigint")
    zone = F.endswith(t, F.lit("Z")) | F.substring(t, -6, 1).isin("+", "-") | F.substring(t, -5, 1).isin("+", "-") | F.substring(t, -3, 1).isin("+", "-")
    full = F.when(zone, t).otherwise(F.concat(t, F.coalesce(utc_offset, F.lit("Z"))))
    full = F.regexp_replace(F.regexp_replace(full, "Z$", "+00:00"), r"([+-]\d\d)$", "$1:00")
    tidy = F.regexp_replace(full, _ZONED, "$1-$2-$3T$4:$5:$6$7$8:$9")
    clean = F.when(shaped & zoned, text).when(t.rlike(_LOOSE), tidy)
    return F.when(F.length(text).between(1, 14) & t.rlike(r"^\d+$"), F.when(F.length(t) <= 11, number * 1_000_000).otherwise(number * 1_000)).otherwise(F.unix_micros(clean.try_cast("timestamp")))


def station_dim(stations: DataFrame) -> DataFrame:
    """One row per station, the one of the highest seq: sid INT (that seq), station, skey, pipeline, interval_s, utc_offset."""
    row = F.max_by(F.struct("seq", "pipeline", "interval_s", "utc_offset"), "seq").alias("r")
    latest = stations.where("station_id is not null").groupBy("station_id").agg(row)
    return latest.select(F.col("r.seq").cast("int").alias("sid"), F.col("station_id").alias("station"), station_key(F.col("station_id")).alias("skey"), "r.pipeline", "r.interval_s", "r.utc_offset")


def _stationed(samples: DataFrame, stations: DataFrame) -> DataFrame:
    dim = dimension(station_dim(stations))
    s = samples.select("sample_id", station_key(F.col("station_id")).alias("skey"), "timestamp", F.nanvl("value", F.lit(None).cast("double")).alias("value"), "window_id")
    return s.join(dim, "skey")


def normalised(samples: DataFrame, stations: DataFrame) -> DataFrame:
    """sample_id, sid, interval_s, pipeline, t_us (null if unreadable), value (null for NaN), window_id; rows of unknown stations are left out."""
    return _stationed(samples, stations).select("sample_id", "sid", "interval_s", "pipeline", instant_us(F.col("timestamp"), F.col("utc_offset")).alias("t_us"), "value", "window_id")


def readable(samples: DataFrame, stations: DataFrame) -> DataFrame:
    """normalised without the rows that have no instant. Made by a generator, so that the text is parsed once: a filter would be pushed below and parse it again."""
    instants = F.array(instant_us(F.col("timestamp"), F.col("utc_offset")))
    return _stationed(samples, stations).select("sample_id", "sid", "interval_s", "pipeline", F.explode(instants).alias("t_us"), "value", "window_id").where("t_us is not null")


def usable(samples: DataFrame, stations: DataFrame) -> DataFrame:
    return readable(samples, stations).where("value is not null")


def named(df: DataFrame, stations: DataFrame) -> DataFrame:
    """Puts station_id, as stations spells it, in place of sid."""
    dim = dimension(station_dim(stations).select("sid", F.col("station").alias("station_id")))
    return df.join(dim, "sid").select("station_id", *[c for c in df.columns if c != "sid"])
