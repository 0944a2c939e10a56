"""Timestamps of file formats as Spark timestamps; sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_1601 = 116444736000000000


def from_filetime(ticks: Column, guarded: bool = True) -> Column:
    """100 ns ticks since 1601, rounded half-even to microseconds; before 1970 null if guarded."""
    since = ticks - F.lit(EPOCH_1601)
    ticks_per_s = F.lit(10000000).cast("bigint")
    exact = F.call_function("div", since, ticks_per_s).cast("double") + (since % ticks_per_s).cast("double") / F.lit(1e7)
    floor = F.floor(exact)
    micros = floor * 1000000 + F.bround((exact - floor) * 1e6).cast("bigint")
    return F.when(ticks >= EPOCH_1601, F.timestamp_micros(micros)) if guarded else F.timestamp_micros(micros)


def from_webkit(micros: Column) -> Column:
    """Microseconds since 1601; null where not positive."""
    return F.when(micros > 0, F.timestamp_micros(micros - 11644473600000000))


def from_dos(date: Column, time: Column) -> Column:
    """The 16-bit date and time of FAT; null where a field is out of range."""
    year, month, day = F.shiftright(date, 9) + 1980, F.shiftright(date, 5).bitwiseAND(15), date.bitwiseAND(31)
    hour, minute, second = F.shiftright(time, 11), F.shiftright(time, 5).bitwiseAND(63), time.bitwiseAND(31) * 2
    return F.try_make_timestamp(year, month, day, hour, minute, second)


def from_filetime_text(value: Column) -> Column:
    """Decimal ticks, else an ISO time; null for anything else."""
    return F.coalesce(from_filetime(value.try_cast("bigint")), F.try_to_timestamp(value))


def from_filetime_hex(value: Column) -> Column:
    """Ticks as hexadecimal digits, with or without 0x; null for anything else."""
    digits = F.regexp_replace(F.lower(value), "^0x", "")
    return F.when(digits.rlike("^[0-9a-f]{1,16}$"), from_filetime(F.conv(digits, 16, 10).try_cast("bigint")))


def from_mozilla(micros: Column) -> Column:
    """Microseconds since 1970; null where not positive."""
    return F.when(micros > 0, F.timestamp_micros(micros))


def from_unix(seconds: Column) -> Column:
    """Seconds since 1970; null where not positive."""
    return F.when(seconds > 0, F.timestamp_seconds(seconds))


def from_ole(days: Column) -> Column:
    """Days since 1899-12-30, with a fraction."""
    return F.timestamp_micros(F.round((days - 25569) * 86_400_000_000).cast("bigint"))


def from_systemtime(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, milli: Column) -> Column:
    """Eight 16-bit fields but the weekday; null out of 1970 to 2100 or where a field is out of range."""
    return F.when(year.between(1970, 2100), F.try_make_timestamp(year, month, day, hour, minute, second + milli.cast("decimal(10,3)") / 1000))


def from_day(value: Column) -> Column:
    """``YYYYMMDD``; null for anything else."""
    return F.when(value.rlike("^[0-9]{8}$"), F.try_to_timestamp(value, F.lit("yyyyMMdd")))


#: Years that a time must lie in to be taken as one, by artifact; fixed values.
PLAUSIBLE = {"bam": (2017, 2100), "recentapps": (2015, 2100), "networkconfig": (2000, 2100), "typedurls": (2000, 2100), "syscache": (2000, 2100), "srum": (2010, 2030)}


def plausible(at: Column, artifact: str) -> Column:
    """The time where its year lies in the artifact's window, else null."""
    return F.when(F.year(at).between(*PLAUSIBLE[artifact]), at)
