"""Storage codecs for columns: fixed-point numbers, enumerations, high-resolution time, status bits, text of bounded size."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least and largest number of the integer types that fixed-point codes may have.
_RANGES = {f"{u}int{n}": (0, 2**n - 1) if u else (-(2 ** (n - 1)), 2 ** (n - 1) - 1) for u in ("", "u") for n in (8, 16, 32)}


def fixed_codes(kind: str = "uint16") -> tuple[int, int, int, int, int]:
    """(code of minus infinity, of not-a-number, of plus infinity, least, largest valid code) of an integer type.

    Unsigned types reserve their three largest numbers, signed ones their two least and the largest.
    """
    if kind not in _RANGES:
        raise ValueError(f"no such integer type: {kind}")
    low, high = _RANGES[kind]
    return (high - 2, high - 1, high, low, high - 3) if low == 0 else (low, low + 1, high, low + 2, high - 1)


def encode_fixed(x: Column, scale: float, offset: float, kind: str = "uint16") -> Column:
    """round(x * scale), half to even, + offset, as a whole number of `kind`; what does not fit saturates to the code of its infinity."""
    minus, nan, plus, least, largest = fixed_codes(kind)
    x = x.cast("double")
    inf = F.lit(float("inf"))
    code = F.bround(x * scale, 0) + offset
    return (
        F.when(F.isnan(x), nan)
        .when((x == -inf) | (code < least), minus)
        .when((x == inf) | (code > largest), plus)
        .otherwise(code)
        .cast("long" if kind == "uint32" else "int")
    )


def decode_fixed(code: Column, scale: float, offset: float, kind: str = "uint16") -> Column:
    minus, nan, plus, _, _ = fixed_codes(kind)
    return (
        F.when(code == nan, F.lit(float("nan")))
        .when(code == minus, F.lit(float("-inf")))
        .when(code == plus, F.lit(float("inf")))
        .otherwise((code - offset) / scale)
    )


def encode_enum(x: Column, values: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, number in values.items():
        out = F.when(x == name, number).otherwise(out)
    return out


def decode_enum(x: Column, values: dict[str, int]) -> Column:
    out = F.lit(None).cast("string")
    for name, number in values.items():
        out = F.when(x == number, name).otherwise(out)
    return out


#: From when on (UTC) TAI is how many seconds ahead of UTC. The leap seconds.
LEAP_SECONDS = (
    ("1972-01-01", 10), ("1972-07-01", 11), ("1973-01-01", 12), ("1974-01-01", 13), ("1975-01-01", 14), ("1976-01-01", 15),
    ("1977-01-01", 16), ("1978-01-01", 17), ("1979-01-01", 18), ("1980-01-01", 19), ("1981-07-01", 20), ("1982-07-01", 21),
    ("1983-07-01", 22), ("1985-07-01", 23), ("1988-01-01", 24), ("1990-01-01", 25), ("1991-01-01", 26), ("1992-07-01", 27),
    ("1993-07-01", 28), ("1994-07-01", 29), ("1996-01-01", 30), ("1997-07-01", 31), ("1999-01-01", 32), ("2006-01-01", 33),
    ("2009-01-01", 34), ("2012-07-01", 35), ("2015-07-01", 36), ("2017-01-01", 37),
)
_DAY = 86_400_000_000


def _utc_micros(day: str) -> int:
    return (date.fromisoformat(day) - date(1970, 1, 1)).days * _DAY


def _drift(days: Column) -> Column:
    """Microseconds of TAI - UTC before 1972, at days since 1970; seconds were of another length then."""
    return F.bround((days + (40587 - 39126)) * 2592.0 + 4_213_170.0, 0).cast("long")


def tai_micros(t: Column) -> Column:
    """Microseconds since 1970-01-01T00:00:00 TAI of a UTC instant."""
    micros = F.unix_micros(t.cast("timestamp"))
    ahead = _drift(micros / _DAY)
    for day, seconds in LEAP_SECONDS:
        ahead = F.when(micros >= _utc_micros(day), seconds * 1_000_000).otherwise(ahead)
    return micros + ahead


def utc_micros(tai: Column) -> Column:
    """The inverse of tai_micros, as microseconds; within a leap second the second before it once more."""
    out = F.bround((tai - 4_213_170.0 - (40587 - 39126) * 2592.0) / (1 + 2592.0 / _DAY), 0).cast("long")
    for day, seconds in LEAP_SECONDS:
        out = F.when(tai >= _utc_micros(day) + seconds * 1_000_000, tai - seconds * 1_000_000).otherwise(out)
    return out


def time_to_high_res(t: Column) -> Column:
    """struct(seconds, quarter_nanoseconds) since 1970-01-01T00:00:00 TAI of a UTC instant, seconds kept within 32 bits."""
    micros = tai_micros(t)
    seconds = F.floor(micros / 1_000_000)
    return F.struct(
        F.least(F.greatest(seconds, F.lit(0)), F.lit(2**32 - 1)).cast("long").alias("seconds"),
        ((micros - seconds * 1_000_000) * 4000).cast("long").alias("quarter_nanoseconds"),
    )


def high_res_to_micros(seconds: Column, quarter_nanoseconds: Column) -> Column:
    """UTC microseconds since 1970 of a high-resolution TAI time."""
    return utc_micros(seconds.cast("long") * 1_000_000 + F.floor(quarter_nanoseconds / 4000))


def dvr_status(status: Column) -> Column:
    """Bits 0 and 1 of a pixel's status byte."""
    return status.bitwiseAND(F.lit(0b11))


def channel_info(status: Column) -> Column:
    """Bits 2 and 3: which gain channels are stored."""
    return F.shiftright(status.bitwiseAND(F.lit(0b1100)), 2)


def is_invalid(status: Column) -> Column:
    return channel_info(status) == 0


def truncate_utf8(x: Column, most: int) -> Column:
    """The longest prefix of at most `most` UTF-8 bytes that ends between characters."""
    sizes = F.transform(F.sequence(F.lit(0), F.least(F.length(x), F.lit(most))), lambda n: F.when(F.octet_length(F.substring(x, F.lit(1), n)) <= most, n).otherwise(0))
    return F.when(F.octet_length(x) <= most, x).otherwise(F.substring(x, F.lit(1), F.array_max(sizes)))
