"""Scalar functions on columns: time, four-character codes, languages, bits and formats. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from 1904-01-01 to 1970-01-01, the epoch of movie times.
MOVIE_EPOCH = 0x7C25B080


def convert_time(value: Column, source: Column, target: Column) -> Column:
    """Ticks of one timescale in another: half-up in double precision, 0 where the source scale is 0."""
    scaled = F.floor(F.lit(0.5) + value.cast("double") * (target.cast("double") / source.cast("double"))).cast("long")
    return F.when(source == 0, F.lit(0).cast("long")).otherwise(scaled)


def convert_time_exact(value: Column, source: Column, target: Column) -> Column:
    """The same in integers, for values above 2**53; for values that are not negative."""
    v, s, t = (c.cast("decimal(38,0)") for c in (value, source, target))
    return F.when(source == 0, F.lit(0).cast("long")).otherwise(F.floor((v * t * 2 + s) / (s * 2)).cast("long"))


def duration_ms(duration: Column, timescale: Column) -> Column:
    return convert_time(duration, timescale, F.lit(1000))


def bitrate(total_bytes: Column, millis: Column) -> Column:
    """Bits a second as an integer, 0 for no duration."""
    return F.when(millis == 0, F.lit(0).cast("long")).otherwise(F.expr("1").cast("long") * F.floor(total_bytes * 8000 / millis).cast("long"))


def frame_rate(count: Column, duration: Column, timescale: Column) -> Column:
    """Samples a second, 0.0 for no duration or scale."""
    return F.when((duration == 0) | (timescale == 0), F.lit(0.0)).otherwise(count.cast("double") / (duration.cast("double") / timescale.cast("double")))


def fourcc_text(code: Column) -> Column:
    """A 32-bit code as four Latin-1 characters."""
    return F.concat(*[F.chr(F.shiftrightunsigned(code, shift).bitwiseAND(F.lit(255)).cast("int")) for shift in (24, 16, 8, 0)])


def fourcc_code(text: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.lit(0).cast("long"), lambda acc, k: acc * 256 + F.ascii(F.substring(text, k, F.lit(1))))


def uint(data: Column, position: Column | int, size: int) -> Column:
    """Big-endian unsigned integer of up to 7 bytes at a 1-based position of binary data."""
    at = F.lit(position) if isinstance(position, int) else position
    return F.conv(F.hex(F.substring(data, at, F.lit(size))), 16, 10).cast("long")


def language_code(packed: Column) -> Column:
    """Three letters from 15 packed bits; 0x7FFF is ``und``."""
    letters = [F.chr((F.shiftright(packed, s).bitwiseAND(F.lit(31)) + 0x60).cast("int")) for s in (10, 5, 0)]
    some_zero = F.lit(False)
    for s in (10, 5, 0):
        some_zero = some_zero | (F.shiftright(packed, s).bitwiseAND(F.lit(31)) == 0)
    return F.when(packed == 0x7FFF, F.lit("und")).when(some_zero, F.lit("```")).otherwise(F.concat(*letters))


def language_pack(text: Column) -> Column:
    part = [F.shiftleft((F.ascii(F.substring(text, k + 1, 1)) - 0x60).bitwiseAND(F.lit(31)), 10 - 5 * k) for k in range(3)]
    return part[0].bitwiseOR(part[1]).bitwiseOR(part[2])


def fixed_16_16(raw: Column) -> Column:
    return raw.cast("double") / F.lit(65536.0)


def iso_duration(seconds: Column) -> Column:
    """``PT#H#M#.###S``; hours and minutes only where there are some."""
    whole = F.floor(seconds).cast("long")
    hours, minutes = F.expr("0").cast("long") + F.floor(whole / 3600).cast("long"), F.floor((whole % 3600) / 60).cast("long")
    rest = seconds - (hours * 3600 + minutes * 60).cast("double")
    h = F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise("")
    m = F.when((hours > 0) | (minutes > 0), F.concat(minutes.cast("string"), F.lit("M"))).otherwise("")
    return F.concat(F.lit("PT"), h, m, F.format_string("%.3f", rest), F.lit("S"))


def truthy(text: Column) -> Column:
    return F.lower(text).isin("yes", "true", "on", "1")


def target_duration_rounded(longest: Column) -> Column:
    """The playlist target from the longest duration in seconds: raised when rounding does, and stored cut off."""
    return F.floor(longest + 0.5).cast("long")


def target_duration_ceiling(longest: Column) -> Column:
    return F.ceil(longest).cast("long")


def field_width(largest: Column) -> Column:
    """Bits of a packed size table's entries that hold the largest size."""
    return F.when(largest < 256, 8).when(largest < 65536, 16).otherwise(32)
