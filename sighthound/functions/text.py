"""Text, time and number formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column | str, places: int) -> Column:
    """Half away from zero of the product in double, as the SQL's ``round``; Spark's own rounds the shortest decimal of ``x``, which differs where a double only comes near a half."""
    return F.round((F.col(x) if isinstance(x, str) else x) * float(10**places)) / float(10**places)


def clean_plate(text: Column) -> Column:
    """Letters and digits only, in upper case."""
    return F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def class_label(name: Column, class_id: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), class_id.cast("string"), F.lit("None"))


def frame_rate(text: Column) -> Column:
    """``num/den`` or a plain number; null where it can't be read or the denominator is 0."""
    parts = F.split(text, "/")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return F.when(F.size(parts) == 2, F.try_divide(number(0), number(1))).otherwise(number(0))


def duration(seconds: Column) -> Column:
    """``59s``, ``3m 20s``, ``1h 5m``: whole seconds half to even under a minute, cut off above."""
    whole = F.floor(seconds)
    return (
        F.when(seconds < 60, F.concat(F.bround(seconds).cast("long").cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(F.floor(whole / 60).cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(whole / 3600).cast("string"), F.lit("h "), F.floor(whole % 3600 / 60).cast("string"), F.lit("m")))
    )


def clock(seconds: Column) -> Column:
    """HH:MM:SS of seconds since midnight, wrapping after a day."""
    s = F.floor(seconds) % 86400
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat_ws(":", two(s / 3600), two(s % 3600 / 60), two(s % 60))


def gap_text(seconds: Column) -> Column:
    """``42s`` or ``1.5m``, half to even."""
    return F.when(seconds < 60, F.concat(F.bround(seconds).cast("long").cast("string"), F.lit("s"))).otherwise(F.concat(F.format_string("%.1f", F.bround(seconds / 60, 1)), F.lit("m")))


def away_text(seconds: Column) -> Column:
    """``42s``, ``17min`` or ``2h 5m``."""
    whole = F.floor(seconds)
    near = lambda x: F.bround(x).cast("long").cast("string")
    return (
        F.when(seconds < 60, F.concat(near(seconds), F.lit("s")))
        .when(seconds < 3600, F.concat(near(seconds / 60), F.lit("min")))
        .otherwise(F.concat(F.floor(whole / 3600).cast("string"), F.lit("h "), F.floor(whole % 3600 / 60).cast("string"), F.lit("m")))
    )


def overlay_time(text: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` in what was read off a picture, common misreadings mended; null where there is none."""
    # What is mended, in this order, and what is looked for then.
    found = r"(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})"
    for pattern, put in ((r"(\d)\s*:\s*(\d)", "$1:$2"), (r"(\d)\s*-\s*(\d)", "$1-$2"), ("_", "-"), (r"(\d),(\d)", "$1 $2"), (r"\b([12])\d(\d{3})\b", "$1$2")):
        text = F.regexp_replace(text, pattern, put)
    return F.nullif(F.concat_ws(" ", F.nullif(F.regexp_extract(text, found, 1), F.lit("")), F.nullif(F.regexp_extract(text, found, 2), F.lit(""))), F.lit(""))


def whole_number(text: Column) -> Column:
    """A number's whole part, cut towards zero; null where it can't be read."""
    return text.try_cast("double").try_cast("long")


def moment(date: Column, start: Column, seconds: Column) -> Column:
    """Time of day ``start`` (HH:MM:SS) on ``date`` (2000-01-01 without one) plus seconds."""
    at = F.to_timestamp_ntz(F.concat_ws(" ", F.coalesce(date, F.lit("2000-01-01")), start), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.timestamp_add("SECOND", seconds.cast("int"), at)


def confidence_band(share: Column) -> Column:
    return F.when(share * 100 >= 60, "success").when(share * 100 >= 30, "warning").otherwise("info")


def person_text(upper: Column, lower: Column) -> Column:
    return F.concat(upper, F.lit(" top, "), lower, F.lit(" bottom"))


def vehicle_text(colour: Column, kind: Column) -> Column:
    return F.concat_ws(" ", colour, kind)


def file_stem(path: Column) -> Column:
    """A file's name without folder and last ending: the label of a camera."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def class_rgb(name: Column) -> Column:
    """A class's colour: the first three bytes of the MD5 of its name."""
    digest = F.md5(name.cast("binary"))
    return F.array(*[F.conv(F.substring(digest, i, 2), 16, 10).cast("int") for i in (1, 3, 5)])


def clock_from(start: Column, seconds: Column) -> Column:
    """HH:MM:SS of a clock that stood at ``start`` (HH:MM:SS) when the recording began, round the clock; without a start the time since then."""
    part = F.split(start, ":")
    begin = part[0].cast("long") * 3600 + part[1].cast("long") * 60 + part[2].cast("long")
    s = F.pmod(F.coalesce(begin, F.lit(0)) + F.floor(seconds), F.when(begin.isNotNull(), F.lit(86400)).otherwise(F.lit(1 << 40)))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(s / 3600)
    return F.concat_ws(":", F.when(hours > 99, hours.cast("string")).otherwise(two(hours)), two(F.floor(s / 60) % 60), two(s % 60))


def first_filled(*texts: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])
