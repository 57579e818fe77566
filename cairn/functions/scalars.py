"""Scalar functions as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.model import SIZE_UNITS

_UNITS = ("KiB", "MiB", "GiB", "TiB")


def format_size(size: Column) -> Column:
    """A size in the largest unit of which it is half at least, with one decimal, ties to even; bytes have none."""

    def shown(power: int) -> Column:
        return F.format_string(f"%.1f {_UNITS[power - 1]}", F.bround(size / F.lit(1024.0**power), 1))

    out = shown(len(_UNITS))
    for power in range(len(_UNITS) - 1, 0, -1):
        out = F.when(size < 512 * 1024**power, shown(power)).otherwise(out)
    return F.when(size < 512, F.format_string("%d Byte", size.cast("long"))).otherwise(out)


def format_speed(size: Column, seconds: Column) -> Column:
    return F.concat(format_size(F.floor(F.try_divide(size.cast("double"), seconds)).cast("long")), F.lit("/s"))


def format_duration(seconds: Column) -> Column:
    """H:MM:SS.s"""
    whole = F.floor(seconds)
    rest = (whole % 60).cast("double") + (seconds - whole)
    return F.format_string("%d:%02d:%04.1f", F.floor(whole / 3600).cast("long"), (F.floor(whole / 60) % 60).cast("long"), rest)


def parse_size(text: Column) -> Column:
    """Bytes of a size with its mandatory suffix b, k, m, g or t; null for anything else."""
    number = F.regexp_extract(text, "^([0-9]+)[bkmgtBKMGT]$", 1)
    unit = F.lower(F.right(text, F.lit(1)))
    factor = F.coalesce(*(F.when(unit == u, F.lit(1024**p)) for u, p in SIZE_UNITS.items()))
    return F.when(number != "", number.cast("long") * factor)


def glob_regex(pattern: str) -> str | None:
    """The regular expression of an exclude line: ``?`` one character, ``*`` within a name, ``**`` across names.

    A leading slash ties it to the root, other patterns match from any slash on; a match ends at a slash or the end.
    Blank lines and lines of ``#`` are none.
    """
    line = pattern.strip()
    if not line or line.startswith("#"):
        return None
    rooted, body = line.startswith("/"), line.lstrip("/") if line.startswith("/") else line
    special = {"**": ".*", "*": "[^/]*", "?": "."}
    parts = (special.get(p) or re.escape(p) for p in re.findall(r"\*\*|\*|\?|[^*?]+", body))
    return ("^/" if rooted else "/") + "".join(parts) + "($|/)"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether any exclude line matches the path."""
    found = [r for r in map(glob_regex, patterns) if r]
    return path.rlike("|".join(f"(?:{r})" for r in found)) if found else F.lit(False)


def ancestors(path: Column) -> Column:
    """The directories above a path, the root ``/`` first."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    ups = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(F.lit("/")), F.transform(ups, lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))))


def parent(path: Column) -> Column:
    up = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(path == "/", None).when(up == "", "/").otherwise(up)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def device_major(rdev: Column) -> Column:
    return F.shiftright(rdev, 8)


def device_minor(rdev: Column) -> Column:
    return rdev.bitwiseAND(255)


def device_number(major: Column, minor: Column) -> Column:
    return F.shiftleft(major, 8) + minor


def percent_saved(part: Column, whole: Column) -> Column:
    """(part / whole - 1) * 100; null where there is no whole."""
    return (F.try_divide(part.cast("double"), whole.cast("double")) - 1) * 100


def repo_path_part(text: Column, part: int) -> Column:
    """Part 0, 1 or 2 of ``repo::snapshot::subpath``; null if empty."""
    return F.nullif(F.get(F.split(text, "::", 3), F.lit(part)), F.lit(""))


def hex_text(data: Column) -> Column:
    return F.lower(F.hex(data))


def unhex_text(text: Column) -> Column:
    """Bytes of hex, white space passed over; null if it is no hex."""
    return F.unhex(F.regexp_replace(text, "\\s", ""))


def mail_date(seconds: Column) -> Column:
    """Seconds since 1970 as mail headers write times, in the session's time zone."""
    return F.date_format(F.timestamp_seconds(seconds), "EEE, d MMM yyyy HH:mm:ss xx")
