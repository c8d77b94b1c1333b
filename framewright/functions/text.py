"""File names, times and JSON settings as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File suffixes that a scan admits, by kind.
RAW = (".cr2", ".nef", ".arw", ".dng", ".orf", ".srw")
TIFF = (".tif", ".tiff")
JPEG = (".jpg", ".jpeg")
#: Fixed value: capture time in a name, camera_date_time.
NAME_TIME = r"(\d{8})_(\d{2})(\d{2})(\d{2})"


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(name(path), r"(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"\.[^.]+$", "")


def captured_at(text: Column) -> Column:
    """Metadata time, NULL where it is no time."""
    return F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")


def hour_of(text: Column) -> Column:
    """Hour in a name; NULL without one, not checked for range."""
    return F.nullif(F.regexp_extract(text, NAME_TIME, 2), F.lit("")).cast("int")


def is_night(hour: Column, start: int = 7, end: int = 18) -> Column:
    """Outside [start, end); an unknown hour is never night."""
    return F.coalesce((hour < start) | (hour >= end), F.lit(False))


def setting(doc: Column, key: str, default, kind: str) -> Column:
    """A JSON setting with a default where the key is missing or null."""
    return F.coalesce(F.get_json_object(doc, f"$.{key}").cast(kind), F.lit(default).cast(kind))


def shutter_parts(seconds: Column) -> tuple[Column, Column]:
    """(is a fraction, the rounded number): 1/n below a second, else n seconds."""
    frac = seconds < 1
    return frac, F.when(frac, F.bround(1 / seconds)).otherwise(seconds)
