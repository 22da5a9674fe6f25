"""Small functions on versions, durations and sentiment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_numbers(version: Column) -> Column:
    """``v1.9.2`` as [1, 9, 2], padded to three numbers."""
    found = F.transform(F.regexp_extract_all(version, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    return F.slice(F.concat(found, F.array(F.lit(0), F.lit(0), F.lit(0))), 1, 3)


def version_at_least(version: Column, least: str) -> Column:
    return version_numbers(version) >= version_numbers(F.lit(least))


def next_version(version: Column) -> Column:
    """The last number one higher: ``v1.9`` becomes ``v1.10``."""
    return F.concat(F.regexp_replace(version, r"\d+$", ""), (F.regexp_extract(version, r"(\d+)$", 1).cast("int") + 1).cast("string"))


def long_enough(seconds: Column, least: float = 3.0) -> Column:
    """Whether a recording may hold speech, by its duration."""
    return F.coalesce(seconds >= least, F.lit(False))


def byte_tokens(text: Column) -> Column:
    """Tokens estimated as a quarter of the UTF-8 bytes."""
    return F.round(F.octet_length(text) / 4).cast("long")
