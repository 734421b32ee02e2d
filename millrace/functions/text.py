"""Text and URL columns."""

from __future__ import annotations

from pyspark.sql import functions as F


def normalised(column):
    """Lower case, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(column), r"\s+", " "))


def url_host(column):
    """Host in lower case, without `www.` or `m.`."""
    host = F.regexp_extract(F.lower(column), r"^[a-z]+://([^/?#]*)", 1)
    return F.regexp_replace(host, r"^(www|m)\.", "")


def url_path(column):
    """Path without query and fragment."""
    return F.regexp_extract(column, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)


def stable_bucket(column, buckets=100):
    """A number from 0 that depends on the value alone."""
    digits = F.substring(F.md5(column.cast("string")), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(buckets))
