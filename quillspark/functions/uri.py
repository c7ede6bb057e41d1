"""Percent encoding, resource addresses, and cursors bound to their query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def encode(text: Column | str) -> Column:
    """Everything but letters, digits and -_.~ is escaped."""
    c = F.url_encode(col(text))
    return F.replace(F.replace(F.replace(c, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def decode(text: Column | str) -> Column:
    """A plus sign stays one; null where the escapes are broken."""
    return F.try_url_decode(F.replace(col(text), F.lit("+"), F.lit("%2B")))


def parse(uri: Column | str) -> Column:
    """struct<scheme, label, version, value, cursor> of scheme://label/version/value?cursor=..."""
    c = col(uri)
    part = lambda i: F.nullif(F.regexp_extract(c, r"^([a-z][a-z0-9+-]*)://([^/?]+)(?:/([^/?]+))?(?:/([^?]*))?(?:\?.*)?$", i), F.lit(""))
    cursor = F.nullif(F.regexp_extract(c, r"[?&]cursor=([^&]*)", 1), F.lit(""))
    return F.struct(part(1).alias("scheme"), part(2).alias("label"), part(3).alias("version"), decode(part(4)).alias("value"), cursor.alias("cursor"))


def fingerprint(query: Column | str) -> Column:
    return F.substring(F.sha2(col(query), 256), 1, 16)
