"""Listings by address, pages with cursors, completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import uri as U

DEFAULT_PAGE, LARGEST_PAGE = 50, 200


def sub_crate() -> Column:
    return F.coalesce(F.nullif(F.regexp_extract("source_ref", r"docs\.rs/([^/]+)/", 1), F.lit("")), F.nullif(F.col("crate_name"), F.lit("")))


def matches(label: str, value: str) -> Column:
    return {
        "kind": lambda: F.col("kind") == value, "module": lambda: F.col("module").startswith(value), "crate": lambda: sub_crate() == value,
        "owner": lambda: X.base_name("owner") == value, "doc": lambda: F.col("file") == value, "api": lambda: F.col("full_path") == value,
        "path": lambda: F.col("full_path") == value,
    }[label]()


def page(rows: DataFrame, query: str, cursor: str | None = None, size: int | None = None) -> tuple[DataFrame, str | None]:
    """A page in record order, and the next cursor: the query's fingerprint and an offset. The offset may equal the
    total (an empty page); a cursor of another query, or beyond the total, is an error."""
    import hashlib

    mark = hashlib.sha256(query.encode()).hexdigest()[:16]
    size = max(1, min(size or DEFAULT_PAGE, LARGEST_PAGE))
    offset = 0
    if cursor:
        own, _, at = cursor.partition(":")
        if own != mark or not at.isdigit():
            raise ValueError("the cursor belongs to another query")
        offset = int(at)
    total = rows.count()
    if offset > total:
        raise ValueError("the cursor is beyond the end")
    nxt = f"{mark}:{offset + size}" if offset + size < total else None
    return rows.orderBy("dense_id").offset(offset).limit(size), nxt


def read(records: DataFrame, address: str) -> tuple[DataFrame, str | None]:
    """Rows of scheme://label/version/value?cursor=..., a page at a time; api and path give the first record."""
    import re
    from urllib.parse import unquote

    m = re.fullmatch(r"([a-z][a-z0-9+-]*)://([^/?]+)/([^/?]+)/([^?]*)(?:\?cursor=(.*))?", address)
    if not m:
        raise ValueError(f"no such resource: {address}")
    label, value = m[2], unquote(m[4])
    rows = records.where(matches(label, value))
    if label in ("api", "path"):
        return rows.orderBy("dense_id").limit(1), None
    return page(rows, f"{label}/{m[3]}/{value}", m[5])


def complete(values: DataFrame, column: str, prefix: str, limit: int = 100) -> DataFrame:
    """Distinct values that begin with the prefix in any case, in order, with the ``total`` there are."""
    hits = values.where(F.lower(column).startswith(prefix.lower())).select(F.col(column).alias("value")).distinct()
    total = hits.agg(F.count("*").alias("total"))
    return hits.orderBy("value").limit(limit).crossJoin(F.broadcast(total))


__all__ = ["complete", "matches", "page", "read", "sub_crate", "U"]
