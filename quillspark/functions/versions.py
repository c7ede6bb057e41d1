"""Versions and requirements as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def core(version: Column | str) -> Column:
    """struct<major, minor, patch>, compared in that order; build and pre-release text ignored, bad parts 0."""
    v = F.substring_index(F.substring_index(col(version), "+", 1), "-", 1)
    parts = F.split(v, r"\.")
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("bigint"), F.lit(0).cast("long"))
    return F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch"))


def place(version_core: Column) -> Column:
    """A long that never falls as versions rise; equal for versions that differ in parts beyond a million only."""
    part = lambda name, top: F.least(F.greatest(version_core[name], F.lit(0)), F.lit(top)).cast("long")
    return part("major", 9_000_000) * 1_000_000_000_000 + part("minor", 999_999) * 1_000_000 + part("patch", 999_999)


def same_minor(a: Column | str, b: Column | str) -> Column:
    x, y = core(a), core(b)
    return (x["major"] == y["major"]) & (x["minor"] == y["minor"])


def bump(old: Column | str, new: Column | str) -> Column:
    """struct<level, breaks_api, direction> of a step between versions."""
    a, b = core(old), core(new)
    out = lambda level, breaks, way: F.struct(F.lit(level).alias("level"), F.lit(breaks).alias("breaks_api"), F.lit(way).alias("direction"))
    return (
        F.when(col(old).isNull() | col(new).isNull(), out("unknown", True, "unknown"))
        .when(a == b, out("none", False, "same"))
        .when(a > b, out("downgrade", True, "downgrade"))
        .when(a["major"] != b["major"], out("major", True, "upgrade"))
        .when(a["minor"] != b["minor"], F.when(a["major"] == 0, out("minor", True, "upgrade")).otherwise(out("minor", False, "upgrade")))
        .otherwise(out("patch", False, "upgrade"))
    )


def requirement(req: Column | str) -> Column:
    """struct<lo, hi> (hi exclusive, null: open) of a requirement; null where it isn't supported.

    ^ and bare one or two numbers: up to the next change of the first number that isn't zero; ~: up to the next
    minor (or major, for one number); bare three numbers: that version only; x, X and *: any of what is left out.
    Anything else (other marks, lists, pre-releases, build text) is unknown.
    """
    r = F.trim(col(req))
    mark = F.when(r.startswith("^"), "^").when(r.startswith("~"), "~").when(r.rlike("[*xX]"), "*").otherwise("")
    texts = F.split(F.when(mark.isin("^", "~"), F.substr(r, F.lit(2))).otherwise(r), r"\.", -1)
    known = F.struct(mark.alias("mark"), texts.alias("t"), F.transform(texts, lambda x: F.when(x.rlike(r"^\+?\d+$"), x.try_cast("bigint"))).alias("p"))
    # one element, so that the range's expressions share what was parsed
    return F.transform(F.array(known), _range)[0]


def _range(x: Column) -> Column:
    zero = F.lit(0).cast("long")
    v = lambda a, b, c: F.struct(a.alias("major"), b.alias("minor"), c.alias("patch"))
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    mark, n, p = x["mark"], F.size(x["p"]), x["p"]
    a, b, c = (F.coalesce(F.get(p, F.lit(i)), zero) for i in range(3))
    lo = v(a, b, c)
    caret = F.when(a > 0, v(a + 1, zero, zero)).when(n == 1, v(a + 1, zero, zero)).when(b > 0, v(zero, b + 1, zero)).when(n == 2, v(zero, b + 1, zero)).otherwise(v(zero, zero, c + 1))
    tilde = F.when(n == 1, v(a + 1, zero, zero)).otherwise(v(a, b + 1, zero))
    wild = F.transform(x["t"], lambda t: t.isin("*", "x", "X"))
    at = F.array_position(wild, True).cast("int") - 1
    from_there = (at >= 0) & (n <= 3) & (F.size(F.filter(wild, lambda w: w)) == n - at) & (F.size(F.filter(p, lambda q: q.isNotNull())) == at)
    open_end = F.when(at == 0, F.lit(None)).when(at == 1, v(a + 1, zero, zero)).otherwise(v(a, b + 1, zero))
    return (
        F.when(mark == "*", F.when(from_there, pair(lo, open_end)))
        .when(~F.forall(p, lambda q: q.isNotNull()), F.lit(None))
        .when(mark == "~", pair(lo, tilde))
        .when((n <= 3) & ((mark == "^") | (n < 3)), pair(lo, caret))
        .when(n == 3, pair(lo, v(a, b, c + 1)))
    )


def satisfies(version: Column | str, req: Column | str) -> Column:
    """true, false, or null for unknown."""
    known = F.struct(core(version).alias("v"), requirement(req).alias("r"), col(version).isNull().alias("none"))
    inside = lambda x: (x["v"] >= x["r"]["lo"]) & (x["r"]["hi"].isNull() | (x["v"] < x["r"]["hi"]))
    return F.transform(F.array(known), lambda x: F.when(~x["r"].isNull() & ~x["none"], inside(x)))[0]


def directory_name(version: Column | str) -> Column:
    """A version as a folder's name: other characters than letters, digits and . _ + - become _."""
    return F.regexp_replace(col(version), "[^A-Za-z0-9._+-]", "_")


def display(name: Column | str) -> Column:
    """0-43-1 as 0.43.1; names with anything but digits and dashes stay."""
    return F.when(col(name).rlike("^[0-9-]*[0-9][0-9-]*\\z"), F.translate(col(name), "-", ".")).otherwise(col(name))


def age_days(moment: Column | str, now: Column) -> Column:
    """Whole days from an RFC 3339 moment to ``now``, at least 0; null where it is no such moment."""
    rfc = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})\z"
    days = F.floor((now.cast("double") - F.upper(col(moment)).try_cast("timestamp").cast("double")) / 86400)
    return F.when(col(moment).rlike(rfc), F.when(days < 0, 0).otherwise(days)).cast("long")


def index_address(package: Column | str) -> Column:
    """Address of a package's file in the sparse index: folders by the length and the first letters of the name."""
    name = F.translate(col(package), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, cut = F.octet_length(name), lambda at, size: F.substring(name, at, size)
    folder = F.when(n == 0, "").when(n < 3, F.concat(n.cast("string"), F.lit("/"))).when(n == 3, F.concat(F.lit("3/"), cut(1, 1), F.lit("/"))).otherwise(F.concat(cut(1, 2), F.lit("/"), cut(3, 2), F.lit("/")))
    return F.concat(F.lit("https://index.crates.io/"), folder, name)
