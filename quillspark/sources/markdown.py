"""Markdown pages: front matter, classification by path, and chunks by headings, as DataFrame expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

SMALLEST, LARGEST, WHOLE = 40, 4000, 6000


def front_matter(text: Column | str) -> Column:
    """struct<title, long_title, status, weight, draft, body>; any public_draft key makes a draft."""
    c = X.col(text)
    shape = r"(?s)^\+\+\+\r?\n(.*?)\n\+\+\+[ \t]*\r?(?:\n|$)(.*)$"
    has = c.rlike(shape)
    head = F.when(has, F.regexp_extract(c, shape, 1)).otherwise("")
    get = lambda k: F.nullif(F.regexp_extract(head, rf'(?m)^{k}\s*=\s*"?([^"\n]*?)"?\s*$', 1), F.lit(""))
    return F.struct(
        get("title").alias("title"), get("long_title").alias("long_title"), get("status").alias("status"), get("weight").try_cast("int").alias("weight"),
        head.rlike(r"(?m)^\s*public_draft\s*=").alias("draft"), F.when(has, F.regexp_extract(c, shape, 2)).otherwise(c).alias("body"),
    )


def classify(path: Column | str) -> Column:
    """struct<kind, title, version, from_version, to_version, pr>, by the first rule that fits."""
    p = X.col(path)
    out = lambda kind, title=F.lit(None), version=F.lit(None), old=F.lit(None), new=F.lit(None), pr=F.lit(None): F.struct(
        F.lit(kind).alias("kind"), title.cast("string").alias("title"), version.cast("string").alias("version"), old.cast("string").alias("from_version"), new.cast("string").alias("to_version"), pr.cast("long").alias("pr"))
    guide = r"^content/learn/migration-guides/(\d+\.\d+)-to-(\d+\.\d+)\.md$"
    entry = r"^release-content/(\d+\.\d+)/migration-guides/(?:(\d+)_)?(.+)\.md$"
    notes = r"^release-content/(\d+\.\d+)/release-notes/(?:\d+_)?(.+)\.md$"
    g = lambda rx, i: F.regexp_extract(p, rx, i)
    words = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    rule = F.when(p.rlike(guide), out("migration_guide", F.concat(F.lit("Migration guide "), g(guide, 1), F.lit(" -> "), g(guide, 2)), old=g(guide, 1), new=g(guide, 2)))
    rule = rule.when(p.startswith("content/learn/migration-guides/"), out("migration_guide", F.lit("Migration guides (index)")))
    rule = rule.when(p.rlike(entry), out("migration_entry", words(g(entry, 3)), g(entry, 1), pr=g(entry, 2).try_cast("long")))
    rule = rule.when(p.rlike(notes), out("release_notes", words(g(notes, 2)), g(notes, 1)))
    for prefix, kind in (("content/learn/book/", "book"), ("content/learn/quick-start/", "tutorial"), ("content/learn/advanced-examples/", "tutorial"), ("content/learn/", "guide")):
        rule = rule.when(p.startswith(prefix), out(kind))
    rule = rule.when(p.startswith("content/faq"), out("faq", F.lit("FAQ")))
    for prefix, kind in (("content/news/", "news"), ("content/foundation", "foundation"), ("content/donate", "donate"), ("content/sponsorship-pledge", "sponsorship")):
        rule = rule.when(p.startswith(prefix), out(kind))
    return rule.otherwise(out("doc"))


def numbered_lines(pages: DataFrame, key: str, body: str) -> DataFrame:
    """key, pos, line, fence (opens or closes a code block), inside (an odd number of fences before)."""
    lines = pages.select(key, F.posexplode(F.split(body, "\n", -1)).alias("pos", "line"))
    fence = F.trim("line").startswith("```") | F.trim("line").startswith("~~~")
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # one page
    lines = lines.withColumn("fence", fence)
    return lines.withColumn("inside", F.coalesce(F.sum(F.col("fence").cast("int")).over(w), F.lit(0)) % 2 == 1)


def chunks(pages: DataFrame, key: str, body: str) -> DataFrame:
    """key, section, line_start (from 1), heading, breadcrumb, text; sections under SMALLEST bytes are dropped, longer ones
    cut at LARGEST; a page with one chunk or none stays whole, cut at WHOLE, without heading."""
    lines = numbered_lines(pages, key, body)
    level = F.when(~F.col("inside"), F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))).otherwise(0)
    lines = lines.withColumn("level", level)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(w))
    heads = F.filter(F.array_sort(F.collect_list(F.when(F.col("level") > 0, F.struct("pos", "level", F.trim(F.regexp_replace("line", r"^#+\s+|\s+#+\s*$", "")).alias("name")))).over(w)), lambda x: x.isNotNull())
    lines = lines.withColumn("heads", F.when(F.col("level") > 0, heads))
    s = lines.groupBy(key, "section").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("pos", "line")))), lambda x: x["line"]), "\n").alias("text"),
        F.first("heads", ignorenulls=True).alias("heads"), (F.min("pos") + 1).alias("line_start"),
    )
    empty = F.array().cast("array<struct<level:int,name:string>>")
    stack = F.aggregate("heads", empty, lambda a, h: F.concat(F.filter(a, lambda x: x["level"] < h["level"]), F.array(F.struct(h["level"].alias("level"), h["name"].alias("name")))))
    s = s.withColumn("stack", F.coalesce(stack, empty)).withColumn("text", X.truncate_bytes(F.regexp_replace("text", r"^\s+|\s+$", ""), LARGEST))
    s = s.where(F.octet_length("text") >= SMALLEST)
    s = s.withColumn("n", F.count("*").over(Window.partitionBy(key)))
    many = s.where("n > 1").select(key, "section", "line_start", F.try_element_at("stack", F.lit(-1))["name"].alias("heading"), F.transform("stack", lambda x: x["name"]).alias("breadcrumb"), "text")
    whole = pages.join(many.select(key).distinct(), key, "left_anti")
    whole = whole.select(key, F.lit(0).cast("long").alias("section"), F.lit(1).alias("line_start"), F.lit(None).cast("string").alias("heading"), F.lit(None).cast("array<string>").alias("breadcrumb"), X.truncate_bytes(F.trim(body), WHOLE).alias("text"))
    return many.unionByName(whole)


# Tags of example paths: folders or files, and words anywhere in the path.
TAGS = {
    "2d": (["/2d/"], []), "3d": (["/3d/"], []), "ui": (["/ui/", "/ui.rs"], []), "input": (["/input/", "/input.rs"], ["keyboard", "mouse", "gamepad"]),
    "audio": (["/audio/", "/audio.rs"], []), "assets": (["/asset/"], ["assets"]), "ecs": (["/ecs/"], ["system", "schedule", "query", "component"]),
    "state": (["/state/", "/state.rs"], []), "time": (["/time/"], ["timer"]), "window": (["/window/", "/window.rs"], []), "render": (["/render/"], ["camera", "material", "mesh"]),
    "scene": (["/scene/"], ["gltf", "scn"]), "gizmos": (["/gizmo"], []), "animation": (["/animation/"], ["animat"]), "lighting": (["/light"], []),
    "text": (["/font", "/text.rs"], ["ui_text"]), "transforms": (["/transform"], []), "diagnostics": (["/diagnostic"], ["error"]), "math": (["/math/"], []),
    "observers": (["/ecs/observer"], ["observ"]),
}


def categorise(path: Column | str) -> Column:
    c = X.col(path)
    p = F.when(c.startswith("/"), c).otherwise(F.concat(F.lit("/"), c))
    hit = lambda words: reduce(lambda x, y: x | y, (p.contains(w) for w in words))
    return F.array_compact(F.array(*(F.when(hit(a + b), F.lit(tag)) for tag, (a, b) in TAGS.items())))


def module_doc(code: Column | str) -> Column:
    """The //! lines at the very top without their marks; empty lines between them are skipped."""
    block = F.regexp_extract(X.col(code), r"\A((?:[ \t]*//![^\n]*(?:\n|\z)(?:[ \t\r]*\n)*)+)", 1)
    lines = F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*//!([^\n]*)$"), F.lit(1))
    return F.regexp_replace(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), "\n"), r"^\s+|\s+$", "")
