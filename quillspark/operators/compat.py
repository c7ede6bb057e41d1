"""Version queries: requirement range join, verdicts, migrations, fallback, API diff, releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import versions as V
from .intervals import interval_join


def kleene_or(verdict: Column) -> Column:
    """true if any is, else null if any is unknown, else false."""
    return F.when(F.bool_or(verdict), True).when(F.bool_or(verdict.isNull()), F.lit(None).cast("boolean")).otherwise(False)


def range_join(versions: DataFrame, requirements: DataFrame) -> DataFrame:
    """version, requires of every pair of distinct values in which the version lies in the requirement's range, by an
    interval join. A requirement that isn't understood pairs with none; ``requirement`` tells which those are."""
    v = versions.select("version").where("version IS NOT NULL").distinct().withColumn("_v", V.core("version"))
    r = requirements.select("requires").distinct().withColumn("_r", V.requirement("requires"))
    r = r.where("_r IS NOT NULL").select("requires", F.col("_r.lo").alias("_lo"), F.col("_r.hi").alias("_hi"))
    return interval_join(v, "_v", r, "_lo", "_hi", V.place).select("version", "requires")


def matrix(asked: DataFrame, compat: DataFrame) -> DataFrame:
    """plugin, version, compatible (null: unknown), newest, newest_matching, matching, for each distinct question (plugin,
    version): over the plugin's releases (``compat``: plugin, plugin_version, requires, ord) by an equi-join on the plugin. A
    plugin without releases gives no row; without a version every verdict is unknown and nothing matches."""
    q = asked.select("plugin", "version").distinct().withColumn("_v", F.when(F.col("version").isNotNull(), V.core("version")))
    c = compat.withColumn("_r", V.requirement("requires")).withColumn("_at", V.core("plugin_version"))  # once a release
    inside = (F.col("_v") >= F.col("_r.lo")) & (F.col("_r.hi").isNull() | (F.col("_v") < F.col("_r.hi")))
    j = q.join(c, "plugin").withColumn("ok", F.when(F.col("_r").isNotNull() & F.col("_v").isNotNull(), inside))
    newest = lambda cond: F.max_by(F.when(cond, F.col("plugin_version")), F.when(cond, F.struct("_at", "ord")))
    fits = F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("ord", "plugin_version"))))  # a plugin's releases
    out = j.groupBy("plugin", "version").agg(kleene_or(F.col("ok")).alias("compatible"), newest(F.lit(True)).alias("newest"), newest(F.col("ok")).alias("newest_matching"), fits.alias("_f"))
    return out.withColumn("matching", F.array_join(F.transform("_f", lambda x: x["plugin_version"]), ",")).drop("_f")


def fallback(requests: DataFrame, installed: DataFrame) -> DataFrame:
    """Each request (column ``wanted``) with ``version``: the installed version of that name, else the newest of its minor
    line, of versions with equal numbers the last text; null where the line has none. Only a request that begins with two
    numbers and dots has a line: 0.-5.2 and junk aren't of 0.0. The newest is found once a line, before requests are joined,
    so that requests needn't be sorted within their line."""
    have, core = installed.select("version").where("version IS NOT NULL").distinct(), V.core("version")
    newest = have.groupBy(core["major"].alias("_major"), core["minor"].alias("_minor")).agg(F.max(F.struct(core["patch"].alias("patch"), "version"))["version"].alias("_newest"))
    parts = F.split("wanted", r"\.")
    number = lambda i: F.when(F.get(parts, F.lit(i)).rlike(r"^\d+\z"), F.get(parts, F.lit(i)).try_cast("bigint"))
    near = requests.withColumns({"_major": number(0), "_minor": number(1)}).join(newest, ["_major", "_minor"], "left")
    exact = have.select(F.col("version").alias("_exact"))
    out = near.join(exact, F.col("wanted") == F.col("_exact"), "left")
    return out.withColumn("version", F.coalesce("_exact", "_newest")).drop("_major", "_minor", "_newest", "_exact")


def api_diff(asked: DataFrame, items: DataFrame, symbol: str = "symbol") -> DataFrame:
    """For each symbol and each of the versions asked for (``asked``: symbol, version): its best item's signature against
    that of the newest of those versions: same, changed, only here (the newest has none), or - (this one has none)."""
    best = items.groupBy(symbol, "version").agg(F.min_by(F.struct("kind", "signature", F.length("docs").alias("docs_chars")), "ord").alias("b"))
    j = asked.select(symbol, "version").distinct().join(best, [symbol, "version"], "left").withColumn("_v", V.core("version"))
    w = Window.partitionBy(symbol).orderBy(F.desc("_v"), F.desc("version")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row a version
    j = j.withColumn("_base", F.first(F.struct("b.signature")).over(w)["signature"])
    verdict = F.when(F.col("b").isNull(), "-").when(F.col("_base").isNull(), "only here").when(F.col("b.signature") == F.col("_base"), "same").otherwise("changed")
    return j.select(symbol, "version", F.col("b").isNotNull().alias("found"), "b.kind", "b.signature", "b.docs_chars", verdict.alias("vs_newest"))


def newest_release(index: DataFrame) -> DataFrame:
    """name, stable, preview: the newest release that wasn't yanked, and a pre-release only if it is newer. Of releases with
    equal numbers the last text counts, so that the answer doesn't depend on the order of rows."""
    pre = F.col("vers").contains("-")
    live = index.where("NOT yanked")
    pick = lambda cond: F.max(F.when(cond, F.struct(V.core("vers").alias("core"), "vers")))["vers"]
    out = live.groupBy("name").agg(pick(~pre).alias("stable"), pick(pre).alias("p"))
    newer = F.col("stable").isNull() | (V.core("p") > V.core("stable"))
    return out.select("name", "stable", F.when(newer, F.col("p")).alias("preview"))


def top_releases(index: DataFrame, dependency: str, n: int = 24) -> DataFrame:
    """The newest ``n`` releases of each name that depend on ``dependency`` (or, failing that, on one of its parts)."""
    own = F.filter("deps", lambda d: d["name"] == dependency)
    part = F.filter("deps", lambda d: d["name"].startswith(f"{dependency}_"))
    req = F.coalesce(F.get(own, F.lit(0))["req"], F.get(part, F.lit(0))["req"])
    live = index.where("NOT yanked AND NOT contains(vers, '-')").withColumn("requires", req).where("requires IS NOT NULL")
    w = Window.partitionBy("name").orderBy(V.core("vers").desc(), "vers")
    return live.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= n).select("name", "vers", "requires", "ord")


def release_decision(pairs: DataFrame) -> DataFrame:
    """What an installed corpus is to the one on offer: reason and update_available (null: unknown)."""
    a, b = V.core("installed"), V.core("available")
    reason = (
        F.when(F.col("offline"), "offline").when(F.col("error").isNotNull(), "network_error").when(F.col("available").isNull(), "unavailable")
        .when(F.col("installed").isNull(), "missing").when(a < b, "corpus").when(a > b, "installed_newer")
        .when(F.col("installed_revision").isNull() | F.col("available_revision").isNull(), "revision_unknown")
        .when(F.col("installed_revision") < F.col("available_revision"), "revision").otherwise("current")
    )
    out = pairs.withColumn("reason", reason)
    r = F.col("reason")
    return out.withColumn("update_available", F.when(r.isin("missing", "corpus", "revision"), True).when(r.isin("installed_newer", "current"), False))


def topic_score(terms: list[str]) -> Column:
    """40: a heading is the topic; 30: it has all terms; 8 for each it has; else 4 for the topic in the text, 1 for each term."""
    full = " ".join(terms)
    head = F.lower(F.concat_ws(" ", "title", "heading", F.array_join("breadcrumb", " ")))
    docs = F.lower("docs")
    n = sum((F.when(head.contains(t), 1).otherwise(0) for t in terms), F.lit(0))
    text = F.when(docs.contains(full), 4).otherwise(sum((F.when(docs.contains(t), 1).otherwise(0) for t in terms), F.lit(0)))
    return (F.when(head.contains(full), 40).when(n == len(terms), 30).otherwise(8 * n) + text).cast("int")


def in_range(old: str, new: str) -> Column:
    """Whether a step's versions lie between two: old <= from < to <= new."""
    f, t = V.core("from_version"), V.core("to_version")
    known = F.col("from_version").isNotNull() & F.col("to_version").isNotNull()
    return known & (V.core(F.lit(old)) <= f) & (f < t) & (t <= V.core(F.lit(new)))


def migration_base(old: str | None, new: str | None) -> Column:
    """Base score of guides, entries and notes for a step between minor lines; null: doesn't apply."""
    minor = lambda c: F.substring_index(c, ".", 2)
    is_from = minor(F.col("from_version")) == minor(F.lit(old)) if old else F.lit(False)
    is_to = minor(F.col("to_version")) == minor(F.lit(new)) if new else F.lit(False)
    here = minor(F.col("version")) == minor(F.lit(new)) if new else F.lit(False)
    inside = in_range(old, new) if old and new else F.lit(False)
    guide = F.when(is_from & is_to, 100).when(is_to, 90).when(inside, 80).when(is_from, 70)
    return F.when(F.col("kind") == "migration_guide", guide).when((F.col("kind") == "migration_entry") & here, 50).when((F.col("kind") == "release_notes") & here, 45)


def migrations(records: DataFrame, old: str | None, new: str | None, topic: list[str] | None = None, per_doc: int = 3) -> DataFrame:
    """Records with ``score``, best first, at most ``per_doc`` chunks of a document."""
    r = records.withColumn("base", migration_base(old, new)).where("base IS NOT NULL").withColumn("topic", topic_score(topic) if topic else F.lit(0))
    if topic:
        best = r.agg(F.max("topic").alias("_best"))
        r = r.where("topic > 0").crossJoin(F.broadcast(best)).where("_best < 20 OR topic >= 20").drop("_best")
    r = r.withColumn("score", F.col("base") + F.col("topic"))
    w = Window.partitionBy("full_path").orderBy(F.desc("score"), "dense_id")
    return r.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_doc).drop("_n", "base", "topic").orderBy(F.desc("score"), "dense_id")
