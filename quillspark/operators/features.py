"""Feature graphs: closure, what stays off, and what a query's name depends on."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir


class _Rounds:
    """Tables of the rounds of a fixpoint, written to the shared folder, so that no round computes those before again."""

    def __init__(self, rows: DataFrame):
        self.spark, self.root, self.n = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/closure-{uuid.uuid4().hex}", 0

    def save(self, rows: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def all(self, *parts: str) -> DataFrame:
        return self.spark.read.parquet(*parts)


def project_closure(features: DataFrame, profiles: DataFrame, vendored: DataFrame, explicit: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """name, depth, rule of everything that a project enables: from ``explicit`` (name) and, with ``defaults`` (name, which adds the
    feature ``default`` too), over three relations (src, dst) at once. ``rule``: explicit, default, or the relation that
    added the name first, feature before profile before vendored.

    Semi-naive: a round joins only the names of the round before, and each round is a written table. Cycles and self-loops
    end, as a name is new only once; there are as many rounds as the longest shortest path has steps.
    """
    rounds = _Rounds(features)
    ranked = {"feature": features, "profile": profiles, "vendored": vendored}
    every = rounds.save(reduce(DataFrame.unionByName, (e.select("src", "dst", F.lit(k).alias("place")) for k, e in enumerate(ranked.values()))).where("src <> dst").distinct())
    start = explicit.select("name", F.lit(-2).alias("place"))
    if defaults is not None:
        more = defaults.select("name").unionByName(features.sparkSession.range(1).select(F.lit("default").alias("name")))
        start = start.unionByName(more.select("name", F.lit(-1).alias("place")))
    frontier = rounds.save(start.groupBy("name").agg(F.min("place").alias("place")).withColumn("depth", F.lit(0)))
    reached = [frontier]
    while not frontier.isEmpty():
        step = frontier.select("name", "depth").join(every, F.col("name") == F.col("src")).groupBy(F.col("dst").alias("name")).agg(F.min("place").alias("place"), (F.max("depth") + 1).alias("depth"))
        known = reduce(DataFrame.unionByName, (r.select("name") for r in reached))
        frontier = rounds.save(step.join(known, "name", "left_anti"))
        reached.append(frontier)
    rule = F.element_at(F.array(*map(F.lit, ["explicit", "default", *ranked])), F.col("place") + 3)
    return reduce(DataFrame.unionByName, reached).select("name", F.col("depth").cast("int").alias("depth"), rule.alias("rule"))


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Names reachable from ``seeds`` (name) over ``edges`` (src, dst), seeds included."""
    none = edges.where("false")
    return project_closure(edges, none, none, seeds).select("name")


def closures(edges: DataFrame) -> DataFrame:
    """src, dst of every pair with a path between different nodes, by doubling: paths of length up to 2**k in k rounds, each a
    written table. The result has a row a pair, so it is for manifests, not for large graphs."""
    rounds = _Rounds(edges)
    pairs = rounds.save(edges.where("src <> dst").select("src", "dst").distinct())
    n = pairs.count()
    while True:
        two = pairs.alias("a").join(pairs.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst").where("src <> dst")
        more = rounds.save(pairs.unionByName(two).distinct())
        m = more.count()
        if m == n:
            return pairs
        pairs, n = more, m


def disabled(known: DataFrame, enabled: DataFrame) -> DataFrame:
    return known.select("name").distinct().join(enabled, "name", "left_anti")


def report(known: DataFrame, explicit: DataFrame, enabled: DataFrame) -> DataFrame:
    """name, state of every known feature: explicit, transitive or disabled; and of explicit names that nobody knows: unknown."""
    k = known.select("name").distinct().withColumn("known", F.lit(True))
    e = explicit.select("name").distinct().withColumn("explicit", F.lit(True))
    on = enabled.select("name").distinct().withColumn("on", F.lit(True))
    state = F.when(F.col("known").isNull(), "unknown").when(F.col("explicit"), "explicit").when(F.col("on"), "transitive").otherwise("disabled")
    return k.join(e, "name", "full_outer").join(on, "name", "left").select("name", state.alias("state"))


def substrings(c: str) -> Column:
    """All different substrings of a name."""
    return F.array_distinct(F.expr(f"flatten(transform(sequence(1, length({c})), i -> transform(sequence(1, length({c}) - i + 1), n -> substr({c}, i, n))))"))


def check(queries: DataFrame, features: DataFrame, enabled: DataFrame, subcrates: DataFrame, gates: DataFrame, prefix: str, resolved: bool = True) -> DataFrame:
    """query, rule, name, gating_feature, available (null: unknown) for each distinct query, by the first rule that fits:

    1. the two plugin groups: DefaultPlugins by the feature ``default``, MinimalPlugins always;
    2. a known feature; 3. a known feature after ``prefix`` and _;
    4. a path ``prefix``::part..., which ends here: its sub-crate (``subcrates``: crate, optional, features) is there always, by
       any of its features, or unknown if it has none; without an entry its own feature decides, or it is unknown;
    5. the first gate (``gates``: ord, plugin, requires_feature) whose plugin's name holds the query or is held by it;
    else unrecognised, not available. Where the project's features aren't ``resolved``, what is not available is unknown.

    Names are matched by equi-joins; for rule 5 on the substrings of the short names of both sides.
    """
    q = queries.select("query").where("query IS NOT NULL AND query <> ''").distinct()
    known = features.select(F.col("name").alias("known")).distinct()
    on = enabled.select(F.col("name").alias("on")).distinct()
    columns = lambda place, rule, name, gate, need: [F.col("query"), F.lit(place).alias("place"), F.lit(0).cast("long").alias("ord"), F.lit(rule).alias("rule"), name.alias("name"), gate.alias("gating_feature"), need.alias("need")]
    none, listed = F.lit(None).cast("string"), lambda c: F.array(c)
    always, never = F.array().cast("array<string>"), F.lit(None).cast("array<string>")  # need: any of these features; []: none needed; null: unknown
    prefixed = F.concat(F.lit(f"{prefix}_"), F.col("query"))
    crate = F.when(F.col("query").rlike(f"^{prefix}::[a-z0-9_]+(::.*)?$"), F.concat(F.lit(f"{prefix}_"), F.regexp_extract("query", f"^{prefix}::([a-z0-9_]+)", 1)))
    found = [
        q.where("query = 'DefaultPlugins'").select(*columns(0, "plugin group", F.col("query"), F.lit("default"), listed(F.lit("default")))),
        q.where("query = 'MinimalPlugins'").select(*columns(0, "plugin group", F.col("query"), none, always)),
        q.join(known, F.col("query") == F.col("known")).select(*columns(1, "feature", F.col("known"), none, listed(F.col("known")))),
        q.join(known, prefixed == F.col("known")).select(*columns(2, "prefixed feature", F.col("known"), F.col("known"), listed(F.col("known")))),
    ]
    paths = q.withColumn("_crate", crate).where("_crate IS NOT NULL").join(subcrates.select(F.col("crate").alias("_crate"), "optional", "features"), "_crate", "left").join(known, F.col("_crate") == F.col("known"), "left")
    need = F.when(~F.col("optional"), always).when(F.col("optional") & (F.size("features") > 0), F.col("features")).when(F.col("optional").isNull() & F.col("known").isNotNull(), listed(F.col("known"))).otherwise(never)
    gate = F.when(F.col("optional") & (F.size("features") > 0), F.get("features", F.lit(0))).when(F.col("optional").isNull(), F.col("known"))
    found.append(paths.select(*columns(3, "sub-crate", F.col("_crate"), gate, need)))
    g = gates.select("ord", "plugin", "requires_feature").where("plugin <> ''")
    holds = q.join(g.withColumn("query", F.explode(substrings("plugin"))), "query")
    held = q.withColumn("plugin", F.explode(substrings("query"))).join(g, "plugin").select("query", "ord", "plugin", "requires_feature")
    both = holds.select("query", "ord", "plugin", "requires_feature").unionByName(held)
    found.append(both.select(F.col("query"), F.lit(4).alias("place"), F.col("ord").cast("long").alias("ord"), F.lit("plugin").alias("rule"), F.col("plugin").alias("name"), F.col("requires_feature").alias("gating_feature"), listed(F.col("requires_feature")).alias("need")))
    best = reduce(DataFrame.unionByName, found).groupBy("query").agg(F.min_by(F.struct("rule", "name", "gating_feature", "need"), F.struct("place", "ord", "name")).alias("b"))
    j = q.join(best, "query", "left").select("query", F.coalesce("b.rule", F.lit("unrecognised")).alias("rule"), "b.name", "b.gating_feature", F.col("b.need").alias("need"))
    met = j.select("query", F.explode("need").alias("on")).join(on, "on", "left_semi").select("query").distinct().withColumn("met", F.lit(True))
    state = F.when(F.col("rule") == "unrecognised", False).when(F.col("need").isNull(), F.lit(None)).otherwise((F.size("need") == 0) | F.coalesce("met", F.lit(False)))
    if not resolved:
        state = F.when(state, True).when(F.col("rule") == "unrecognised", False)
    return j.join(met, "query", "left").select("query", "rule", "name", "gating_feature", state.alias("available"))
