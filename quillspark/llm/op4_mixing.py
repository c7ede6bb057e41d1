"""Mixing sources to target weights: hierarchical budgets over a domain > language > source tree.

A budget of tokens runs down the tree. Every node splits what it got among its children by weight, but no child
takes more than its capacity (tokens x ``max_epochs`` of the leaves below it). What a full child can't take goes
to its siblings by weight; only when all of them are full is the node itself full, and then its parent has
already counted that in the node's capacity: shortages move to siblings before ancestors. The split of a
node is the water level L with sum(min(capacity, L x weight)) = budget, found exactly from the children in order of
capacity / weight. Each leaf then reads its documents in seeded epochs, every epoch a permutation by
hash(seed, epoch, document), and takes the prefix whose tokens fit the leaf's budget.

The prefix of the last epoch is found without sorting a leaf: tokens are summed by the first eight bits of the
hash, then by the next eight within the bucket that holds the cut, and only the rows of that sub-bucket (about one
in 65,536 of the leaf) are put in order.

Cases: null text has no tokens; documents without tokens are never drawn. Null keys are leaves of their own.
Leaves with weight 0 or less get nothing. Equal rows of a leaf (id and text) are one unit: taken together or not, each with the
same ``copies``; equal rows of different leaves are drawn by their own leaf's budget. Rows without an id are told apart by
their texts. Very long texts only count their tokens. A column named ``copies`` of the input is replaced; other columns stay. Budgets above the whole capacity give every epoch of every leaf. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Tables, join_small

LEVELS = ["domain", "lang", "source"]


def _hash32(seed: int, epoch: Column) -> Column:
    """32 bits from SHA-256, so that any SQL engine gives the same order."""
    key = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text"), F.col("th").cast("string"))))
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")


def _split(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``share`` to nodes with weight, cap and the parent's ``budget``: the water level of each family.

    A family is the children of one node of the tree, a table of tree nodes, not of documents.
    """
    open_ = (F.col("weight") > 0) & (F.col("cap") > 0)
    family = Window.partitionBy(*(F.coalesce(F.col(p), F.lit("\0")) for p in parent)) if parent else Window.partitionBy(F.lit(0))
    n = nodes.withColumn("r", F.when(open_, F.col("cap") / F.when(open_, F.col("weight"))))
    order = family.orderBy(F.col("r").asc_nulls_last(), *(F.coalesce(F.col(c), F.lit("\0")) for c in LEVELS if c in nodes.columns))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = F.when(open_, F.col("weight"))
    n = n.withColumn("full_before", F.coalesce(F.sum(F.when(open_, F.col("cap"))).over(upto) - F.col("cap"), F.lit(0)))
    n = n.withColumn("w_rest", F.sum(w).over(rest))
    # The level if just the children before this one are full; the first child that stays below its capacity sets it.
    n = n.withColumn("level", F.when(open_, (F.col("budget") - F.col("full_before")) / F.when(open_, F.col("w_rest"))))
    n = n.withColumn("water", F.min(F.when(F.col("level") <= F.col("r"), F.struct("r", "level"))).over(family)["level"])
    cap = F.col("cap").cast("double")
    filled = F.when(F.col("water").isNull(), cap).otherwise(F.least(cap, F.greatest(F.col("water"), F.lit(0.0)) * F.col("weight")))
    share = F.when(open_, filled).otherwise(0.0)
    return n.withColumn("share", share).drop("r", "full_before", "w_rest", "level", "water")


def leaf_budgets(leaves: DataFrame, weights: DataFrame | None, total: float, max_epochs: int = 4) -> DataFrame:
    """``leaves``: domain, lang, source, tokens. ``weights``: level, domain, lang, source (null where the level has
    none), weight; nodes that it doesn't name weigh 1. Returns domain, lang, source, tokens, budget (long)."""
    cap = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    budgets = None
    for depth in range(1, len(LEVELS) + 1):
        keys = LEVELS[:depth]
        level = cap.groupBy(*keys).agg(F.sum("cap").alias("cap"))
        if weights is None:
            level = level.withColumn("weight", F.lit(1.0))
        else:
            w = weights.where(F.col("level") == LEVELS[depth - 1]).select(*(F.col(k).alias(f"_{k}") for k in keys), "weight")
            same = [level[k].eqNullSafe(F.col(f"_{k}")) for k in keys]
            level = level.join(w, same, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))).drop(*(f"_{k}" for k in keys))
        if budgets is None:
            level = level.withColumn("budget", F.lit(float(total)))
        else:
            up = budgets.select(*(F.col(k).alias(f"_{k}") for k in keys[:-1]), F.col("share").alias("budget"))
            level = level.join(up, [level[k].eqNullSafe(F.col(f"_{k}")) for k in keys[:-1]]).drop(*(f"_{k}" for k in keys[:-1]))
        budgets = _split(level, keys[:-1])
    tokens = leaves.select(*(F.col(k).alias(f"_{k}") for k in LEVELS), "tokens")
    out = budgets.join(tokens, [budgets[k].eqNullSafe(F.col(f"_{k}")) for k in LEVELS])
    return out.select(*LEVELS, "tokens", F.floor(F.col("share") + 1e-6).cast("long").alias("budget"))


def mix(docs: DataFrame, total_share: float = 1.0, max_epochs: int = 4, weights: DataFrame | None = None, seed: int = 17) -> DataFrame:
    """``docs`` needs domain, lang, source, doc_id, text; adds ``copies`` (long, 1 or more: times it is drawn).

    The budget is ``total_share`` x all tokens. Documents that aren't drawn are absent: the mixture's purpose.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "mix")
    tokens = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), "[ \\t-\\r]+", -1), "")).cast("long")
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(c)  # noqa: E731  never null
    # equal rows of a leaf are one unit from here on
    unit = [*LEVELS, "doc_id", "th"]
    rows = docs.select("doc_id", *(key(c) for c in LEVELS), tokens.alias("tok"), F.xxhash64("text").alias("th")).where("tok > 0")
    rows = tables.save(rows.groupBy(*unit).agg(F.sum("tok").alias("tok")), "tokens")
    leaves = tables.save(rows.groupBy(*LEVELS).agg(F.sum("tok").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    if weights is not None:
        weights = weights.withColumns({c: F.when(F.col("level").isin(LEVELS[LEVELS.index(c):]), F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))) for c in LEVELS})
    plan = leaf_budgets(leaves, weights, total * total_share, max_epochs)
    # Whole epochs, and what is left for the prefix of one more.
    plan = plan.withColumn("whole", F.floor(F.col("budget") / F.col("tokens"))).withColumn("left", F.col("budget") - F.col("whole") * F.col("tokens"))
    plan = tables.save(plan.select(*LEVELS, "whole", "left"), "plan")
    r = join_small(rows, plan, LEVELS, "th").withColumn("h", _hash32(seed, F.col("whole")))
    r = tables.save(r, "hashed")
    cut, todo, done = None, r, None
    for shift, name in ((24, "b1"), (16, "b2")):
        keys = LEVELS + ([] if cut is None else ["b1"])
        todo = todo.withColumn(name, F.shiftright("h", shift))
        sums = todo.groupBy(*keys, "left", name).agg(F.sum("tok").alias("t"))  # at most 256 rows a leaf
        w = Window.partitionBy(*keys).orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.sum("t").over(w))
        whole = tables.save(sums.groupBy(*keys, "left").agg(F.min(F.when(F.col("upto") > F.col("left"), F.struct(F.col(name), (F.col("left") - F.col("upto") + F.col("t")).alias("rest")))).alias("c")), f"cut-{name}")
        j = join_small(todo.drop("left"), whole, keys, "th")
        sure = j.where(F.col("c").isNull() | (F.col(name) < F.col("c")[name])).select(*unit, F.lit(1).cast("long").alias("copies"))
        done = sure if done is None else done.unionByName(sure)
        todo = j.where(F.col(name) == F.col("c")[name]).withColumn("left", F.col("c.rest")).drop("c")
        cut = name
    w = Window.partitionBy(*LEVELS).orderBy("h", "doc_id", "th").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = todo.withColumn("upto", F.sum("tok").over(w)).where("upto <= left").select(*unit, F.lit(1).cast("long").alias("copies"))
    drawn = done.unionByName(last).unionByName(r.where("whole > 0").select(*unit, F.col("whole").alias("copies"))).groupBy(*unit).agg(F.sum("copies").alias("copies"))
    drawn = drawn.select(*(F.col(c).alias(f"_q4_{c}") for c in unit), "copies")
    out = docs.drop("copies") if "copies" in docs.columns else docs
    same = [key(c) == F.col(f"_q4_{c}") for c in LEVELS] + [out["doc_id"].eqNullSafe(F.col("_q4_doc_id")), F.xxhash64(out["text"]) == F.col("_q4_th")]
    return out.join(drawn, same).drop(*(f"_q4_{c}" for c in unit))


def domain_of(source: str = "source") -> Column:
    """The test tables have no domain: their sources are dealt to three by the number in the name (0 without one)."""
    n = F.coalesce(F.try_to_number(F.regexp_extract(F.col(source), "([0-9]{1,9})$", 1), F.lit("999999999")).cast("int"), F.lit(0))
    return F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("forum")), n % 3 + 1)


def default_weights(spark: SparkSession) -> DataFrame:
    """Target weights of the domains and languages; languages and sources that aren't named weigh 1."""
    rows = [("domain", "web", None, None, 5.0), ("domain", "books", None, None, 3.0), ("domain", "forum", None, None, 2.0)]
    rows += [("lang", d, "en", None, 2.0) for d in ("web", "books", "forum")]
    return spark.createDataFrame(rows, "level string, domain string, lang string, source string, weight double")


def mixture(docs: DataFrame) -> DataFrame:
    """``docs`` with ``copies``, mixed by the default weights; a column named domain is replaced meanwhile."""
    had = "domain" in docs.columns
    d = docs.withColumnRenamed("domain", "_q4_domain") if had else docs
    out = mix(d.withColumn("domain", domain_of()), 1.0, 4, default_weights(docs.sparkSession)).drop("domain")
    return out.withColumnRenamed("_q4_domain", "domain") if had else out


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at least once, with ``copies``."""
    return mixture(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "lang", "source", "copies")
