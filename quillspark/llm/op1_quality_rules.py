"""Quality rules: base rules and robust multivariate outliers by language and source.

Statistics of whole texts are turned into a vector, shrunk towards the medians of the document's group so that
short texts don't look odd by chance. For each (lang, source) the minimum covariance determinant is sought by
concentration steps from several deterministic starts (as in DetMCD): each step keeps the ``h`` share of rows
with the least Mahalanobis distance and estimates centre and scatter from them anew; the start that ends in the
least determinant wins; each start of a group takes steps of its own until its log determinant falls by less than 0.001, as
the sketched quantile of a large group keeps its determinant moving by a row or two and would keep all others going. A variance below the statistic's resolution (a statistic that is
zero in most texts has none) is raised to it, so that the scatter isn't singular; variances above it and all covariances are the
estimate's own. Rows beyond the chi-square cutoff are rejected. Everything is DataFrame expressions: the Cholesky
factor of the p x p scatter is written out as columns of the small table of groups.

Cases: null or empty text has no words, fails the base rules and stays out of the estimates. Null lang or source
is a group like any other. Groups under ``min_group`` rows are pooled by language, then all together; where these
leftovers are still too few, each is judged by the estimate of its whole language (large groups too), or of the whole table
if the language is too small. A table of fewer rows rejects nothing. Repeated rows and repeated ids are judged row by row. An empty table gives an
empty result. Other columns of the input are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Tables, join_small

SPACE = "[ \\t-\\r]"
#: Features and their resolution: the least standard deviation that a scatter may have.
FLOOR = {"x_len": 0.01, "x_sym": 0.08, "x_upper": 0.01, "x_dup": 0.12, "x_rep": 0.12}
#: How many words, letters or lines of the group's median each text is given besides its own.
PRIOR = {"x_len": 100, "x_sym": 30, "x_upper": 600, "x_dup": 3, "x_rep": 30}
X = list(FLOOR)
P = len(X)
#: Medians of chi-square with one to five degrees of freedom, and its 0.999 quantile with five.
CHI2_MEDIAN, CHI2_CUT = (0.4549, 1.3863, 2.3660, 3.3567, 4.3515), 20.515
STARTS = 3


def text_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper and n_lines of each row's whole text."""
    t = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    t = t.withColumn("_s", F.split("_t", SPACE, -1)).withColumn("_w", F.array_remove("_s", ""))
    t = t.withColumn("_lines", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike("[^ \\t-\\r]")))
    w = F.col("_w")
    window = lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, 5)))
    n = F.size("_w")
    t = t.withColumn("_h", F.slice(F.transform(w, window), F.lit(1), F.greatest(n - 4, F.lit(0))))
    t = t.select(
        *keep, n.cast("long").alias("n_words"), (F.length("_t") - F.size("_s") + 1).cast("long").alias("word_chars"),
        (F.size(F.split("_t", "[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size(F.split("_t", "\\p{Lu}", -1)) - 1).cast("long").alias("n_upper"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        # only texts with a repeated window pay for the sort
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.col("_h")).alias("_h"),
    )
    t = t.withColumn("_o", F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    o = F.col("_o")
    twice = F.transform(o, lambda e, k: F.when((F.get(o, k - 1)["h"] == e["h"]) | (F.get(o, k + 1)["h"] == e["h"]), e["i"]))
    t = t.withColumn("_p", F.sort_array(F.array_compact(twice)))
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return t.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_h", "_o", "_p")


def _median(c: Column) -> Column:
    return F.percentile_approx(c, 0.5, 1000)


def _groups(stats: DataFrame, tables: Tables, min_group: int) -> DataFrame:
    """Each (lang, source) with the pool it is judged in, and pools it only lends its rows to (not ``judged``)."""
    n = tables.save(stats.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n")), "groups")
    by_lang = n.where(F.col("n") < min_group).groupBy("lang").agg(F.sum("n").alias("n_lang"))
    own, lang = F.to_json(F.struct(F.lit("g"), "lang", "source")), F.to_json(F.struct(F.lit("l"), "lang"))
    pool = F.when(F.col("n") >= min_group, own).when(F.col("n_lang") >= min_group, lang).otherwise(F.lit("all"))
    pools = tables.save(n.join(by_lang, "lang", "left").select("lang", "source", "n", pool.alias("g"), F.lit(True).alias("judged")), "pools")
    left = pools.where("g = 'all'")
    if (left.agg(F.sum("n")).first()[0] or min_group) >= min_group:
        return pools.drop("n")
    # Too few leftovers for an estimate of their own: that of all groups of the language, or of the table.
    whole = F.when(F.col("n_whole") >= min_group, F.to_json(F.struct(F.lit("w"), "lang"))).otherwise("table")
    left = left.join(n.groupBy("lang").agg(F.sum("n").alias("n_whole")), "lang").select("lang", "source", whole.alias("g"))
    left = tables.save(left, "leftovers")
    of_lang = n.join(left.where("g <> 'table'").select("lang", "g").distinct(), "lang").select("lang", "source", "g")
    of_table = n.crossJoin(left.where("g = 'table'").select("g").distinct()).select("lang", "source", "g")
    lent = of_lang.union(of_table).join(left, ["lang", "source", "g"], "left_anti").withColumn("judged", F.lit(False))
    own = pools.where("g <> 'all'").select("lang", "source", "g", "judged")
    return tables.save(own.union(left.withColumn("judged", F.lit(True))).union(lent), "pools-whole")


def _distance(x: list[Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution with the group's Cholesky factor."""
    z: list[Column] = []
    for i in range(P):
        s = x[i] - F.col(f"m{i}")
        for k in range(i):
            s = s - F.col(f"l{i}{k}") * z[k]
        z.append(s / F.col(f"l{i}{i}"))
    return sum((c * c for c in z[1:]), z[0] * z[0])


_SCATTER = [f"c{i}{j}" for i in range(P) for j in range(i + 1)]


def _factored(groups: DataFrame, correlated: bool = True) -> DataFrame:
    """Adds the Cholesky factor of the scatter with its floor (without covariances unless ``correlated``), log determinant, and
    ``free``: how many variances are above the floor."""
    out = groups
    for i in range(P):
        for j in range(i + 1):
            s = F.greatest(f"c{i}{j}", F.lit(FLOOR[X[i]] ** 2)) if i == j else F.col(f"c{i}{j}") * (1.0 if correlated else 0.0)
            for k in range(j):
                s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(s, F.lit(1e-9))) if i == j else s / F.col(f"l{j}{j}"))
    free = sum((F.when(F.col(f"c{i}{i}") > FLOOR[x] ** 2, 1).otherwise(0) for i, x in enumerate(X)), F.lit(0))
    return out.withColumns({"free": F.greatest(free, F.lit(1)), "logdet": sum((F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0))})


def _moments(rows: DataFrame, keys: list[str], correlated: bool) -> DataFrame:
    """Mean and scatter for each group, factored."""
    out = rows.groupBy(*keys).agg(
        *(F.avg(X[i]).alias(f"m{i}") for i in range(P)),
        *(F.covar_pop(X[i], X[j]).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)),
    )
    return _factored(out, correlated)


def judge(docs: DataFrame, h: float = 0.75, steps: int = 20, min_group: int = 50, cutoff: float = CHI2_CUT, correlated: bool = True) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed, distance2 (null where not judged) and kept, one row a document.

    ``steps``: concentration steps at most; a few do, as each lowers the determinant. ``correlated`` false leaves covariances out."""
    spark = docs.sparkSession
    tables = Tables(spark, "quality")
    # Keys that are never null: "=" and the value, or nothing.
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(c)
    stats = text_stats(docs.select("doc_id", "text", key("lang"), key("source")), ["doc_id", "lang", "source"])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = tables.save(stats.withColumn("base_failed", failed), "stats")
    rows = join_small(stats, _groups(stats, tables, min_group), ["lang", "source"], "doc_id", "left")
    nw, nl = F.col("n_words"), F.col("n_lines")
    ratio = {"x_len": (F.col("word_chars"), nw), "x_sym": (F.col("n_symbols"), nw), "x_upper": (F.col("n_upper"), F.col("word_chars")), "x_dup": (F.col("n_dup_lines"), nl), "x_rep": (F.col("n_repeat_words"), nw)}
    fit = rows.where("not base_failed")
    centre = tables.save(fit.groupBy("g").agg(*(_median(a / F.greatest(b, F.lit(1))).alias(f"p_{x}") for x, (a, b) in ratio.items())), "centre")
    v = join_small(rows, centre, ["g"], "doc_id", "left")
    shrunk = {x: (a + PRIOR[x] * F.col(f"p_{x}")) / (b + PRIOR[x]) for x, (a, b) in ratio.items()}
    v = v.withColumns({x: F.log(c + 0.01) if x == "x_len" else F.sqrt(c) for x, c in shrunk.items()}).drop(*(f"p_{x}" for x in X))
    v = tables.save(v, "vectors")
    fit = v.where("not base_failed").select("doc_id", "g", *X)
    med = tables.save(fit.groupBy("g").agg(*(_median(F.col(x)).alias(f"a_{x}") for x in X)), "median")
    dev = join_small(fit, med, ["g"], "doc_id")
    mad = tables.save(dev.groupBy("g").agg(*(F.max(f"a_{x}").alias(f"a_{x}") for x in X), *((1.4826 * _median(F.abs(F.col(x) - F.col(f"a_{x}")))).alias(f"s_{x}") for x in X)), "mad")
    z = [F.abs(F.col(x) - F.col(f"a_{x}")) / F.greatest(f"s_{x}", F.lit(FLOOR[x])) for x in X]
    first = F.array(sum((c * c for c in z[1:]), z[0] * z[0]), F.greatest(*z), sum(z[1:], z[0]))
    d = join_small(fit, mad, ["g"], "doc_id").select("doc_id", "g", *X, F.posexplode(first).alias("start", "d"))
    est = None
    for step in range(steps + 1):
        if step:
            d = join_small(fit, est.where("moving"), ["g"], "doc_id").withColumn("d", _distance([F.col(x) for x in X])).select("doc_id", "g", *X, "start", "d")
        # The h share of least distance, by a mergeable quantile sketch of all rows of the group.
        q = tables.save(d.groupBy("g", "start").agg(F.percentile_approx("d", h, 2000).alias("q")), f"q{step}")
        new, last = _moments(join_small(d, q, ["g", "start"], "doc_id").where("d <= q"), ["g", "start"], correlated), est
        if last is None:
            est = tables.save(new.withColumn("moving", F.lit(True)), f"est{step}")
            continue
        was = last.select("g", "start", F.col("logdet").alias("was"))
        new = new.join(was, ["g", "start"]).withColumn("moving", F.col("logdet") < F.col("was") - 1e-3).drop("was")
        est = tables.save(new.unionByName(last.where("not moving")), f"est{step}")
        if not est.where("moving").limit(1).count():
            break
    best = est.groupBy("g").agg(F.min(F.struct("logdet", "start")).alias("b")).select("g", F.col("b.start").alias("start"))
    best = tables.save(est.join(best, ["g", "start"]), "best")
    dist = join_small(fit, best, ["g"], "doc_id").withColumn("d2", _distance([F.col(x) for x in X]))
    # The trimmed scatter is too small by a factor that the median distance shows, against chi-square with as many degrees
    # of freedom as there are statistics that vary by more than their resolution.
    median = F.element_at(F.array(*map(F.lit, CHI2_MEDIAN)), F.max("free"))
    factor = tables.save(dist.groupBy("g").agg(F.greatest(_median(F.col("d2")) / median, F.lit(1.0)).alias("f"), F.count("*").alias("n_g")), "factor")
    scaled = best.select("g", *(f"m{i}" for i in range(P)), *_SCATTER).join(factor, "g").withColumns({c: F.col(c) * F.col("f") for c in _SCATTER})
    scaled = tables.save(_factored(scaled, correlated), "scaled")
    out = join_small(v.where(F.coalesce("judged", F.lit(True))), scaled, ["g"], "doc_id", "left")
    out = out.withColumn("distance2", F.when(F.col("n_g") >= min_group, _distance([F.col(x) for x in X])))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cutoff, F.lit(True))
    value = lambda c: F.when(F.col(c) != "", F.expr(f"substr({c}, 2)")).alias(c)
    return out.select("doc_id", value("lang"), value("source"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance2")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of ``docs`` without those whose doc_id has a rejected row (null ids go with rejected null ids)."""
    bad = judge(docs).where("not kept").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance2", 3).alias("distance2"))
