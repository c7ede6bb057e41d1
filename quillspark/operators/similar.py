"""Edit-distance join of two tables of names without comparing all pairs.

Within distance k, a name cut into k + 1 parts has a part that the other holds unchanged, shifted by k places at most. So
each indexed name gives k + 1 rows (length, part number, part), each query the pieces of its own that could be such a part
of a name of each possible length, and an equi-join brings together what may be near; built-in ``levenshtein`` decides.
Names shorter than k + 1 have no such parts: there, and for queries as short as 2k, the keys are what is left of a name
after up to k deletions, of which short names have few.

Names are made distinct first, so that a name with any number of rows is compared once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _parts(n: int, k: int) -> list[tuple[int, int]]:
    """Start (from 0) and size of the k + 1 parts of a name of length n, the longer ones last."""
    small, longer = divmod(n, k + 1)
    sizes = [small + (i > k - longer) for i in range(k + 1)]
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]


def _index_keys(name: str, k: int) -> Column:
    """length:part number:part. A part's place follows from the length by arithmetic."""
    n = F.length(name)
    small, longer = F.floor(n / (k + 1)).cast("int"), n % (k + 1)
    keys = []
    for i in range(k + 1):
        extra = F.greatest(F.lit(0), i - (F.lit(k + 1) - longer))  # longer parts before this one
        start, size = i * small + extra, small + F.when(F.lit(i) > k - longer, 1).otherwise(0)
        keys.append(F.concat_ws(":", n.cast("string"), F.lit(str(i)), F.substr(F.col(name), start + 1, size)))
    return F.array(*keys)


def _query_keys(name: str, k: int) -> Column:
    """The keys that a name within distance k may have: for each length, part and shift. With d the difference of lengths,
    a part that begins i parts in is shifted by no more than i edits from the left and k - i from the right."""
    n = F.length(name)

    def of_length(d: int) -> Column:
        m = n + d
        small, longer = F.floor(m / (k + 1)).cast("int"), m % (k + 1)
        out = []
        for i in range(k + 1):
            extra = F.greatest(F.lit(0), i - (F.lit(k + 1) - longer))
            start, size = i * small + extra, small + F.when(F.lit(i) > k - longer, 1).otherwise(0)
            for shift in range(-k, k + 1):
                # edits before the part are at least |shift|, those after it at least |shift + d|
                if abs(shift) <= i and abs(shift + d) <= k - i:
                    at = start + shift
                    piece = F.concat_ws(":", m.cast("string"), F.lit(str(i)), F.substr(F.col(name), at + 1, size))
                    out.append(F.when((at >= 0) & (at + size <= n) & (size > 0), piece))
        return F.array(*out)

    lengths = [d for d in range(-k, k + 1)]
    return F.array_distinct(F.array_compact(F.flatten(F.array(*(of_length(d) for d in lengths)))))


def _deletions(name: str, k: int) -> Column:
    """What is left of a name after up to k deletions; for names of at most 2k letters."""
    letters = F.split(F.col(name), "")
    masks = F.expr(f"sequence(0, shiftleft(1, length({name})) - 1)")
    kept = F.filter(masks, lambda m: F.bit_count(m) >= F.length(name) - k)
    rest = F.transform(kept, lambda m: F.array_join(F.filter(letters, lambda c, i: F.getbit(m, i) == 1), ""))
    return F.transform(F.array_distinct(rest), lambda r: F.concat(F.lit("-:"), r))


def near(queries: DataFrame, names: DataFrame, k: int = 3) -> DataFrame:
    """query, name, distance of every pair of distinct values within edit distance ``k`` (in characters).

    ``queries`` and ``names`` have a column ``query`` and ``name``. Null values match nothing.
    """
    q = queries.select("query").where("query IS NOT NULL").distinct()
    n = names.select("name").where("name IS NOT NULL").distinct()
    long_name, long_query = F.length("name") > k, F.length("query") > 0
    short_name, short_query = F.length("name") <= k, F.length("query") <= 2 * k
    left = q.where(long_query).select("query", F.explode(_query_keys("query", k)).alias("key"))
    left = left.unionByName(q.where(short_query).select("query", F.explode(_deletions("query", k)).alias("key")))
    right = n.where(long_name).select("name", F.explode(_index_keys("name", k)).alias("key"))
    right = right.unionByName(n.where(short_name).select("name", F.explode(_deletions("name", k)).alias("key")))
    # an empty query is within k of all names of up to k letters: their deletions reach the empty name
    right = right.unionByName(n.where(long_name & (F.length("name") <= 2 * k)).select("name", F.explode(_deletions("name", k)).alias("key")))
    met = left.join(right, "key").select("query", "name", F.levenshtein("query", "name", k).alias("distance")).where("distance >= 0")
    return met.distinct()
