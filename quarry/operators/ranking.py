"""Ranking metrics over tie-grouped precision-recall points, and exact quantiles, from running totals by value.

Rows are counted by distinct value first. The running totals then work in levels: a group's values are cut into octaves
(values of one sign within a factor of two), each octave into parts of equal width between its own least and largest value,
as many as its number of values takes. Totals are carried from octave to octave, from part to part, and each part is summed by
itself. So outliers, infinite values and scales of any kind don't crowd a part, no task sorts all values of a group, and
nothing is run while the plan is built. Parts follow from the values alone, so that a task that is run again finds the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of an octave at most: rows that one task holds while totals are carried.
BUCKETS = 1 << 16
#: Distinct values that a part has on average, before an octave is cut into more parts.
LEAST = 1 << 10
ROUND = 6


def place_in(value: Column, cuts: Column) -> Column:
    """The place, from 0, of the last of some ascending cuts that isn't over the value; 0 below all. A binary search, written as
    a fold over as many steps as the array's size needs."""

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = F.element_at(cuts, mid + 1) <= value
        return F.when(s["hi"] - s["lo"] <= 1, s).otherwise(F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi")))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(cuts).cast("double"))).cast("int"))
    return F.when(F.size(cuts) == 1, 0).otherwise(F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi")), halve)["lo"])


def octave(value: Column) -> Column:
    """A number that doesn't fall as the value grows: its sign times its magnitude's power of two, moved above zero."""
    power = F.least(F.floor(F.log2(F.abs(value))), F.lit(1024)) + 1100  # subnormal numbers have -1074
    return F.when(F.isnan(value), 9999).when(value == 0, 0).otherwise(F.signum(value) * power).cast("int")


def in_parts(counted: DataFrame, by: list[str], value: str, sums: list[str], buckets: int = BUCKETS, least: int = LEAST) -> DataFrame:
    """counted with __octave and __part, where in its group a row is, and of each sum __<sum>_before, over the octaves before,
    and <sum>_all, over the group."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row per octave
    rows = counted.withColumn("__octave", octave(F.col(value)))
    ends = rows.groupBy(*by, "__octave").agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.count("*").alias("__rows"), *(F.sum(c).alias(f"__{c}") for c in sums))
    many = F.least(F.lit(buckets), F.ceil(F.col("__rows") / float(least)))
    totals = [x for c in sums for x in ((F.sum(f"__{c}").over(group.orderBy("__octave")) - F.col(f"__{c}")).alias(f"__{c}_before"), F.sum(f"__{c}").over(group).alias(f"{c}_all"))]
    rows = rows.join(ends.select(*by, "__octave", "__lo", "__hi", many.alias("__many"), *totals), [*by, "__octave"])
    v, lo, hi = F.col(value), F.col("__lo"), F.col("__hi")
    part = F.when((F.col("__many") == 1) | (v <= lo), 0).when(v >= hi, F.col("__many") - 1).otherwise(F.least(F.floor((v - lo) / (hi - lo) * F.col("__many")), F.col("__many") - 1))
    return rows.select(*counted.columns, "__octave", part.cast("int").alias("__part"), *(x for c in sums for x in (f"__{c}_before", f"{c}_all")))


def running(counted: DataFrame, by: list[str], value: str, sums: list[str], buckets: int = BUCKETS, least: int = LEAST) -> DataFrame:
    """counted (by, value, sums; a row per group and value, no nulls) with <sum>_upto, over rows of the group with no larger
    value, and <sum>_all, over all of the group."""
    key = [*by, "__octave", "__part"]
    rows = in_parts(counted, by, value, sums, buckets, least)
    # it also hands on the totals: so both uses of rows need all of its columns, and its input is worked out once
    parts = rows.groupBy(*key).agg(*(F.sum(c).alias(f"__{c}") for c in sums), *(F.max(f"__{c}_before").alias(f"__b_{c}") for c in sums), *(F.max(f"{c}_all").alias(f"__a_{c}") for c in sums))
    before = Window.partitionBy(*by, "__octave").orderBy("__part")
    carried = parts.select(*key, *((F.sum(f"__{c}").over(before) - F.col(f"__{c}") + F.col(f"__b_{c}")).alias(f"__c_{c}") for c in sums), *(f"__a_{c}" for c in sums))
    own = Window.partitionBy(*key).orderBy(value)
    return rows.join(carried, key).select(*counted.columns, *((F.sum(c).over(own) + F.col(f"__c_{c}")).alias(f"{c}_upto") for c in sums), *(F.greatest(f"{c}_all", f"__a_{c}").alias(f"{c}_all") for c in sums))


def points(df: DataFrame, by: list[str], score: str = "score", gt: str = "gt", weight: str | None = None, buckets: int = BUCKETS, least: int = LEAST) -> DataFrame:
    """by, score, p, n (out and in distribution at the score), tp, fp (at and above it), pos, neg (in all); rows whose gt
    is neither 0 nor 1 don't count."""
    w = F.col(weight) if weight else F.lit(1)
    counted = df.filter(F.col(gt).isin(0, 1)).groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.sum(F.when(F.col(gt) == 1, w).otherwise(0)).alias("p"), F.sum(F.when(F.col(gt) == 0, w).otherwise(0)).alias("n"))
    down = lambda c: F.col(f"{c}_all") - F.col(f"{c}_upto") + F.col(c)
    return running(counted, by, "score", ["p", "n"], buckets, least).select(*by, "score", "p", "n", down("p").alias("tp"), down("n").alias("fp"), F.col("p_all").alias("pos"), F.col("n_all").alias("neg"))


def quantiles(df: DataFrame, by: list[str], value: str, at: list[float] | int) -> DataFrame:
    """by, k, q: the exact quantiles at[k], linear between neighbours; at: a list, or a number of equal steps from 0 to 1.
    Nulls don't count."""
    counted = df.select(*by, F.col(value).cast("double").alias("__v")).filter("__v IS NOT NULL").groupBy(*by, "__v").agg(F.count("*").alias("__m"))
    rows = running(counted, by, "__v", ["__m"]).withColumn("last", F.col("__m_all") - 1)
    first, end = F.col("__m_upto") - F.col("__m"), F.col("__m_upto") - 1  # ranks of the value's rows, from 0
    if isinstance(at, int):
        # the steps whose places can be among these ranks, and one more at either side
        lo, hi = ((F.floor((first - 1) * at / F.greatest("last", F.lit(1))) - 1), (F.ceil((end + 1) * at / F.greatest("last", F.lit(1))) + 1))
        ks = F.sequence(F.greatest(lo, F.lit(0)).cast("int"), F.least(hi, F.lit(at)).cast("int"))
        ks, share = F.when(F.col("last") > 0, ks).otherwise(F.sequence(F.lit(0), F.lit(at))), lambda k: k / F.lit(float(at))
    else:
        ks, share = F.sequence(F.lit(0), F.lit(len(at) - 1)), lambda k: F.element_at(F.array(*(F.lit(float(x)) for x in at)), k + 1)
    place = lambda k: F.col("last") * share(k)
    inside = lambda x: (x >= first) & (x <= end)
    near = F.filter(ks, lambda k: inside(F.floor(place(k))) | inside(F.ceil(place(k))))
    rows = rows.withColumn("k", F.explode(near)).withColumn("place", place(F.col("k")))
    below, above = F.when(inside(F.floor("place")), F.col("__v")), F.when(inside(F.ceil("place")), F.col("__v"))
    found = rows.groupBy(*by, "k", "place").agg(F.max(below).alias("a"), F.max(above).alias("b"))
    # equal neighbours give their value, also infinite ones
    q = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place")))
    return found.select(*by, "k", q.alias("q"))


def metrics(df: DataFrame, by: list[str], score: str = "score", gt: str = "gt", weight: str | None = None, digits: int | None = ROUND, buckets: int = BUCKETS, least: int = LEAST) -> DataFrame:
    """by, ap, auroc, fpr95, n_pos. The three are null where a group has but one class; n_pos stays."""
    pts = points(df, by, score, gt, weight, buckets, least)
    pos, neg = F.nullif(F.col("pos").cast("double"), F.lit(0.0)), F.nullif(F.col("neg").cast("double"), F.lit(0.0))
    ap = F.sum(F.col("p") / pos * F.col("tp") / (F.col("tp") + F.col("fp")))
    auroc = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)) / F.max(pos * neg)
    fpr95 = F.min(F.when(F.col("tp") / pos >= 0.95, F.col("fp") / neg))
    both = (F.max("pos") > 0) & (F.max("neg") > 0)
    grouped = pts.groupBy(*by)
    shown = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return grouped.agg(*(F.when(both, shown(c)).alias(a) for c, a in ((ap, "ap"), (auroc, "auroc"), (fpr95, "fpr95"))), F.max("pos").cast("long").alias("n_pos"))


def tau_tpr95(df: DataFrame, by: list[str], score: str = "score", gt: str = "gt", share: float = 0.05) -> DataFrame:
    """by, tau: the score that 95 % of the out-of-distribution rows reach (linear between neighbours)."""
    return quantiles(df.filter(F.col(gt) == 1), by, score, [share]).select(*by, F.col("q").alias("tau"))


def by_tier(df: DataFrame) -> DataFrame:
    """The rows once for each tier: its own and all in-distribution rows (each gets the tier's name in "of")."""
    of = F.when(F.col("gt") == 0, F.array(F.lit("T1"), F.lit("T2"), F.lit("T3"))).otherwise(F.array("tier"))
    return df.filter("gt <> 255").withColumn("of", F.explode(of))
