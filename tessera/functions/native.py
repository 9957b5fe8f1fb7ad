"""Accessors on a decoded sketch column, as built-in expressions.

A decoded sketch is a struct of gamma, index_offset, zero_count, pos and neg (arrays of bins (i, c) that rise with i), and
n, total, low and high: what count, sum, minimum and maximum are. For a sketch of bins alone those follow from the
bins; bytes may also state them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.mapping import bin_value

PERCENTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
NAN = float("nan")
INF = float("inf")


def _sum(bins: Column, term) -> Column:
    return F.aggregate(bins, F.lit(0.0), lambda a, x: a + term(x))


def sketch_of(gamma: Column, offset: Column, zeros: Column, pos: Column, neg: Column) -> Column:
    """The decoded sketch of the given bins."""
    value = lambda x: bin_value(x["i"], gamma, offset)
    n = _sum(pos, lambda x: x["c"]) + _sum(neg, lambda x: x["c"]) + zeros
    total = _sum(pos, lambda x: value(x) * x["c"]) - _sum(neg, lambda x: value(x) * x["c"])
    filled = lambda bins: F.filter(bins, lambda x: x["c"] > 0)
    first, last = lambda b: value(F.element_at(b, 1)), lambda b: value(F.element_at(b, -1))
    p, m = filled(pos), filled(neg)
    some = lambda b: F.size(b) > 0
    low = F.when(some(m), -last(m)).when(zeros > 0, 0.0).when(some(p), first(p)).otherwise(INF)
    high = F.when(some(p), last(p)).when(zeros > 0, 0.0).when(some(m), -first(m)).otherwise(-INF)
    names = ("gamma", "index_offset", "zero_count", "pos", "neg", "n", "total", "low", "high")
    whole = F.struct(*[c.alias(k) for k, c in zip(names, (gamma, offset, zeros, pos, neg, n, total, low, high), strict=True)])
    # a bare struct would be copied into every accessor; the optimizer evaluates this form once
    return F.element_at(F.transform(F.array(whole), lambda x: x), 1)


def _has(s: Column) -> Column:
    return s["n"] != 0


def count(s: Column) -> Column:
    return s["n"].cast("long")


def total(s: Column) -> Column:
    return F.when(_has(s), s["total"])


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < INF), x)


def minimum(s: Column) -> Column:
    return F.when(_has(s), _finite(s["low"]))


def maximum(s: Column) -> Column:
    return F.when(_has(s), _finite(s["high"]))


def average(s: Column) -> Column:
    return F.when(count(s) != 0, s["total"] / count(s))


def quantile(s: Column, q: Column | float) -> Column:
    """Null for an empty sketch, a null q or one outside 0..1; NaN is past every rank.

    The rank on the negative side counts from the end that lies nearest to zero.
    """
    q = q if isinstance(q, Column) else F.lit(float(q))
    rank = q * (s["n"] - 1)
    below = _sum(s["neg"], lambda x: x["c"])

    def at(bins: Column, rank: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("int").alias("i"))

        def step(a: Column, x: Column) -> Column:
            seen = a["seen"] + x["c"]
            return F.struct(seen.alias("seen"), F.when(a["i"].isNotNull(), a["i"]).when(seen > rank, x["i"]).alias("i"))

        index = F.coalesce(F.aggregate(bins, start, step)["i"], F.element_at(bins, -1)["i"])
        return F.when(F.size(bins) > 0, bin_value(index, s["gamma"], s["index_offset"])).otherwise(0.0)

    # Spark holds NaN greater than all numbers, so it fails both comparisons with < as it should
    inside = at(s["pos"], F.greatest(rank - s["zero_count"] - below, F.lit(0.0)))
    found = F.when(rank < below, -at(s["neg"], F.greatest(below - 1 - rank, F.lit(0.0)))).when(rank < below + s["zero_count"], 0.0).otherwise(inside)
    return F.when(_has(s) & (F.isnan(q) | ((q >= 0) & (q <= 1))), found)


def _or_nan(x: Column) -> Column:
    return F.coalesce(x, F.lit(NAN))


def stats(s: Column) -> Column:
    """count, sum, min, max, avg; the last four are NaN for an empty sketch."""
    fields = F.struct(count(s).alias("count"), _or_nan(total(s)).alias("sum"), _or_nan(minimum(s)).alias("min"), _or_nan(maximum(s)).alias("max"), _or_nan(average(s)).alias("avg"))
    return F.when(s.isNotNull(), fields)


def full_stats(s: Column, blob: Column) -> Column:
    """The blob, the five of stats() and six percentiles; null for null, NaN fields for an empty sketch."""
    fields = [blob.alias("sketch"), count(s).alias("count"), _or_nan(total(s)).alias("sum"), _or_nan(average(s)).alias("avg"), _or_nan(minimum(s)).alias("min"), _or_nan(maximum(s)).alias("max")]
    return F.when(s.isNotNull(), F.struct(*fields, *[_or_nan(quantile(s, q)).alias(k) for k, q in PERCENTILES.items()]))
