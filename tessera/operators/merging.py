"""Building and merging sketches by partial and final hash aggregation of bins.

The long form has a row for each key, mapping, sign and bin, with its count. A group's rows meet on (key, bin) first, so a key that
holds most rows is spread over its bins, and only bins, not rows, meet on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import blob, native
from tessera.functions.codec import gamma_of
from tessera.functions.mapping import bin_index, sign_of

DIGITS = 10  # mappings that agree to so many places merge


def _inside(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """df with its keys under names that clash with nothing in here, and those names."""
    names = [f"key{i}__" for i in range(len(keys))]
    return df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], "*"), names


def _outside(df: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    return df.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], *[c for c in df.columns if c not in names])


def bins_of(df: DataFrame, value: Column | str, keys: list[str], accuracy: float = 0.01, rule: str = "ceil", weight: Column | str | None = None) -> DataFrame:
    """keys, sign, i, c: counts of values, or sums of their weights, by bin. Null values and weights that aren't positive don't count.

    Keys can't be called sign, i or c here; build() takes any.
    """
    value = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*keys, value.alias("v__"), (F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")).alias("w__"))
    rows = rows.where("v__ is not null and w__ > 0")
    return rows.groupBy(*keys, sign_of(F.col("v__")).alias("sign"), bin_index(F.col("v__"), accuracy, rule).alias("i")).agg(F.sum("w__").alias("c"))


def gathered(bins: DataFrame, keys: list[str], accuracy: float, column: str = "sketch") -> DataFrame:
    """keys and one decoded sketch each, of the bins (sign, i, c). Without keys there is one row, for no bins too."""
    of = lambda sign: F.transform(F.filter(F.col("b__"), lambda x: x["sign"] == sign), lambda x: F.struct(x["i"].alias("i"), x["c"].alias("c")))
    rows = bins.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("sign", "i", "c"))).alias("b__"))
    zeros = F.aggregate(F.filter("b__", lambda x: x["sign"] == 0), F.lit(0.0), lambda a, x: a + x["c"])
    return rows.select(*keys, native.sketch_of(F.lit(gamma_of(accuracy)), F.lit(0.0), zeros, of(1), of(-1)).alias(column))


def build(df: DataFrame, value: Column | str, keys: list[str] | None = None, accuracy: float = 0.01, rule: str = "ceil", weight: Column | str | None = None, column: str = "sketch") -> DataFrame:
    """keys and the decoded sketch of each group's values: the same bins as adding the values one by one.

    A group whose values are all null has no row; without keys there is always one row, an empty sketch for no values.
    """
    keys = list(keys or [])
    df, names = _inside(df, keys)
    return _outside(gathered(bins_of(df, value, names, accuracy, rule, weight), names, accuracy, column), names, keys)


def to_long(df: DataFrame, sketch: str, keys: list[str]) -> DataFrame:
    """One row for each bin and one of sign 0 for each sketch, which carries its zeros and summary; unusable ones have a null mapping.

    sketch: a column of blobs, or of decoded sketches.
    """
    if df.schema[sketch].dataType.typeName() == "binary":
        usable = F.when(F.length(sketch) > 0, F.col(sketch))
        rows = df.select(*keys, blob.to_struct(usable).alias("s__"))
    else:
        rows = df.select(*keys, F.col(sketch).alias("s__"))
    s = F.col("s__")
    none = F.lit(None).cast("double")
    # NaN is greater than all numbers here, but a maximum passes over it
    high = F.when(F.isnan(s["high"]), float("-inf")).otherwise(s["high"])
    own = F.struct(F.lit(0).alias("sign"), F.lit(0).alias("i"), s["zero_count"].alias("c"), s["n"].alias("n"), s["total"].alias("total"), s["low"].alias("low"), high.alias("high"), F.lit(1).alias("sketches"))
    of = lambda bins, sign: F.transform(bins, lambda x: F.struct(F.lit(sign).alias("sign"), x["i"].alias("i"), x["c"].alias("c"), none.alias("n"), none.alias("total"), none.alias("low"), none.alias("high"), F.lit(0).alias("sketches")))
    every = F.when(s.isNotNull(), F.concat(F.array(own), of(s["pos"], 1), of(s["neg"], -1))).otherwise(F.array(own))
    rows = rows.select(*keys, s["gamma"].alias("gamma"), s["index_offset"].alias("index_offset"), F.explode(every).alias("x"))
    return rows.select(*keys, "gamma", "index_offset", "x.*")


def merged(df: DataFrame, sketch: str = "sketch", keys: list[str] | None = None, column: str = "sketch") -> DataFrame:
    """keys, the merged decoded sketch of each group, and dropped: how many sketches had another mapping.

    Unusable blobs (null, no bytes, not a sketch) are skipped; a group of nothing else has a null sketch. With several mappings in a
    group the finest one is kept, by (gamma, offset), and sketches of others are dropped. Without keys there is always one row.
    """
    outer = list(keys or [])
    df, keys = _inside(df, outer)
    rows = to_long(df, sketch, keys)
    g, o = F.round("gamma", DIGITS).alias("g"), F.round("index_offset", DIGITS).alias("o")
    bins = rows.groupBy(*keys, g, o, "sign", "i").agg(
        F.min("gamma").alias("gamma"), F.min("index_offset").alias("index_offset"), F.sum("c").alias("c"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("sketches").alias("sketches")
    )
    one = F.struct("g", "o", "sign", "i", "c", "gamma", "index_offset", "n", "total", "low", "high", "sketches")
    # the finest mapping sorts first; rows without a mapping are left out
    groups = bins.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("g").isNotNull(), one))).alias("b__"))
    first = F.get("b__", F.lit(0))
    groups = groups.select(*keys, first["g"].alias("g__"), first["o"].alias("o__"), "b__")
    kept = F.filter("b__", lambda x: (x["g"] == F.col("g__")) & (x["o"] == F.col("o__")))
    groups = groups.select(*keys, "g__", kept.alias("k__"), F.aggregate("b__", F.lit(0).cast("long"), lambda a, x: a + x["sketches"]).alias("all__"))
    of = lambda sign: F.transform(F.filter("k__", lambda x: x["sign"] == sign), lambda x: F.struct(x["i"].alias("i"), x["c"].alias("c")))
    own = F.get(F.filter("k__", lambda x: x["sign"] == 0), F.lit(0))
    gamma, offset = F.array_min(F.transform("k__", lambda x: x["gamma"])), F.array_min(F.transform("k__", lambda x: x["index_offset"]))
    fields = {"gamma": gamma, "index_offset": offset, "zero_count": own["c"], "pos": of(1), "neg": of(-1), "n": own["n"], "total": own["total"], "low": own["low"], "high": own["high"]}
    whole = F.when(F.col("g__").isNotNull(), F.struct(*[c.alias(k) for k, c in fields.items()]))
    return _outside(groups.select(*keys, whole.alias(column), (F.col("all__") - F.coalesce(own["sketches"], F.lit(0))).alias("dropped")), keys, outer)


def group_merge(df: DataFrame, keys: list[str] | None = None, sketch: str = "sketch") -> DataFrame:
    """keys, sketch (the merged blob) and dropped."""
    return merged(df, sketch, keys, "s__").select(*(keys or []), blob.from_struct("s__").alias("sketch"), "dropped")


def group_stats(df: DataFrame, keys: list[str] | None = None, sketch: str = "sketch") -> DataFrame:
    """keys and stats: the merged blob, its five summary values and six percentiles, from one pass."""
    rows = merged(df, sketch, keys, "s__").withColumn("b__", blob.from_struct("s__"))
    return rows.select(*(keys or []), native.full_stats(F.col("s__"), F.col("b__")).alias("stats"))


def rolled_up(df: DataFrame, keys: list[str], sketch: str = "sketch", column: str = "sketch") -> DataFrame:
    """merged() for every prefix of the keys, as ROLLUP groups; level counts the keys that are left out. An empty table gives no rows.

    One pass: a sketch is decoded once and stands once for each level.
    """
    names = [f"part{i}__" for i in range(len(keys))]
    decoded = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], (blob.to_struct(F.when(F.length(sketch) > 0, F.col(sketch))) if df.schema[sketch].dataType.typeName() == "binary" else F.col(sketch)).alias("s__"))
    level = lambda n: F.struct(F.lit(len(keys) - n).alias("level__"), *[(F.col(k) if i < n else F.lit(None).cast(decoded.schema[k].dataType)).alias(k) for i, k in enumerate(names)])
    rows = decoded.select("s__", F.explode(F.array(*[level(n) for n in range(len(keys), -1, -1)])).alias("at__")).select("at__.*", "s__")
    out = merged(rows, "s__", [*names, "level__"], "out__")
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], F.col("out__").alias(column), "dropped", F.col("level__").alias("level"))
