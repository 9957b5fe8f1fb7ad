"""The driver's queries over the sketch functions, with DuckDB SQL that computes the same from the values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import blob, native, sql
from tessera.operators import merging
from tessera.plans import sketch_sql as S
from tessera.sources import store
from tessera.streaming import windows

QS = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
SIGNED_QS = [0.0, 0.01, 0.02, 0.05, 0.1, 0.5]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def summary(keys: list[str], s: Column, percentiles: bool = True) -> list[Column]:
    """Rounded as in the SQL: powers differ in the last place between engines."""
    cols = [*map(F.col, keys), native.count(s).alias("count"), F.round(native.total(s), 2).alias("sum"), F.round(native.average(s), 6).alias("avg"), F.round(native.minimum(s), 6).alias("min"), F.round(native.maximum(s), 6).alias("max")]
    return cols + ([F.round(native.quantile(s, q), 6).alias(p) for p, q in native.PERCENTILES.items()] if percentiles else [])


def at_quantiles(df: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    rows = df.withColumn("q", F.explode(F.array(*map(F.lit, qs))))
    return rows.select(*keys, "q", F.round(native.quantile(F.col("sketch"), F.col("q")), 6).alias("value"))


def blobs(df: DataFrame, value: str, keys: list[str], **parameters) -> DataFrame:
    return merging.build(df, value, keys, column="s__", **parameters).select(*keys, blob.from_struct("s__").alias("sketch"))


def struct_summary(df: DataFrame, keys: list[str], stats: str = "stats", percentiles: bool = True) -> DataFrame:
    places = {"sum": 2}
    names = ["sum", "avg", "min", "max", *(native.PERCENTILES if percentiles else [])]
    return df.select(*keys, F.col(f"{stats}.count").alias("count"), *[F.round(F.col(f"{stats}.{x}"), places.get(x, 6)).alias(x) for x in names])


FLAGS = ["l_returnflag", "l_linestatus"]


def create(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [store.create(spark, a).select(F.lit(a).alias("accuracy"), F.hex("sketch").alias("sketch"), blob.count("sketch").alias("count"), blob.quantile("sketch", F.lit(0.5)).alias("p50")) for a in (0.05, 0.02, 0.01, 0.001)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select("accuracy", F.when(F.col("accuracy") == 0.01, F.col("sketch")).alias("sketch_hex"), F.length("sketch").alias("hex_digits"), "count", "p50")


CREATE_SQL = """SELECT accuracy::DOUBLE AS accuracy, CASE WHEN accuracy = 0.01 THEN '02FD4A815ABF52F03F0000000000000000' END AS sketch_hex,
34 AS hex_digits, 0::BIGINT AS count, NULL::DOUBLE AS p50 FROM (VALUES (0.05), (0.02), (0.01), (0.001)) v(accuracy)"""


def create_sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark, "t_")
    return spark.sql("SELECT hex(t_add(sketch, 42.0D)) AS h42, t_count(t_add(t_add(t_add(sketch, 10.0D), 20.0D), 30.0D)) AS n3, t_count(sketch) AS n0, t_max(sketch) AS high FROM t_create(0.01D)")


def build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.build(table(spark, sf_dir, "lineitem"), "l_extendedprice", FLAGS).select(*summary(FLAGS, F.col("sketch")))


def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_quantiles(merging.build(table(spark, sf_dir, "lineitem"), "l_quantity", FLAGS), FLAGS, QS)


def quantiles_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_quantiles(merging.build(table(spark, sf_dir, "customer"), "c_acctbal", ["c_mktsegment"]), ["c_mktsegment"], SIGNED_QS)


def zero_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.build(table(spark, sf_dir, "lineitem"), "l_discount", ["l_returnflag"]).select(*summary(["l_returnflag"], F.col("sketch")))


def global_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.build(table(spark, sf_dir, "orders"), "o_totalprice").select(*summary([], F.col("sketch")))


def add_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds every balance of a nation one call at a time: nested calls over blocks of eight values, and the blocks merged."""
    order = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    rows = table(spark, sf_dir, "supplier").withColumn("n", F.row_number().over(order) - 1).withColumn("block", F.floor(F.col("n") / 8))
    wide = rows.groupBy("s_nationkey", "block").agg(F.sort_array(F.collect_list(F.struct("n", "s_acctbal"))).alias("v"))
    sketch: Column = F.lit(bytearray(blob.empty()))
    for i in range(8):
        value = F.get("v", F.lit(i))["s_acctbal"]
        # a null value would make the sketch null
        sketch = F.when(value.isNull(), sketch).otherwise(blob.add(sketch, F.coalesce(value, F.lit(0.0))))
    folded = merging.group_merge(wide.select("s_nationkey", sketch.alias("sketch")), ["s_nationkey"])
    return folded.select("s_nationkey", blob.to_struct("sketch").alias("sketch")).select(*summary(["s_nationkey"], F.col("sketch")))


def merge_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = blobs(table(spark, sf_dir, "lineitem"), "l_extendedprice", FLAGS)
    side = lambda flag, name: own.where(F.col("l_returnflag") == flag).select("l_linestatus", F.col("sketch").alias(name))
    pairs = side("A", "a").join(side("R", "r"), "l_linestatus").select("l_linestatus", blob.merge("a", "r").alias("sketch"))
    return pairs.select("l_linestatus", blob.to_struct("sketch").alias("sketch")).select(*summary(["l_linestatus"], F.col("sketch")))


def merge_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = F.lit(bytearray(blob.empty(0.01))), F.lit(bytearray(blob.empty(0.02)))
    return spark.range(1).select(blob.merge(one, two).isNull().alias("mismatch_is_null"), blob.count(blob.merge(one, one)).alias("match_count"), blob.merge(one, F.lit(None).cast("binary")).isNull().alias("null_is_null"))


def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    hourly = blobs(events, "value", ["hour", "event_type"])
    daily = merging.merged(hourly.withColumn("day", F.date_trunc("day", "hour")), "sketch", ["day", "event_type"])
    return daily.withColumn("day", F.date_format("day", "yyyy-MM-dd")).select(*summary(["day", "event_type"], F.col("sketch")))


EVENT_DAYS, EVENT_DAY = "(SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events)", "day, event_type"


def stats_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    hourly = blobs(events, "value", ["hour", "event_type"]).withColumn("day", F.date_format("hour", "yyyy-MM-dd"))
    out = merging.group_stats(hourly, ["day", "event_type"])
    return struct_summary(out.where(blob.count("stats.sketch") == F.col("stats.count")), ["day", "event_type"])


def agg_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered aggregates in SQL: a scalar over an aggregate, a struct's fields, a CTE and UNION ALL."""
    sql.register(spark, "t_")
    blobs(table(spark, sf_dir, "part"), "p_retailprice", ["p_brand", "p_container"] if "p_container" in table(spark, sf_dir, "part").columns else ["p_brand"]).createOrReplaceTempView("t_part_sketches")
    return spark.sql("""
WITH twice AS (SELECT p_brand, sketch FROM t_part_sketches UNION ALL SELECT p_brand, sketch FROM t_part_sketches),
s AS (SELECT p_brand, t_stats_agg(sketch) AS x FROM twice GROUP BY p_brand),
a AS (SELECT p_brand, t_count(t_agg(sketch)) AS n FROM twice GROUP BY p_brand)
SELECT s.p_brand, a.n AS count, round(x.p50, 6) AS p50, round(x.p99, 6) AS p99, round(x.max, 6) AS max, t_count(x.sketch) = x.count AS same
FROM s JOIN a ON s.p_brand = a.p_brand""")


AGG_SQL_BINS = "(SELECT p_brand, p_retailprice FROM part UNION ALL SELECT p_brand, p_retailprice FROM part)"


def stats_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    named = table(spark, sf_dir, "customer").join(nations, "c_nationkey")
    rows = blobs(named, "c_acctbal", ["n_name"]).select("n_name", blob.stats("sketch").alias("stats"))
    return struct_summary(rows, ["n_name"], percentiles=False)


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every function on null, bytes that aren't a sketch, no bytes and an empty sketch."""
    kinds = {"null": None, "undecodable": b"\x02\x00", "no bytes": b"", "empty": blob.empty()}
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("input"), F.lit(None if v is None else bytearray(v)).cast("binary").alias("s")) for k, v in kinds.items()])).alias("x")).select("x.*")
    half = F.lit(0.5)
    groups = rows.select("input", F.col("s").alias("sketch"))
    merged = merging.group_merge(groups, ["input"]).select("input", F.col("sketch").isNull().alias("agg_null"))
    full = merging.group_stats(groups, ["input"]).select("input", F.col("stats").isNull().alias("full_null"), F.col("stats.count").alias("full_count"), F.isnan("stats.p50").alias("full_nan"))
    own = rows.select(
        "input", blob.count("s").alias("count"), blob.total("s").alias("sum"), blob.average("s").alias("avg"), blob.minimum("s").alias("min"), blob.maximum("s").alias("max"), blob.quantile("s", half).alias("p50"),
        blob.stats("s")["count"].alias("stats_count"), F.isnan(blob.stats("s")["avg"]).alias("stats_nan"), blob.count(blob.add("s", F.lit(1.0))).alias("added"), blob.add("s", F.lit(None).cast("double")).isNull().alias("add_null"), blob.count(blob.merge("s", "s")).alias("merged"),
    )
    nan = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return own.join(merged, "input").join(full, "input").withColumns({"stats_nan": nan("stats_nan"), "full_nan": nan("full_nan")})


MATRIX_SQL = """SELECT * FROM (VALUES
('null', NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT, false, NULL::BIGINT, true, NULL::BIGINT, true, true, NULL::BIGINT, false),
('undecodable', NULL, NULL, NULL, NULL, NULL, NULL, NULL, false, NULL, true, NULL, true, true, NULL, false),
('no bytes', 0, NULL, NULL, NULL, NULL, NULL, 0, true, 1, true, 0, true, true, NULL, false),
('empty', 0, NULL, NULL, NULL, NULL, NULL, 0, true, 1, true, 0, false, false, 0, true))
v(input, count, sum, avg, min, max, p50, stats_count, stats_nan, added, add_null, merged, agg_null, full_null, full_count, full_nan)"""

# Serialised sketches of accuracy 0.01 with what they hold (floor bins), behind their common mapping block.
PREFIX = "02fd4a815abf52f03f0000000000000000"
GOLDEN = (
    ("42", "0501f40202", 1, 41.682206632978456),
    ("10, 20", "0502e601024402", 2, 29.96136693037751),
    ("1..10", "050a0002440228021e021602120210020c020c020c02", 10, 54.948952462932695),
    ("0.001..0.005", "0505b30502460228021c021802", 5, 0.015008577971483281),
    ("1e6, 2e6, 3e6", "0503e40a0246022802", 3, 5987460.634366453),
    ("0.1..1000", "0505e70102e80102e60102e60102e60102", 5, 1114.1065215656804),
    ("50 x5", "0501860305", 5, 249.51480474533258),
    ("10..100", "050ae6010244022a021c021602120210020e020a020c02", 10, 550.3092442194343),
    ("mixed", "0509a00104120310020c021802280278024602a00102", 12, 715.2227847478571),
    ("merged", "05070002440228031e03160312021002", 10, 40.00576175735671),
)


def golden_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(PREFIX + h).alias("h")) for n, h, _, _ in GOLDEN])).alias("x")).select("x.*")
    rows = rows.withColumn("sketch", F.unhex("h"))
    again = blob.from_struct(blob.to_struct("sketch"))
    return rows.select("name", blob.count("sketch").alias("count"), F.round(blob.total("sketch"), 9).alias("sum"), (F.lower(F.hex(again)) == F.col("h")).alias("same_bytes"))


GOLDEN_SQL = "SELECT name, count::BIGINT AS count, round(total::DOUBLE, 9) AS sum, true AS same_bytes FROM (VALUES " + ", ".join(f"('{n}', {c}, {s!r})" for n, _, c, s in GOLDEN) + ") v(name, count, total)"


def encode_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs(table(spark, sf_dir, "supplier"), "s_acctbal", ["s_nationkey"]).select("s_nationkey", F.lower(F.hex("sketch")).alias("sketch_hex"))


def window_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running merges by day: bins of all days so far, counted over a window, then one sketch a day."""
    events = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    daily = merging.bins_of(events, "value", ["day"])
    days = daily.select("day").distinct()
    # each bin from its day on: a running sum along the days, for the days that follow until the bin's next row
    running = daily.withColumn("c", F.sum("c").over(Window.partitionBy("sign", "i").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
    until = F.lead("day").over(Window.partitionBy("sign", "i").orderBy("day"))
    spans = running.withColumn("until", until).withColumnRenamed("day", "since")
    every = _carried(days, spans)
    return merging.gathered(every.withColumn("day", F.date_format("day", "yyyy-MM-dd")), ["day"], 0.01).select(*summary(["day"], F.col("sketch")))


def _carried(days: DataFrame, spans: DataFrame) -> DataFrame:
    """day, sign, i, c: each span's count on all its days. Spans are dealt out by date, so no range join is needed."""
    last = days.agg(F.max("day").alias("last"))  # one row
    reach = spans.join(F.broadcast(last)).withColumn("to", F.coalesce(F.date_sub("until", 1), F.col("last")))
    return reach.select(F.explode(F.sequence("since", "to")).alias("day"), "sign", "i", "c").join(days, "day", "left_semi")


WINDOW_SQL_BINS = f"SELECT d.day, b.s, b.i, sum(b.c) AS c FROM (SELECT DISTINCT day FROM {EVENT_DAYS}) d JOIN (" + S.bins(EVENT_DAYS, "value", "day") + ") b ON b.day <= d.day GROUP BY ALL"


def floor_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.build(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"], rule="floor").select(*summary(["o_orderpriority"], F.col("sketch")))


def weighted_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.build(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"], weight="l_quantity").select(*summary(["l_returnflag"], F.col("sketch")))


WEIGHTED_BINS = S.bins("lineitem", "l_extendedprice", "l_returnflag").replace("count(*)::DOUBLE", "sum(l_quantity)")


def store_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of one half of the orders, then the other half added to it."""
    orders = table(spark, sf_dir, "orders")
    first = blobs(orders.where("o_orderkey % 2 = 0"), "o_totalprice", ["o_orderstatus"])
    after = store.with_values(first, orders.where("o_orderkey % 2 <> 0"), "o_totalprice", ["o_orderstatus"])
    return after.select("o_orderstatus", blob.to_struct("sketch").alias("sketch")).select(*summary(["o_orderstatus"], F.col("sketch")))


def key_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = blobs(table(spark, sf_dir, "lineitem"), "l_tax", FLAGS)
    return merging.rolled_up(own, FLAGS).select(*summary([*FLAGS, "level"], F.col("sketch")))


def _rollup_sql() -> str:
    level = lambda keys, n: "SELECT " + ", ".join(k if k in keys else f"NULL::VARCHAR AS {k}" for k in FLAGS) + f", {n} AS level, l_tax FROM lineitem"
    rows = " UNION ALL ".join(level(FLAGS[: 2 - n], n) for n in range(3))
    # nulls don't join, so the keys get a stand-in and lose it at the end
    inner = S.stats(S.bins(f"(SELECT coalesce(l_returnflag, '-') AS l_returnflag, coalesce(l_linestatus, '-') AS l_linestatus, level, l_tax FROM ({rows}))", "l_tax", ", ".join([*FLAGS, "level"])), ", ".join([*FLAGS, "level"]))
    return f"SELECT * REPLACE (nullif(l_returnflag, '-') AS l_returnflag, nullif(l_linestatus, '-') AS l_linestatus) FROM ({inner})"


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming plan over the table as a batch: six-hour windows by event type."""
    bins = windows.windowed_bins(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", "6 hours", "1 hour", ["event_type"])
    out = windows.sketches(bins, ["event_type"]).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))
    return out.select(*summary(["start", "event_type"], F.col("sketch")))


FLAG_KEYS = ", ".join(FLAGS)
STARTS = "(SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS start, event_type, value FROM events)"

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "build_stats": (build_stats, S.stats(S.bins("lineitem", "l_extendedprice", FLAG_KEYS), FLAG_KEYS)),
    "create": (create, CREATE_SQL),
    "create_sql_function": (create_sql_function, "SELECT '02FD4A815ABF52F03F00000000000000000501F60202' AS h42, 3::BIGINT AS n3, 0::BIGINT AS n0, NULL::DOUBLE AS high"),
    "quantiles": (quantiles, S.quantiles(S.bins("lineitem", "l_quantity", FLAG_KEYS), FLAG_KEYS, QS)),
    "quantiles_signed": (quantiles_signed, S.quantiles(S.bins("customer", "c_acctbal", "c_mktsegment"), "c_mktsegment", SIGNED_QS)),
    "zero_bucket": (zero_bucket, S.stats(S.bins("lineitem", "l_discount", "l_returnflag"), "l_returnflag")),
    "global_build": (global_build, S.stats(S.bins("orders", "o_totalprice"), "")),
    "add_fold": (add_fold, S.stats(S.bins("supplier", "s_acctbal", "s_nationkey"), "s_nationkey")),
    "merge_pair": (merge_pair, S.stats(S.bins("(SELECT * FROM lineitem WHERE l_returnflag IN ('A', 'R'))", "l_extendedprice", "l_linestatus") + " HAVING l_linestatus IN (SELECT l_linestatus FROM lineitem WHERE l_returnflag = 'A') AND l_linestatus IN (SELECT l_linestatus FROM lineitem WHERE l_returnflag = 'R')", "l_linestatus")),
    "merge_mismatch": (merge_mismatch, "SELECT true AS mismatch_is_null, 0::BIGINT AS match_count, true AS null_is_null"),
    "agg_rollup": (agg_rollup, S.stats(S.bins(EVENT_DAYS, "value", EVENT_DAY), EVENT_DAY)),
    "stats_agg": (stats_agg, S.stats(S.bins(EVENT_DAYS, "value", EVENT_DAY), EVENT_DAY)),
    "agg_sql": (agg_sql, "SELECT p_brand, count, p50, p99, max, true AS same FROM (" + S.stats(S.bins(AGG_SQL_BINS, "p_retailprice", "p_brand"), "p_brand") + ")"),
    "stats_scalar": (stats_scalar, S.stats(S.bins("customer JOIN nation ON c_nationkey = n_nationkey", "c_acctbal", "n_name"), "n_name", percentiles=False)),
    "matrix": (matrix, MATRIX_SQL),
    "golden_decode": (golden_decode, GOLDEN_SQL),
    "encode_hex": (encode_hex, None),
    "window_merge": (window_merge, S.stats(WINDOW_SQL_BINS, "day")),
    "floor_rule": (floor_rule, S.stats(S.bins("orders", "o_totalprice", "o_orderpriority", rule="floor"), "o_orderpriority")),
    "weighted_build": (weighted_build, S.stats(WEIGHTED_BINS, "l_returnflag")),
    "store_update": (store_update, S.stats(S.bins("orders", "o_totalprice", "o_orderstatus"), "o_orderstatus")),
    "key_rollup": (key_rollup, _rollup_sql()),
    "windowed": (windowed, S.stats(S.bins(STARTS, "value", "start, event_type"), "start, event_type")),
}
