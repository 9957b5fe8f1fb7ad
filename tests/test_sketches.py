import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import blob, native, sql
from tessera.functions.codec import Sketch, decode, encode
from tessera.operators import merging
from tessera.sources import store
from tessera.streaming import windows

ODD = [0.0, -0.0, 1.0, -1.0, 1e-300, 1e300, math.inf, -math.inf, math.nan]


def folded(values, **kw):
    s = Sketch()
    for v in values:
        s.add(v, **kw)
    return s


def frame(spark, groups):
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, vs in groups.items() for v in vs], "k string, v double")


@pytest.mark.parametrize("rule", ["ceil", "floor"])
def test_build_equals_fold(spark, rule):
    rng = random.Random(1)
    groups = {"odd": ODD, "none": [None, None], "mixed": [rng.choice([0, rng.gauss(0, 100), None]) for _ in range(300)], "one": [42.0]}
    out = merging.build(frame(spark, groups), "v", ["k"], rule=rule).select("k", blob.from_struct("sketch").alias("s")).collect()
    got = {r["k"]: bytes(r["s"]) for r in out}
    assert got == {k: encode(folded([v for v in vs if v is not None], rule=rule)) for k, vs in groups.items() if k != "none"}


def test_global_build_of_nothing(spark):
    empty = spark.createDataFrame([], "v double")
    rows = merging.build(empty, "v").select(blob.from_struct("sketch").alias("s"), native.count(F.col("sketch")).alias("n"), native.total(F.col("sketch")).alias("t"), native.stats(F.col("sketch")).alias("st")).collect()
    assert len(rows) == 1 and bytes(rows[0]["s"]) == encode(Sketch()) and rows[0]["n"] == 0 and rows[0]["t"] is None
    assert rows[0]["st"]["count"] == 0 and math.isnan(rows[0]["st"]["avg"])


def test_native_equals_blob(spark):
    rng = random.Random(2)
    groups = {str(i): [rng.choice([0.0, rng.gauss(-1, 3), rng.expovariate(1)]) for _ in range(rng.randint(1, 40))] for i in range(25)} | {"odd": ODD}
    s = merging.build(frame(spark, groups), "v", ["k"], column="d").withColumn("b", blob.from_struct("d"))
    qs = [0.0, 0.1, 0.333, 0.5, 0.77, 1.0, -0.1, 1.1, math.nan]
    s = s.withColumn("q", F.explode(F.array(*map(F.lit, qs))))
    d = F.col("d")
    pairs = [(native.count(d), blob.count("b")), (native.total(d), blob.total("b")), (native.minimum(d), blob.minimum("b")), (native.maximum(d), blob.maximum("b")), (native.average(d), blob.average("b")), (native.quantile(d, F.col("q")), blob.quantile("b", "q"))]
    rows = s.select("k", "q", *[x.alias(f"{n}{i}") for i, (a, b) in enumerate(pairs) for n, x in (("n", a), ("b", b))]).collect()
    for r in rows:
        for i in range(len(pairs)):
            a, b = r[f"n{i}"], r[f"b{i}"]
            assert (a is None) == (b is None), (r, i)
            if a is not None:
                assert (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, rel=1e-12), (r, i)
    by_group = {(r["k"], r["q"]): r["n5"] for r in rows}
    for k, vs in groups.items():
        want = decode(encode(folded(vs)))
        for q in (0.0, 0.333, 0.77, 1.0):
            assert by_group[k, q] == pytest.approx(want.quantile(q), rel=1e-12)


def test_merge_groups(spark):
    a, b, fine = encode(folded([1.0, 2.0])), encode(folded([-3.0, 0.0])), Sketch(gamma=1 + 2 * 0.001 / 0.999)
    fine.add(7.0)
    rows = {"two": [a, b], "unusable": [None, b"", b"\x02"], "empty": [encode(Sketch()), None], "mixed": [a, encode(fine), a], "same": [a, a, a]}
    df = spark.createDataFrame([(k, None if x is None else bytearray(x)) for k, xs in rows.items() for x in xs], "k string, sketch binary")
    got = {r["k"]: (None if r["sketch"] is None else bytes(r["sketch"]), r["dropped"]) for r in merging.group_merge(df, ["k"]).collect()}
    assert got == {"two": (encode(folded([1.0, 2.0, -3.0, 0.0])), 0), "unusable": (None, 0), "empty": (encode(Sketch()), 0), "mixed": (encode(fine), 2), "same": (encode(folded([1.0, 2.0] * 3)), 0)}
    full = {r["k"]: r["stats"] for r in merging.group_stats(df, ["k"]).collect()}
    assert full["unusable"] is None and full["empty"]["count"] == 0 and math.isnan(full["empty"]["p50"])
    want = decode(encode(folded([1.0, 2.0, -3.0, 0.0])))
    assert full["two"]["count"] == 4 and full["two"]["p25"] == pytest.approx(want.quantile(0.25)) and full["two"]["min"] == pytest.approx(want.low)
    # the registered aggregates agree
    sql.register(spark, "x_")
    df.createOrReplaceTempView("merge_groups")
    by_sql = {r["k"]: None if r["s"] is None else bytes(r["s"]) for r in spark.sql("SELECT k, x_agg(sketch) AS s FROM merge_groups GROUP BY k").collect()}
    assert by_sql == {k: v[0] for k, v in got.items()}
    assert merging.group_merge(df.where("false")).collect()[0]["sketch"] is None  # one row, as an aggregate without groups


def test_stated_features_are_merged(spark):
    import struct

    data = encode(folded([1.0])) + b"\xa0" + b"\x03" + b"\x84" + struct.pack("<d", 10.0)  # count 2, sum 10
    df = spark.createDataFrame([(bytearray(data),), (bytearray(encode(folded([1.0]))),)], "sketch binary")
    stats = merging.group_stats(df).collect()[0]["stats"]
    assert stats["count"] == 3 and stats["sum"] == pytest.approx(10 + decode(encode(folded([1.0]))).total)
    assert decode(bytes(stats["sketch"])).count == 2


def test_sql_functions(spark):
    sql.register(spark, "x_")
    row = spark.sql("SELECT sketch, x_count(x_add(x_add(x_add(sketch, 10), 20), 30)) AS n, x_add(sketch, NULL) IS NULL AS a, x_quantile(x_add(sketch, 5), 2) IS NULL AS q FROM x_create()").first()
    assert bytes(row["sketch"]) == encode(Sketch()) and row["n"] == 3 and row["a"] and row["q"]
    assert spark.sql("SELECT x_stats(x_add(sketch, 100)).count AS n FROM x_create(0.05D)").first()["n"] == 1


def test_store(spark, tmp_path):
    values = frame(spark, {"a": [1.0, 2.0], "b": [5.0]})
    own = merging.build(values, "v", ["k"], column="s").select("k", blob.from_struct("s").alias("sketch"))
    store.write(own, str(tmp_path / "s"), ["k"])
    back = store.read(spark, str(tmp_path / "s"))
    after = store.with_values(back, frame(spark, {"a": [3.0], "c": [None, 9.0]}), "v", ["k"])
    assert {r["k"]: decode(bytes(r["sketch"])).count for r in after.collect()} == {"a": 3, "b": 1, "c": 1}
    with pytest.raises(TypeError):
        values.write.parquet(str(tmp_path / "v"))
        store.read(spark, str(tmp_path / "v"), "k")
    assert bytes(store.create(spark, None).first()["sketch"]) == encode(Sketch())


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", "ab"[m % 2], float(h * 10 + m)) for h in range(4) for m in range(0, 60, 7)]
    batch = spark.createDataFrame(rows, "t string, k string, v double").selectExpr("cast(t as timestamp) t", "k", "v")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    bins = windows.windowed_bins(stream, "t", "v", "1 hour", "10 hours", ["k"])
    query = bins.writeStream.outputMode("complete").format("memory").queryName("stream_bins").start()
    query.processAllAvailable()
    query.stop()
    of = lambda b: {(r["start"], r["k"]): bytes(r["s"]) for r in windows.sketches(b, ["k"]).select("start", "k", blob.from_struct("sketch").alias("s")).collect()}
    got = of(spark.table("stream_bins"))
    assert len(got) == 8 and got == of(windows.windowed_bins(batch, "t", "v", "1 hour", "10 hours", ["k"]))


def test_build_plan_prunes_and_pushes(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 3 k", "cast(id as double) v", "'x' unused").write.parquet(str(tmp_path / "t"))
    df = merging.build(spark.read.parquet(str(tmp_path / "t")).where("id >= 10"), "v", ["k"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan and "GreaterThanOrEqual(id,10)" in plan and "Python" not in plan and "ArrowEval" not in plan


def test_aggregate_over_a_window(spark):
    sql.register(spark, "x_")
    values = spark.createDataFrame([(i, float(i)) for i in range(1, 7)], "i long, v double")
    own = merging.build(values, "v", ["i"], column="s").select("i", blob.from_struct("s").alias("sketch"))
    own.createOrReplaceTempView("window_sketches")
    rows = spark.sql("SELECT i, x_agg(sketch) OVER (ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM window_sketches").collect()
    assert {r["i"]: decode(bytes(r["s"])).count for r in rows} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 3, 6: 3}


def test_a_chain_of_calls_is_one_python_stage(spark):
    sql.register(spark, "x_")
    plan = spark.sql("SELECT x_count(x_add(sketch, 1)) AS n FROM x_create()")
    assert plan.first()["n"] == 1
    assert plan._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_randomised_signed_quantiles(spark):
    """Fractional ranks on the negative side, where one cumulative sum over all bins would differ."""
    rng = random.Random(8)
    groups = {str(i): [rng.choice([rng.gauss(-2, 2), 0.0, rng.gauss(1, 1)]) for _ in range(rng.randint(2, 15))] for i in range(60)}
    qs = [rng.random() for _ in range(12)]
    s = merging.build(frame(spark, groups), "v", ["k"]).withColumn("q", F.explode(F.array(*map(F.lit, qs))))
    got = {(r["k"], r["q"]): r["x"] for r in s.select("k", "q", native.quantile(F.col("sketch"), F.col("q")).alias("x")).collect()}
    for k, values in groups.items():
        want = decode(encode(folded(values)))
        for q in qs:
            assert got[k, q] == pytest.approx(want.quantile(q), rel=1e-12)


def test_rollup_levels(spark):
    values = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)], "k string, l string, v double")
    own = merging.build(values, "v", ["k", "l"], column="s").select("k", "l", blob.from_struct("s").alias("sketch"))
    rows = merging.rolled_up(own, ["k", "l"]).select("k", "l", "level", native.count(F.col("sketch")).alias("n")).collect()
    assert sorted((r["level"], r["n"]) for r in rows) == [(0, 1), (0, 1), (0, 1), (1, 1), (1, 2), (2, 3)]


def test_keys_of_any_name(spark):
    values = spark.createDataFrame([(1, 2, 3, 4, 5, 1.0), (1, 2, 3, 4, 5, 2.0)], "i int, c int, sign int, n int, sketch int, `v x` double")
    own = merging.build(values, F.col("`v x`"), ["i", "c", "sign", "n", "sketch"], column="out")
    assert own.columns == ["i", "c", "sign", "n", "sketch", "out"] and own.select(native.count(F.col("out"))).first()[0] == 2
    again = merging.merged(own, "out", ["i", "c", "sign", "n"], "sum")
    assert again.columns == ["i", "c", "sign", "n", "sum", "dropped"] and again.first()["sum"]["n"] == 2
