import random

from conftest import frame
from pyspark.sql import Window, functions as F

from trialspark.operators import ordered as O


def sample(spark, n=800, seed=3):
    r = random.Random(seed)
    pool = [0.0, -3.5, 1.0, 1e-9, 1e12]
    rows = [(i, r.choice(["x", "x", "x", "y", None]), r.choice([*pool, r.gauss(0, 50), None])) for i in range(n)]
    return frame(spark, "id long, g string, v double", rows)


def test_percentiles_equal_builtin(spark):
    d = sample(spark)
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    got = {r["g"]: r for r in O.exact_percentiles(d, "v", probs, ["g"]).collect()}
    want = {r["g"]: r for r in d.groupBy("g").agg(*[F.percentile("v", p).alias(k) for k, p in probs.items()]).collect()}
    assert got.keys() == want.keys()
    for g, row in want.items():
        for k in probs:
            assert abs(got[g][k] - row[k]) <= 1e-9 * max(1.0, abs(row[k]))


def test_percentiles_weighted_and_empty(spark):
    d = frame(spark, "v double, w long", [(1.0, 3), (5.0, 1)])
    assert O.exact_percentiles(d, "v", {"m": 0.5}, weight="w").first()["m"] == 1.0
    assert O.exact_percentiles(d.where("v > 9"), "v", {"m": 0.5}).first()["m"] is None


def test_bucket_is_monotone(spark):
    d = sample(spark).where("v IS NOT NULL").select("v", O.value_bucket(F.col("v")).alias("b")).orderBy("v").collect()
    assert all(a["b"] <= b["b"] for a, b in zip(d, d[1:]))


def test_prefix_sums_equal_window(spark):
    counts = sample(spark).where("v IS NOT NULL").groupBy("g", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("g").orderBy(F.col("v").desc()).rowsBetween(Window.unboundedPreceding, -1)
    want = counts.withColumn("n_before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    got = O.prefix_sums(counts, "v", ["n"], ["g"], descending=True).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_ranks_equal_window(spark):
    d = sample(spark).withColumn("v", F.round("v", -1)).withColumn("k", F.col("id") % 7)
    order = [F.col("k").desc_nulls_last(), F.col("v").asc_nulls_last()]
    want = d.withColumn("r", F.rank().over(Window.orderBy(*order))).withColumn(
        "rg", F.rank().over(Window.partitionBy("g").orderBy(*order)))
    got = O.with_ranks(d, [("k", True), ("v", False)], {"r": [], "rg": ["g"]}).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_stratified_order_is_a_permutation_per_stratum(spark):
    d = O.stratified_order(sample(spark), ["g"], "id")
    for r in d.groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("_pos").alias("k"), F.max("_pos").alias("m"),
                                F.max("_size").alias("s")).collect():
        assert r["n"] == r["k"] == r["m"] + 1 == r["s"]
    again = O.stratified_order(sample(spark).repartition(3), ["g"], "id")
    assert sorted((r["id"], r["_pos"]) for r in d.collect()) == sorted((r["id"], r["_pos"]) for r in again.collect())


def test_ranks_where_a_third_of_all_rows_share_one_value(spark):
    rng = random.Random(9)
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 40}", 7 if i % 3 == 0 else rng.randint(0, 3000), rng.choice([None, 1.5, 2.5])) for i in range(6000)]
    d = frame(spark, "id int, g string, v int, w double", rows)
    got = O.with_ranks(d, [("v", True), ("w", False)], {"inside": ["g"], "overall": []})
    order = [F.col("v").desc_nulls_last(), F.col("w").asc_nulls_last()]
    want = d.withColumns({"inside": F.rank().over(Window.partitionBy("g").orderBy(*order)).cast("long"), "overall": F.rank().over(Window.orderBy(*order)).cast("long")})
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
