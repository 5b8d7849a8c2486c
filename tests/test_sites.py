import random
from collections import Counter
from itertools import combinations

import pytest
from conftest import frame
from pyspark.sql import functions as F

from trialspark.operators import network as N, sites as T
from trialspark.plans.modeling import build_modeling_table


def test_top_sites_bases(spark, tables):
    rows = T.top_sites(tables, "asthma").collect()
    assert [r["n_trials"] for r in rows] == sorted((r["n_trials"] for r in rows), reverse=True)
    assert all(r["n_completed"] + r["n_terminated"] <= r["n_trials"] for r in rows)
    by_rows = T.top_sites(tables, "asthma", basis="rows").collect()
    assert len(by_rows) == len(rows)


def test_site_performance(spark, tables):
    d = T.site_performance(tables.facilities, build_modeling_table(tables), country="japan")
    rows = d.collect()
    assert rows and {r["country"] for r in rows} == {"Japan"}
    assert all(0 <= r["completion_rate_pct"] <= 100 for r in rows)


def test_country_performance_scores(spark, tables):
    rows = T.country_performance(tables).collect()
    assert all(r["completion_rate"] is None or 0 <= r["completion_rate"] <= 1 for r in rows)
    assert all(r["performance_score"] == 0 for r in rows if r["completion_rate"] is None)


def test_allocation_sums_to_target_with_repair(spark, tables):
    for repair in (False, True):
        rows = T.recommend_sites(tables, "pain", 1001, 3, repair_residual=repair).orderBy("rank").collect()
        assert [r["rank"] for r in rows] == [1, 2, 3] and all(r["recommended_sites"] >= 1 for r in rows)
        total = sum(r["allocated_enrollment"] for r in rows)
        assert total == 1001 if repair else abs(total - 1001) <= 2
    assert "completed trials; completion rate" in rows[0]["rationale"]
    assert T.recommend_sites(tables, "nothing", 10, 3).count() == 0


def test_equal_shares_when_all_scores_are_zero(spark, tables, monkeypatch):
    perf = T.country_performance(tables).withColumn("performance_score", F.lit(0.0))
    monkeypatch.setattr(T, "country_performance", lambda *a: perf)
    rows = T.recommend_sites(tables, "pain", 300, 3).collect()
    assert {r["allocated_enrollment"] for r in rows} == {100}


def test_zscores_are_zero_without_variance(spark):
    d = frame(spark, "country string, a double, b double", [("x", 1.0, 5.0), ("y", 3.0, 5.0), ("z", None, 5.0)])
    rows = {r["country"]: r for r in T.country_zscores(d, ["a", "b"], wide=True).collect()}
    assert {r["b"] for r in rows.values()} == {0.0}
    assert rows["y"]["a"] > rows["x"]["a"] > rows["z"]["a"]
    assert T.country_zscores(d, ["a", "b"], top=2).count() == 4


def test_score_forms(spark):
    d = frame(spark, "r double, q double, n long", [(80.0, 1.5, 10)])
    one = lambda m: d.select(T.site_score(F.col("r"), F.col("q"), F.col("n"), m)).first()[0]
    assert one("pipeline") == pytest.approx(0.4 * 80 + 40 + 10)
    assert one("sql") == pytest.approx(0.4 * 80 + 0.4 * 50 + 0.2 * 1 * 10)
    with pytest.raises(ValueError):
        one("other")


def test_network_nodes_and_edges(spark, tables):
    nodes = {r["site_key"] for r in N.network_nodes(tables, "pain", 5).collect()}
    edges = N.network_edges(tables, "pain", 5).collect()
    assert edges and all({r["site_a"], r["site_b"]} <= nodes and r["site_a"] < r["site_b"] for r in edges)


@pytest.mark.parametrize("block", [2, 5, 1000])
def test_shared_trials_equal_brute_force(spark, block):
    r = random.Random(5)
    rows, seen = [], {}
    for t in range(25):
        size = 18 if t < 4 else r.randint(1, 6)  # a few trials with most of the sites
        for s in r.sample(range(22), size):
            site = (f"S{s}", None if s == 3 else f"T{s % 3}")
            rows += [(t, "c", "X", *site)] * r.choice([1, 1, 2])
            seen.setdefault(t, set()).add(site)
    less = lambda a, b: a[0] < b[0] or (a[0] == b[0] and None not in (a[1], b[1]) and a[1] < b[1])
    want = Counter()
    for members in seen.values():
        for a, b in combinations(members, 2):
            if less(a, b) or less(b, a):
                want[(a, b) if less(a, b) else (b, a)] += 1
    d = frame(spark, "nct_id long, condition string, country string, facility_name string, city string", rows)
    for k in (1, 2, 3):
        got = {((x["facility_name_a"], x["city_a"]), (x["facility_name_b"], x["city_b"])): x["shared_trials"]
               for x in N.shared_trial_edges(d, min_shared=k, block_sites=block).collect()}
        assert got == {p: n for p, n in want.items() if n >= k}


def test_shared_trials_of_many_sites_in_many_trials(spark):
    d = spark.range(90).crossJoin(spark.range(40).select(F.col("id").alias("trial"))).select(
        F.concat(F.lit("S"), "id").alias("facility_name"), F.lit("T").alias("city"), F.col("trial").alias("nct_id"), F.lit(1).alias("w"))
    got = N.shared_trial_edges(d, within=("w",), block_sites=16).agg(F.count("*"), F.min("shared_trials"), F.max("shared_trials")).first()
    assert tuple(got) == (90 * 89 // 2, 40, 40)


@pytest.mark.parametrize("page", [7, 4096])
def test_pairs_of_common_trials_are_formed_once_a_page(spark, page):
    r = random.Random(8)
    seen = {t: r.sample(range(60), 50 if t < 90 else 2) for t in range(100)}
    rows = [(t, w, f"S{s}", None if s == 3 else "T") for t, sites in seen.items() for s in sites for w in ("dense", None)]
    rows += [(1000 + t, "sparse", f"S{s}", "T") for t in range(30) for s in r.sample(range(60), 3)]
    d = spark.createDataFrame(rows, "nct_id long, w string, facility_name string, city string")
    want = Counter()
    for t, w, _, _ in {(t, w, 0, 0) for t, w, *_ in rows}:
        members = {(name, city) for u, v, name, city in rows if (u, v) == (t, w)}
        want.update((w, a[0], b[0]) for a, b in combinations(sorted(members, key=lambda m: m[0]), 2))
    edges = N.shared_trial_edges(d, within=("w",), block_sites=4, page_trials=page)
    got = {(x["w"], x["facility_name_a"], x["facility_name_b"]): x["shared_trials"] for x in edges.collect()}
    assert got == {p: n for p, n in want.items() if n >= 2}


def test_pairs_of_sites_that_share_all_months_are_not_shuffled(spark):
    d = spark.range(300).crossJoin(spark.range(80).select(F.col("id").alias("month"))).select(F.concat(F.lit("S"), "id").alias("name"), "month")
    edges = N.shared_trial_edges(d, trial="month", site=("name",), within=())
    assert edges.agg(F.count("*"), F.min("shared_trials")).first() == (300 * 299 // 2, 80)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[:plan.index("Join")]
