import random
from datetime import date, timedelta

import pytest
from conftest import frame

from trialspark.operators.intervals import competitors_in_window, count_overlaps

SCHEMA = "nct_id long, g string, start_date date, completion_date date"


def day(n):
    return date(2010, 1, 1) + timedelta(days=n)


def result(df, **kw):
    return {r["nct_id"]: r["overlaps"] for r in count_overlaps(df, **kw).collect()}


@pytest.mark.parametrize("seed,inverted", [(1, 0.0), (2, 0.5), (3, 0.1)])
def test_sweep_equals_pairs(spark, seed, inverted):
    r = random.Random(seed)
    rows = []
    for i in range(150):
        s, e = sorted((r.randint(0, 700), r.randint(0, 700)))
        if r.random() < inverted:
            s, e = e, s
        rows.append((i, r.choice(["a", "a", "b", None]), None if r.random() < 0.05 else day(s),
                     None if r.random() < 0.1 else day(e)))
    d = frame(spark, SCHEMA, rows)
    assert result(d, by=["g"]) == result(d, by=["g"], method="pairs")
    assert result(d) == result(d, method="pairs")


def test_edges(spark):
    d = frame(spark, SCHEMA, [
        (1, "a", day(0), day(10)), (2, "a", day(10), day(20)),   # touching counts
        (3, "a", day(21), None),                                  # open end
        (4, "a", day(15), day(5)),                                # inverted: needs start <= 15.. and end >= ..
        (5, None, day(0), day(5)), (6, None, day(5), day(6)),     # NULL is a group
        (7, "a", None, day(10))])
    assert result(d, by=["g"]) == result(d, by=["g"], method="pairs")
    assert result(d, by=["g"])[7] == 0 and result(d, by=["g"])[5] == 1


def test_repeated_ids_exclude_each_other(spark):
    d = frame(spark, SCHEMA, [(1, "a", day(0), day(9)), (1, "a", day(5), day(20)), (2, "a", day(8), day(9)), (2, "a", day(30), day(29))])
    key = lambda df: sorted((r["nct_id"], str(r["start_date"]), r["overlaps"]) for r in df.collect())
    assert key(count_overlaps(d, by=["g"], unique_ids=False)) == key(count_overlaps(d, by=["g"], method="pairs"))


def test_partitioning_does_not_matter(spark):
    r = random.Random(9)
    rows = [(i, "a", day(r.randint(0, 300)), day(r.randint(0, 300))) for i in range(80)]
    d = frame(spark, SCHEMA, rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = result(d.coalesce(1), by=["g"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one == result(d.repartition(7), by=["g"])


def test_competitors_in_window(spark):
    d = frame(spark, "nct_id long, condition string, start_date date, completion_date date", [
        (1, "Asthma", day(0), day(50)), (2, "asthma, severe", day(90), None), (3, "Pain", day(0), None), (4, None, day(0), None),
        (5, "ASTHMA", day(0), day(59)), (6, "Asthma", day(200), day(300))])
    got = competitors_in_window(d, condition="asthma", window_start=day(51), window_end=day(100))
    assert sorted(r["nct_id"] for r in got.collect()) == [2, 5]


def test_days_are_rows_and_not_arrays_that_every_row_carries(spark):
    rows = [(i, "c", f"2020-01-{i % 28 + 1:02d}", f"2020-02-{i % 27 + 1:02d}") for i in range(200)]
    d = spark.createDataFrame(rows, "nct_id long, g string, start_date string, completion_date string")
    counted = count_overlaps(d, by=["g"], inverted=False)
    assert "collect_list" not in counted._jdf.queryExecution().optimizedPlan().toString()
    pairs = count_overlaps(d, by=["g"], method="pairs")
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, pairs.select(counted.columns).collect()))
