from datetime import date, datetime

import pytest
from conftest import STUDIES, frame, study_rows

from trialspark.plans.modeling import build_modeling_table
from trialspark.session import stored
from trialspark.sources import registry as R
from trialspark.sources.bindings import reduced_studies, registry
from trialspark.sources.schemas import SCHEMAS, conform


def test_load_skips_missing_and_unknown_tables(spark, tables, tmp_path):
    R.write_table(tables.studies, str(tmp_path), "studies")
    R.write_table(tables.countries, str(tmp_path), "countries")
    R.write_table(tables.countries, str(tmp_path), "unknown_table")
    assert set(R.load_tables(spark, str(tmp_path))) == {"studies", "countries"}
    loaded = R.load_registry(spark, str(tmp_path))
    assert loaded.studies.count() == 60 and loaded.facilities is None


def test_studies_are_mandatory(spark, tables):
    with pytest.raises(ValueError):
        R.TrialTables.of({"countries": tables.countries})


def test_conform_adds_and_casts(spark):
    d = conform(frame(spark, "nct_id string, enrollment string, start_date string, extra int", [("a", "12", "2020-05-01", 1), ("b", "x", "?", 2)]), "studies")
    assert d.columns == SCHEMAS["studies"].names
    rows = d.select("enrollment", "start_date", "phase").collect()
    assert tuple(rows[0]) == (12.0, date(2020, 5, 1), None) and tuple(rows[1]) == (None, None, None)


def test_text_ingest_round_trip(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "studies.txt").write_text(
        "nct_id|overall_status|extra|phase|enrollment|start_date|study_type\n"
        "N1|COMPLETED|x|PHASE1|100|2020-01-01|INTERVENTIONAL\nN2|NOT YET RECRUITING|y|N/A|NA|bad|INTERVENTIONAL\n")
    (raw / "eligibilities.txt").write_text('nct_id|criteria\nN1|"line one\nline two | with bar"\n')
    out = R.ingest_text_tables(spark, str(raw), str(tmp_path / "processed"))
    rows = {r["nct_id"]: r for r in out["studies"].collect()}
    assert rows["N1"]["phase"] == "Phase 1" and rows["N1"]["overall_status"] == "Completed"
    assert rows["N2"]["phase"] == "N/A" and rows["N2"]["enrollment"] is None and rows["N2"]["start_date"] is None
    assert out["eligibilities"].first()["criteria"] == "line one\nline two | with bar"


def test_resolve_source_takes_first_non_empty(spark, tables, tmp_path):
    R.write_table(frame(spark, STUDIES, study_rows()).limit(0), str(tmp_path / "empty"), "studies")
    R.write_table(tables.studies, str(tmp_path / "sample"), "studies")
    candidates = [("missing", str(tmp_path / "none")), ("empty", str(tmp_path / "empty")), ("sample", str(tmp_path / "sample"))]
    found, name = R.resolve_source(spark, candidates)
    assert name == "sample" and found.studies.count() == 60
    with pytest.raises(FileNotFoundError):
        R.resolve_source(spark, candidates[:2])


def test_modeling_table_save_and_load(spark, tables, tmp_path):
    with pytest.raises(RuntimeError):
        R.save_modeling_table(None, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        R.load_modeling_table(spark, str(tmp_path))
    R.save_modeling_table(tables.studies, str(tmp_path))
    assert R.load_modeling_table(spark, str(tmp_path)).count() == 60


def test_sql_text_binds_parameters(spark, tables):
    got = R.query_registry(spark, tables, "SELECT count(*) AS n FROM conditions WHERE contains(downcase_name, :q)", q="asthma")
    assert got.first()["n"] == 30
    cached = tables.persist(["countries"])
    assert cached.countries.is_cached
    cached.unpersist()


def test_quoted_breaks_across_file_blocks_give_the_same_rows(spark, tmp_path):
    want = {}
    for name in ("a", "b"):
        with open(tmp_path / f"{name}.txt", "w", newline="") as out:
            out.write("id|nct_id|criteria|gender\r\n")
            for i in range(120):
                text = None if i % 11 == 0 else f"Inclusion {name}{i}:\n\n - age \"{i}\" | years\r\n" + "- more words\n" * (i % 5)
                cell = "" if text is None else '"' + text.replace('"', '""') + '"'
                want[f"N{name}{i}"] = text
                out.write(f"{i}|N{name}{i}|{cell}|ALL\r\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "97b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0b")
            got = R.read_text_table(spark, str(tmp_path), "eligibilities").collect()
            assert len(got) == 240 and all(r["gender"] == "ALL" for r in got)
            assert {r["nct_id"]: r["criteria"] and r["criteria"].strip() for r in got} == {k: v and v.strip() for k, v in want.items()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_jdbc_asks_for_the_partitioning_of_every_table(spark):
    with pytest.raises(ValueError, match="studies"):
        R.load_from_jdbc(spark, "jdbc:none", {"conditions": {}}, only=["studies"])


def test_bucketed_tables_join_on_the_study_without_a_shuffle(spark, tables, tmp_path):
    import re

    from trialspark.plans.modeling import build_modeling_table
    from trialspark.sources.registry import load_bucketed, store_bucketed

    store_bucketed(tables, "bucketed_", str(tmp_path / "b"), buckets=8)
    stored_tables = load_bucketed(spark, "bucketed_")
    plain, bucketed = (build_modeling_table(t) for t in (tables, stored_tables))
    assert sorted(map(str, bucketed.collect())) == sorted(map(str, plain.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffles = [len(re.findall(r"Exchange hashpartitioning\(nct_id#", build_modeling_table(t)._jdf.queryExecution().executedPlan().toString())) for t in (tables, stored_tables)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in stored_tables.present():
            spark.sql(f"DROP TABLE bucketed_{name}")
    assert shuffles[1] <= 3 and shuffles[0] > 20  # only what is joined by condition or sponsor comes back to its studies


def _odd_orders(spark, folder):
    """Parts, suppliers and customers that are missing or listed twice, lines without values, orders without lines."""
    t = {
        "nation": [("n_nationkey int, n_name string"), [(0, "A"), (1, "B"), (2, None)]],
        "supplier": [("s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
                     [(1, "S1", 0, 5.0), (2, "S2", 1, -5.0), (2, "S2", 0, 7.0), (2, "S2", 0, 8.0), (3, "S3", 2, 1.0), (4, "S4", 9, 1.0)]],
        "part": [("p_partkey long, p_name string, p_brand string, p_type string"),
                 [(1, None, "b", "T1"), (2, "gear", "b", "T2"), (2, "Bolt", "b", None), (3, "Gear", "b", "T3")]],
        "customer": [("c_custkey long, c_name string, c_acctbal double, c_mktsegment string"),
                     [(1, "C1", 10.0, "MACHINERY"), (2, "C2", -1.0, "BUILDING"), (3, "C3", 9000.0, None), (3, "C0", 9.0, "BUILDING")]],
        "orders": [("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
                   [(i, i % 5, "FPO"[i % 3], 10000.0 + 9000 * i, datetime(1997, 1 + i % 12, 3), ["1-URGENT", "2-HIGH", "5-LOW"][i % 3 if i % 4 else 0])
                    for i in range(40)]],
        "lineitem": [("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                      "l_tax double, l_returnflag string, l_shipdate timestamp"),
                     [(i, (i + k) % 5, None if i == 7 else (i * k + k) % 6, k, None if (i + k) % 7 == 0 else float((3 * i + k) % 9), 1000.5 * (i + k), 0.01 * k, 0.02 * k,
                       ["A", "N", "R", None][(i + k * (i % 3)) % 4], datetime(1998, 1 + k, 1 + i % 20)) for i in range(35) for k in range(i % 6)]],
        "documents": [("doc_id long, text string, lang string, source string"), [(i, "a\nb" * i, "en", "src0") for i in range(0, 40, 3)]],
    }
    for name, (schema, rows) in t.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_reduced_studies_equal_the_reductions_of_the_bound_tables(spark, tmp_path):
    folder = _odd_orders(spark, tmp_path)
    bound = registry(spark, folder)
    joined = build_modeling_table(bound, 1996)
    rows = lambda df: sorted(map(repr, df.select(*sorted(joined.columns)).collect()))
    want = rows(joined)
    for stage in (None, stored):
        one_pass = build_modeling_table(bound, 1996, stage=stage, reduced=reduced_studies(spark, folder))
        assert sorted(one_pass.columns) == sorted(joined.columns)
        assert rows(one_pass) == want
    assert len(want) > 20


def test_line_items_are_read_once_for_the_reduced_studies(spark, tmp_path):
    plan = reduced_studies(spark, _odd_orders(spark, tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation [l_orderkey#" in line for line in plan.splitlines()) == 1


def test_frequencies_and_counts_per_day_move_no_study(spark, tmp_path):
    """Both are stored, so that their size is known: no exchange on the condition is left in the modeling table."""
    folder = _odd_orders(spark, tmp_path)
    m = build_modeling_table(registry(spark, folder), 1996, stage=stored, reduced=reduced_studies(spark, folder))
    plan = m.select("nct_id", "enrollment", "condition_prevalence_proxy", "competing_trials_count")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(nct_id#" in plan and "hashpartitioning(condition_lower#" not in plan
    assert "hashpartitioning(coalesce(condition_lower" not in plan


def test_whole_tables_join_parts_to_studies_and_group_no_orders(spark, tmp_path):
    """Every line has a part with name and type, orders and customers have one row each (some orders no customer, some parts two rows)."""
    odd, folder = _odd_orders(spark, tmp_path / "odd"), str(tmp_path / "whole")
    for name in ("nation", "supplier", "orders", "lineitem", "documents"):
        spark.read.parquet(f"{odd}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    spark.createDataFrame([(i, f"Part {i % 3}", "b", f"T{i}") for i in (0, 1, 2, 2, 3, 4)] + [(1, "Other", "b", "T0")],
                          "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{folder}/part.parquet")
    spark.read.parquet(f"{odd}/customer.parquet").where("c_name <> 'C0'").write.parquet(f"{folder}/customer.parquet")
    bound = registry(spark, folder)
    joined = build_modeling_table(bound, 1996)
    rows = lambda df: sorted(map(repr, df.select(*sorted(joined.columns)).collect()))
    for sf, stage in ((folder, None), (folder, stored), (odd, stored)):
        want = build_modeling_table(registry(spark, sf), 1996)
        assert rows(build_modeling_table(registry(spark, sf), 1996, stage=stage, reduced=reduced_studies(spark, sf, stage))) == rows(want)
    plan = reduced_studies(spark, folder, stored)._jdf.queryExecution().executedPlan().toString()
    tree = plan.split("\n\n")[0]
    assert "SortAggregate" not in tree and "o_orderkey" in tree  # lines are hashed, orders not grouped
    lines = next(line for line in plan.splitlines() if "hashpartitioning(l_orderkey" in line)
    below = plan[plan.index(lines):]
    assert "p_partkey" not in below.split("Scan parquet")[0]
