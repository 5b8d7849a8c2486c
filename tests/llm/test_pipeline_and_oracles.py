"""The corpus pipeline on a planted table, and the SQL of the registered queries."""

import random

import corpus_pipeline
import pytest
from check_oracles import compare, duck

from trialspark.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    n, ok, note = compare(spark, duck(SF), SF, name, ORACLES[name])
    assert ok and n, note


def sentence(n, seed, lang="en"):
    rng = random.Random(seed)
    parts = {"en": ["the", "ing", "an", "on", "er", "re", "th", "ed"], "de": ["ung", "sch", "ein", "ver", "ich", "tz", "ü", "be"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_every_stage_takes_effect_on_what_its_predecessor_kept(spark, tmp_path):
    shared, secret = sentence(60, 900), sentence(25, 901)
    clean = [(i, sentence(120 + i, i, "de" if i % 3 == 0 else "en"), "de" if i % 3 == 0 else "en", "s", 0) for i in range(60)]
    whole = clean[5][1]
    rows = [*clean, (70, whole, "en", "s", 0), (71, whole.replace(" ", "  ", 3), None, "s", 0), (72, "12 34 !", "en", "s", 0), (73, None, None, None, None),
            (74, sentence(40, 74) + " " + shared, "en", "s", 0), (75, sentence(50, 75) + " " + shared + " " + sentence(10, 76), "en", "s", 0), (76, shared, None, "s", 0),
            (77, sentence(30, 77) + " " + secret + " " + sentence(30, 78), "en", "s", 0), (78, secret, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, secret), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            kept.append({r.doc_id: r for r in docs.collect()})
    ids = [set(k) for k in kept]
    everything = {r[0] for r in rows}
    assert ids[0] == everything - {72, 73}
    assert ids[1] == ids[0] - {70, 71}
    assert ids[2] == ids[1] - {76} and len(kept[2][75].text.split()) == 60 and kept[2][74].text.endswith(shared)
    assert ids[3] == ids[2] - {78} and len(kept[3][77].text.split()) == 60
    assert all(kept[3][i].text == text for i, text, *_ in clean) and all(r.n_chars == len(r.text) for r in kept[3].values())
    assert {r.doc_id for r in docs.collect()} == ids[3]
    assert docs.where("bin_id IS NULL").count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
