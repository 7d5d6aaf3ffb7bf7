import pytest
from pyspark.sql import functions as F

from tests.oracle import agree, connect
from tidewheel.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, data, name):
    agree(QUERIES[name](spark, data), connect(data), ORACLES[name])


def test_found_and_kept_are_all_rows(spark, data):
    found, kept = QUERIES["p3_found"](spark, data), QUERIES["p3_kept"](spark, data)
    total = sum(spark.read.parquet(f"{data}/{t}.parquet").count() for t in ("page_content", "page_data"))
    assert found.count() + kept.count() == total and found.count() > 0


def test_every_text_has_a_form_and_forms_are_stable(spark, data):
    forms = QUERIES["p1_forms"](spark, data)
    total = spark.read.parquet(f"{data}/page_content.parquet").where("title is not null").count() + spark.read.parquet(f"{data}/user_records.parquet").where("name is not null").count()
    assert forms.count() == total
    assert forms.where("changed").count() == QUERIES["p1_found"](spark, data).count()


def test_garbled_rows_are_restored_to_known_titles(spark, data):
    r = QUERIES["p5_restored"](spark, data)
    whole = r.where("whole")
    assert 0 < whole.count() < r.count()
    assert whole.where(F.col("restored").rlike("[Ã�\x80-\x9f]")).count() <= 0.05 * whole.count()


def test_rates(spark, data):
    r = QUERIES["p6_rates"](spark, data).first()
    assert r["asked"] > 0 and r["wrong_share"] <= 0.01 and r["absent_rate"] <= 0.01


def test_all_documents_are_encoded(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = QUERIES["p7_ids"](spark, data).join(docs, "doc_id")
    assert got.count() == docs.count()
    assert got.where("text is null or text = ''").where("size(ids) > 0").count() == 0


def test_shares(spark, data):
    rows = QUERIES["p8_shares"](spark, data).collect()
    assert abs(sum(r["actual_share"] for r in rows) - 1) < 1e-9
    there = sum(r["target_share"] for r in rows if r["available_tokens"])
    assert all(abs(r["actual_share"] - r["target_share"] / there) < 0.05 for r in rows if r["available_tokens"])
    chosen = QUERIES["p8_mix"](spark, data).join(spark.read.parquet(f"{data}/mix_targets.parquet"), "source")
    assert chosen.where("repeats > max_repeats or repeats < 1").count() == 0


def test_weights_decide_how_often_documents_are_chosen(spark):
    from pathlib import Path

    d = "/root/testdata/sf0.01"
    if not Path(d).exists():
        pytest.skip("no test tables")
    rows = [r for r in QUERIES["p8_inclusion"](spark, d).collect() if r["documents"] >= 30]
    assert rows and all(abs(r["copies"] - r["expected_copies"]) <= 4 * max(1.0, r["expected_copies"]) ** 0.5 for r in rows)
    per = {}
    for r in rows:
        per.setdefault(r["source"], []).append((r["weight_from"], r["expected_copies"] / r["documents"]))
    assert any(max(v)[1] > 1.3 * min(v)[1] for v in per.values() if len(v) > 1)


def test_levels_of_unlabelled_documents(spark, data):
    got = QUERIES["p9_found"](spark, data)
    assert got.where("level between 1 and 5").count() == got.count() > 0
    assert got.join(spark.read.parquet(f"{data}/reading_labels.parquet"), "doc_id").count() == 0


def test_held_out_levels(spark):
    from pathlib import Path

    from tidewheel.llm.readability import read_levels

    d = "/root/testdata/sf0.01"
    if not Path(d).exists():
        pytest.skip("no test tables")
    labels = spark.read.parquet(f"{d}/reading_labels.parquet")
    out = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    told = read_levels(spark.read.parquet(f"{d}/documents.parquet"), labels.where(~out), keep_labelled=True)
    held = told.join(labels.where(out).select("doc_id", F.col("level").alias("truth")), "doc_id")
    assert held.where("level = truth").count() >= 0.9 * held.count() > 0
