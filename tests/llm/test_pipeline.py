import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearfield.llm import decontaminate, order_minhash, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def test_stages_keep_the_columns_and_only_drop(stages):
    for (_, before), (name, after) in list(zip(stages, stages[1:], strict=False))[:-1]:
        assert sorted(after.columns) == sorted(before.columns), name
        assert after.exceptAll(before.select(after.columns)).count() == 0, name


def test_exact_stage_against_brute_force(stages):
    before, after = stages[1][1].collect(), stages[2][1].collect()
    last = {}
    for r in before:
        last[r.text or ""] = max(last.get(r.text or "", -1), r.doc_id)
    assert {r.doc_id for r in after} == set(last.values())


def test_benchmark_stage_against_its_scan(spark, stages):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    report = decontaminate.hit_report(decontaminate.scan(stages[3][1], bench))
    assert {r.doc_id for r in report.filter("not contaminated").collect()} == {r.doc_id for r in stages[4][1].collect()}


def test_mix_stage_counts_and_run(spark, stages):
    rows = stages[5][1].collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in stages[4][1].collect()}
    one = {(r.doc_id, r["copy"]) for r in rows}
    assert len(one) == len(rows)
    assert all(r.shuffle_key == hashlib.md5(f"17:{r.doc_id}:{r['copy']}".encode()).hexdigest() for r in rows)
    again = corpus_pipeline.run(spark, SF)
    assert {(r.doc_id, r["copy"]) for r in again.collect()} == one
    assert again.filter(F.col("text").isNull()).count() == 0


def test_quality_stage_against_the_classifier(spark, stages):
    out = quality.quality(stages[0][1], spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in out.filter("kept").collect()} == {r.doc_id for r in stages[1][1].collect()}


def test_near_stage_against_all_pairs(stages):
    rows = sorted((r.doc_id, order_minhash.shingles(r.text)[1]) for r in stages[2][1].collect())
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if len(a) and len(b) and order_minhash.ordered_similarity(a, b, 0.8):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    assert {r.doc_id for r in stages[3][1].collect()} == {i for i, _ in rows if root(i) == i}


def test_stages_live_with_empty_tables_nulls_and_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(40).withColumn("text", F.when(F.col("doc_id") % 5 > 0, F.col("text")))
    for name in ("bad", "other", "place", "kept_place", "of_rate", "of_source", "row", "body"):
        odd = odd.withColumn(name, F.lit("mine"))
    for table in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, table, SF)
            assert set(table.columns) <= set(after.columns), name
            assert after.count() <= table.count() or name == "mix"
            assert after.filter("place = 'mine'").count() == after.count()
