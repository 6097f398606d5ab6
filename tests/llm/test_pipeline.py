import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from plumbline.llm.queries import QUERIES  # noqa: E402
from tests.llm.test_line_join import brute as line_brute  # noqa: E402
from tests.llm.test_simhash import shingles  # noqa: E402
from tests.llm.test_suffix_match import brute as leak_brute  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns_and_order(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "near_dedup", "decontamination", "packing",
    ]
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[1:-1])


def test_toxicity_follows_the_score(spark, stages, sf_dir):
    toxic = {r.doc_id for r in QUERIES["op10_noisy_channel"](spark, sf_dir).filter("predicted = 1").collect()}
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in stages[0].collect()} - toxic


def test_line_dedup_equals_all_pairs(stages):
    expected = {eval(i): t for i, t, n in line_brute([(r.doc_id, r.text) for r in stages[1].collect()], 80, least=1) if not n or t.strip()}
    assert {r.doc_id: r.text for r in stages[2].collect()} == expected
    assert stages[2].filter(F.char_length("text") != F.col("n_chars")).count() == 0


def test_near_dedup_leaves_no_similar_pair_and_one_of_each(stages):
    before = {r.doc_id: shingles(r.text) for r in stages[2].collect()}
    after = {r.doc_id for r in stages[3].collect()}

    def alike(a, b):
        return len(before[a] & before[b]) >= 0.8 * len(before[a] | before[b])

    ids = sorted(before)
    neighbours = {a: [b for b in ids if b != a and alike(a, b)] for a in ids}
    assert not any(b in after for a in after for b in neighbours[a])
    assert all(neighbours[a] for a in set(ids) - after)


def test_decontamination_equals_all_windows(spark, stages, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in stages[3].collect() if not leak_brute([(r.doc_id, r.text)], items)[0][-1]}
    assert {r.doc_id for r in stages[4].collect()} == clean


def test_packing_takes_all_that_is_left(stages):
    found = stages[5].toPandas()
    assert set(found.doc_id) == {r.doc_id for r in stages[4].collect()}
    assert (found.groupby("doc_id").length.sum() == found.groupby("doc_id").doc_tokens.first()).all()


def test_run_gives_the_last_stage(spark, stages, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "ids_crc32")
    assert got.exceptAll(stages[5].select(*got.columns)).count() == 0 and got.count() > 0
