"""Each stage on small tables: its decisions, its columns, odd rows."""

import corpus_pipeline as C
import pytest
from papertrail.llm import leaks, quality
from papertrail.llm.common import cut


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_names():
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]


def test_quality(spark, docs, sf_dir):
    got = C.keep_good(spark, docs, sf_dir)
    want = quality.op1_quality(spark, sf_dir).filter("predicted = 1")
    assert got.columns == docs.columns and ids(got) == ids(want)


def test_near_duplicates(spark, docs, sf_dir, small):
    from tests.llm.test_similar import brute
    got = C.drop_near_duplicates(spark, docs, sf_dir)
    want = sorted({int(c) for _, _, c in brute(small, C.SHINGLE, C.PERCENT)})
    assert got.columns == docs.columns and ids(got) == want


def test_decontamination(spark, docs, sf_dir):
    got = C.drop_leaks(spark, docs, sf_dir)
    assert got.columns == docs.columns and ids(got) == ids(leaks.op3_benchmark_leaks(spark, sf_dir).filter("NOT contaminated"))


def test_secrets(spark, docs, sf_dir):
    from tests.llm.test_secret_scan import base
    got = cut(C.redact_secrets(spark, docs, sf_dir), "test")
    before = {r.doc_id: r.text for r in docs.collect()}
    assert got.columns == docs.columns and got.count() == len(before)
    for r in got.collect():
        assert r.n_chars == len(r.text)
        for s, _, e in base(before[r.doc_id]):
            assert before[r.doc_id][s:e] not in r.text
        if "<" not in r.text:
            assert r.text == before[r.doc_id]


def test_run(spark, sf_dir):
    from tests.llm.test_packing import hold
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        documents = cut(stage(spark, documents, sf_dir), "test")
    hold(C.run(spark, sf_dir).collect(), [(r.doc_id, r.text) for r in documents.collect()], 4096)


def test_odd_rows(spark, odd, empty, sf_dir):
    for name, stage in C.STAGES:
        assert stage(spark, empty, sf_dir).collect() == [], name
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, odd, sf_dir).columns == odd.columns, name
    deduped = C.drop_near_duplicates(spark, odd, sf_dir)
    texts = [r.text for r in deduped.collect()]
    assert texts.count("the same text") == 1 and texts.count("repeated id") == 1 and texts.count(None) == 1
    assert sum((t or "").strip(" \n\t") == "" for t in texts) == 4


CLASHING = ["_h", "_k", "_copy", "_score", "row", "label", "key", "n", "found", "score", "_stage_hash", "_STAGE_ID", "_stage_copy", "_stage_score",
            "sig", "spans", "items"]


def test_columns_of_any_name_go_through(spark, docs, sf_dir):
    """Whatever a user's columns are called, rows come out of each stage as they went in (but for redacted texts)."""
    own = docs.selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in CLASHING])
    for name, stage in C.STAGES[:-1]:
        want = ids(stage(spark, docs, sf_dir))
        got = cut(stage(spark, own, sf_dir), "test")
        assert got.columns == own.columns and ids(got) == want, name
        assert got.filter(" OR ".join(f"`{c}` <> concat('{c}', doc_id) OR `{c}` IS NULL" for c in CLASHING)).count() == 0, name
