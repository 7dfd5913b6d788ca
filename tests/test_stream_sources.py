"""Registered streams over tables that are folders of files, as large tables are."""

import pytest

from papertrail.plans import streaming_queries as Q


@pytest.fixture(scope="module")
def folders(spark, sf_dir, tmp_path_factory):
    """The first documents of the table as three files in a folder, beside the same rows as one file."""
    root = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    for name, parts in (("many", 3), ("one", 1)):
        for table, df in (("documents", docs), ("customer", customers)):
            df.repartition(parts, df.columns[0]).write.parquet(str(root / name / f"{table}.parquet"))
    for table in ("documents", "customer"):
        folder = root / "one" / f"{table}.parquet"
        file = next(folder.glob("part-*.parquet"))
        file.rename(root / "one" / "moved")
        folder.rename(root / f"{table}-left")
        (root / "one" / "moved").rename(folder)
    return str(root / "many"), str(root / "one")


@pytest.mark.parametrize("query", [Q.stream_dedup, Q.stream_quarantine, Q.stream_ingest, Q.stream_outbox])
def test_folders_and_files_give_the_same_rows(spark, folders, query):
    many, one = (sorted(map(str, query(spark, d).collect())) for d in folders)
    assert many == one and many


def test_events_in_a_folder(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(2) \
        .write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(map(str, Q.stream_state(spark, str(tmp_path)).collect())) == sorted(map(str, Q.stream_state(spark, sf_dir).collect()))
