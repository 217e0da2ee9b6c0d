import glob

import pytest

from sievework.plans import catalog


def documents(spark, folder, ids):
    rows = [(i, f"line {n}\n\"two\", " + "x" * 500, "en", "web", n) for n, i in enumerate(ids)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    table.write.parquet(f"{folder}/documents.parquet")
    return str(folder), {r[4]: r[0] for r in rows}


@pytest.mark.parametrize("name", ["csv_ingest", "csv_ranges_ingest", "incremental_ingest", "ingest_music", "ingest_movies"])
def test_landed_files_grow_in_number_not_in_size(spark, tmp_path, monkeypatch, name):
    folder, known = documents(spark, tmp_path / name, range(200))
    monkeypatch.setattr(catalog, "LANDED_BYTES", 10_000)
    monkeypatch.setattr(catalog, "scratch_path", lambda spark, kind: str(tmp_path / f"{name}-{kind}"))
    found = catalog.queries()[name](spark, folder).collect()
    keys = {"ingest_music": ("views", "id"), "ingest_movies": ("vote_count", "id")}.get(name, ("n_chars", "doc_id"))
    assert {r[keys[0]]: r[keys[1]] for r in found} == known and len(found) == 200
    assert len(glob.glob(f"{tmp_path}/{name}-*/landing/*.csv")) == 10


def test_rows_of_one_key_land_in_all_files(spark, tmp_path, monkeypatch):
    folder, _ = documents(spark, tmp_path / "in", [None] * 160)
    monkeypatch.setattr(catalog, "LANDED_BYTES", 10_000)
    landing = catalog.land_csv(spark, folder) + "/landing"
    sizes = [r["count"] for r in spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(landing).selectExpr("_metadata.file_path f").groupBy("f").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 40
