import csv

import pytest

from sievework.sources import files, ingest
from sievework.streaming.ingest import ingest_new_files, stream_csv

MUSIC = ["title", "tag", "artist", "year", "views", "features", "lyrics", "id", "language_cld3"]


def write_csv(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file)
        writer.writerow(header)
        writer.writerows(rows)


def song(i, language, lyrics="line one\nline, \"two\""):
    return [f"t{i}", "pop", "a", "1999", str(i), '{"x"}', lyrics, str(i), language]


def test_scan_csv(spark, tmp_path):
    write_csv(tmp_path / "a.csv", ["x", "unused", "y"], [["1", "u", "a\nb"], ["bad", "u", ""], ["3", "u", 'q "r"']])
    df = files.scan_csv(spark, str(tmp_path), {"y": "string", "x": "int"})
    assert df.columns == ["y", "x"]
    assert sorted(((r.x, r.y) for r in df.collect()), key=str) == [(1, "a\nb"), (3, 'q "r"'), (None, None)]
    with pytest.raises(ValueError, match="columns not in"):
        files.scan_csv(spark, str(tmp_path), {"z": "int"})


def test_music(spark, tmp_path):
    write_csv(tmp_path / "music.csv", MUSIC + ["extra"], [song(i, "en" if i % 2 else "fr") + ["e"] for i in range(20)])
    ingest.ingest_music(spark, str(tmp_path / "music.csv"), str(tmp_path / "meta"), str(tmp_path / "text"))
    meta, text = files.scan_parquet(spark, str(tmp_path / "meta")), files.scan_parquet(spark, str(tmp_path / "text"))
    assert meta.columns == ["title", "tag", "artist", "year", "views", "features", "id"]
    assert text.columns == ["id", "lyrics"]
    assert sorted(r.id for r in meta.collect()) == sorted(r.id for r in text.collect()) == list(range(1, 20, 2))
    assert {r.lyrics for r in text.collect()} == {'line one\nline, "two"'}
    assert dict(meta.dtypes)["year"] == "bigint"


def test_movies(spark, tmp_path):
    header = list(ingest.MOVIE_COLUMNS)
    rows = [["1" if ingest.MOVIE_COLUMNS[c] != "string" else c for c in header] for _ in range(3)]
    for row, language in zip(rows, ("en", "fr", "en")):
        row[header.index("original_language")] = language
    write_csv(tmp_path / "movies.csv", header, rows)
    ingest.ingest_movies(spark, str(tmp_path / "movies.csv"), str(tmp_path / "meta"), str(tmp_path / "text"))
    meta, text = files.scan_parquet(spark, str(tmp_path / "meta")), files.scan_parquet(spark, str(tmp_path / "text"))
    assert meta.count() == text.count() == 2
    assert meta.columns == [c for c in header if c != "overview"] and text.columns == ["id", "overview"]


def test_append_keeps_all_rows(spark, tmp_path):
    for start in (0, 5):
        files.append_parquet(spark.range(start, start + 5), str(tmp_path / "t"))
    assert files.scan_parquet(spark, str(tmp_path / "t")).count() == 10
    files.save_parquet(spark.range(3), str(tmp_path / "t"))
    assert files.scan_parquet(spark, str(tmp_path / "t")).count() == 3


def test_incremental_ingest_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        types = {c: ingest.MUSIC_COLUMNS[c] for c in MUSIC}
        stream = stream_csv(spark, str(tmp_path / "in"), MUSIC, types)
        ingest_new_files(stream, "language_cld3", "en", "id", "lyrics", out, state)
        meta, text = files.scan_parquet(spark, f"{out}/metadata"), files.scan_parquet(spark, f"{out}/text")
        ids = sorted(r.id for r in text.collect())
        assert ids == sorted(r.id for r in meta.collect())
        return ids

    write_csv(tmp_path / "in/a.csv", MUSIC, [song(1, "en"), song(2, "fr")])
    assert run() == [1]
    assert run() == [1]
    write_csv(tmp_path / "in/b.csv", MUSIC, [song(3, "en"), song(4, "en")])
    assert run() == [1, 3, 4]


def test_append_checks_the_columns(spark, tmp_path):
    files.append_parquet(spark.range(3), str(tmp_path / "t"))
    with pytest.raises(ValueError, match="holds"):
        files.append_parquet(spark.range(3).selectExpr("cast(id as int) as id"), str(tmp_path / "t"))
    assert files.scan_parquet(spark, str(tmp_path / "t")).count() == 3


def test_a_file_is_parsed_once(spark, tmp_path):
    write_csv(tmp_path / "music.csv", MUSIC, [song(i, "en") for i in range(5)])
    tracker = spark.sparkContext._jsc.sc().statusStore()
    before = tracker.jobsList(None).size()
    ingest.ingest_music(spark, str(tmp_path / "music.csv"), str(tmp_path / "meta"), str(tmp_path / "text"))
    # columns, quote states of the ranges, edges, first records, then one parse and two writes, each of one or two jobs
    assert tracker.jobsList(None).size() - before <= 12
    assert "parquet" in files.scan_parquet(spark, str(tmp_path / "meta"))._jdf.queryExecution().executedPlan().toString().lower()
